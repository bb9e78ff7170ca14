"""License scans: an exact containment join of text blocks with notice templates.

A text is cut into overlapping blocks that step by half, so any passage of half a block lies in
one whole.  Blocks are ``BLOCK`` words long for templates of up to half of that, twice as long for
templates of up to twice as many words, and so on.  A block holds a template if it has at least ``THRESHOLD`` of
the template's different words.  Words are ordered by how often they occur in all documents,
rarest first (counted in a first pass; only words of templates matter, so the order is
small).  Then

* prefix filter: a block must have one of the template's first ``n - needed + 1`` words;
* length filter: it must have ``needed`` words of the templates at all;
* positional filter: behind the first shared word, both lists must be long enough;

and what is left is counted exactly.  No match is lost.  The templates are a fixed small
table, which tasks hold whole.

Independently of templates, the base phrases are looked for word by word.

Defined results: null, empty and blank texts have 0 words and no label; repeated rows give a
row each; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.llm.common import small_batches

BLOCK, THRESHOLD = 64, 0.9

# Phrases of the base scan and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# Usual notices.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""

TEMPLATES = [
    ("Released under the MIT License", "mit"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("Licensed under the Apache License, Version 2.0", "apache"),
    ("This work is licensed under the GNU General Public License, version 3", "gpl"),
    ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gpl"),
    ("under the terms of the GNU Lesser General Public License", "lgpl"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License", "mpl"),
    ("This work is licensed under a Creative Commons Attribution License", "cc-by"),
    ("Licensed under CC BY 4.0", "cc-by"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc"),
    ("Licensed under CC BY-SA 4.0", "cc-by-sa"),
    (_MIT, "mit"),
    (_ISC, "isc"),
    (_BSD, "bsd"),
    (_APACHE, "apache"),
    (_GPL, "gpl"),
]

# Lower-case A-Z; what is neither a letter, a digit nor beyond ASCII separates words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def template_words(templates=TEMPLATES) -> set[bytes]:
    return {word for text, _ in templates for word in words(text)}


class Index:
    """Templates ready for the join: words in the global order, prefixes for each length of block, what each template needs."""

    def __init__(self, counts: dict[bytes, int], templates=TEMPLATES, threshold: float = THRESHOLD):
        ranked = sorted(template_words(templates), key=lambda word: (counts.get(word, 0), word))
        self.rank = {word: i for i, word in enumerate(ranked)}
        self.templates, self.prefixes = [], {}
        for number, (text, label) in enumerate(templates):
            ordered = sorted(set(words(text)), key=self.rank.__getitem__)
            needed = math.ceil(threshold * len(ordered) - 1e-9)
            self.templates.append((label, ordered, set(ordered), needed))
            prefixes = self.prefixes.setdefault(block_size(len(words(text))), {})
            for place, word in enumerate(ordered[: len(ordered) - needed + 1]):
                prefixes.setdefault(word, []).append((number, place))

    def of_block(self, block: list[bytes], size: int = BLOCK) -> list[tuple[int, float]]:
        """Templates for blocks of ``size`` words that the block holds, and how much of each."""
        own = sorted({word for word in block if word in self.rank}, key=self.rank.__getitem__)
        first, found = {}, []
        for at, word in enumerate(own):
            for number, place in self.prefixes[size].get(word, ()):
                first.setdefault(number, (at, place))
        for number, (at, place) in sorted(first.items()):
            _, ordered, whole, needed = self.templates[number]
            if len(own) < needed or 1 + min(len(own) - at, len(ordered) - place) - 1 < needed:
                continue
            shared = len(whole.intersection(own))
            if shared >= needed:
                found.append((number, shared / len(ordered)))
        return found

    def blocks(self, found: list[bytes]) -> list[tuple[int, int, int, float]]:
        """``template, first word, words, containment`` of every block that holds a template."""
        out = []
        for size, prefixes in sorted(self.prefixes.items()):
            if prefixes.keys().isdisjoint(found):
                continue
            step = size // 2
            last = max(0, -(-(len(found) - size) // step))
            hit = {min(max(k, 0), last) for i, word in enumerate(found) if word in prefixes for k in (i // step - 1, i // step)}
            for k in sorted(hit):
                block = found[k * step: k * step + size]
                out += [(number, k * step, len(block), much) for number, much in self.of_block(block, size)]
        return out


def block_size(n_words: int) -> int:
    """Length of the blocks for a template of so many words: at least twice that."""
    size = BLOCK
    while size < 2 * n_words:
        size *= 2
    return size


def base_places(found: list[bytes], phrases=PHRASES) -> list[tuple[str, int]]:
    """``label, first word`` of every place where a phrase's words stand."""
    line, out = None, []
    for text, label in phrases:
        phrase = b" " + b" ".join(words(text)) + b" "
        if line is None:
            line = b" " + b" ".join(found) + b" "
        at, counted, number = line.find(phrase), 0, 0
        while at >= 0:
            number += line.count(b" ", counted, at)
            counted = at
            out.append((label, number))
            at = line.find(phrase, at + 1)
    return out


def template_counts(documents: DataFrame, text_column: str = "text", templates=TEMPLATES) -> dict[bytes, int]:
    """How many documents have each word of the templates; a row a word reaches the driver."""
    wanted = template_words(templates)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = Counter()
        for batch in batches:
            for text in batch["_text"]:
                total.update(wanted.intersection(words(text)))
        yield pd.DataFrame({"word": list(total), "n": [int(n) for n in total.values()]}).astype({"word": object, "n": "int64"})

    rows = documents.select(F.col(text_column).alias("_text")).mapInPandas(count, "word binary, n bigint")
    return {bytes(r.word): r.n for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def license_blocks(
    documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD,
) -> DataFrame:
    """A row for each document: its words, base places and the blocks that hold a template."""
    small_batches(documents.sparkSession)
    index = Index(template_counts(documents, text_column, templates), templates, threshold)
    kind = documents.schema[id_column].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, places, blocks = [], [], []
            for text in batch["_text"]:
                found = words(text)
                sizes.append(len(found))
                has = text is not None and b"license" in found
                places.append([{"label": label, "word": at} for label, at in base_places(found)] if has else [])
                blocks.append([
                    {"label": index.templates[n][0], "template": templates[n][0], "word": at, "n_words": size, "containment": much}
                    for n, at, size, much in index.blocks(found)
                ])
            yield pd.DataFrame({id_column: batch["_id"], "n_words": sizes, "places": places, "blocks": blocks})

    return documents.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text")).mapInPandas(
        scan, f"{id_column} {kind}, n_words bigint, places array<struct<label:string,word:bigint>>, "
        "blocks array<struct<label:string,template:string,word:bigint,n_words:bigint,containment:double>>"
    )


def license_labels(blocks: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Labels and counts of each document from ``license_blocks``; a base phrase scores 1."""
    base = F.array_sort(F.array_distinct(F.col("places.label")))
    both = F.array_sort(F.array_distinct(F.concat("places.label", "blocks.label")))
    score = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("blocks.containment"), F.lit(0.0)))
    return blocks.select(
        id_column, "n_words", F.size("places").cast("bigint").alias("n_base"),
        F.array_min("places.word").alias("first_word"), F.array_max("places.word").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), score.alias("score"),
    )
