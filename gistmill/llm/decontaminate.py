"""Benchmark decontamination: an FM-index for each training shard, searched for test phrases.

Tasks cut their documents into shards of about ``SHARD`` words (a longer document gives
pieces that overlap by a window less a word) and build an FM-index over the words of each:
the index, its vocabulary and its list of documents are a row of a written table, so a lost
executor loses no index and one build serves any number of benchmarks.

A window is ``WINDOW`` consecutive words of an item; an item of fewer is one window.  Items
are cut into pieces of bounded size and go in blocks of about ``BLOCK`` words, so what a task
holds of them does not grow with the benchmark.  For each block every index is searched
backward through the ranks of its wavelet tree for all windows at once; the suffixes found
are walked back to sampled positions; spans that touch are merged inside the shard, and
then once more where a document has several pieces or blocks.

Defined results: null, empty and wordless texts have no words and no hit; repeated document
rows give a row each; rows with the same item id are one item; a null item id counts as an item
and reads as an empty string in the hash; items without words have no window; an empty
benchmark leaves every document clean; no documents give no rows; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gistmill.llm.common import small_batches
from gistmill.llm.fm_index import FmIndex
from gistmill.llm.licenses import words
from gistmill.session import staged

#: Words of a window, of a shard, of a piece of an item, of a block of items.
WINDOW, SHARD, PIECE, BLOCK = 10, 1 << 20, 1 << 14, 1 << 20

#: Documents of a shard, so that a shard of empty ones is bounded as well.
MOST_DOCUMENTS = 1 << 16

#: Occurrences walked back at a time.
WALK = 1 << 19


class _Vocabulary(dict):
    """Numbers words from 1 in the order in which they are first seen."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + 1
        return number


class _Shard:
    def __init__(self):
        self.vocabulary, self.symbols, self.size, self.pieces = _Vocabulary(), [], 0, []

    def add(self, found: list[bytes], row: int, ident, first: int, total: int) -> None:
        self.pieces.append((row, ident, first, total, self.size))
        self.symbols.append(np.fromiter(map(self.vocabulary.__getitem__, found), np.int64, len(found)))
        self.symbols.append(np.zeros(1, dtype=np.int64))
        self.size += len(found) + 1

    def full(self, shard: int) -> bool:
        return self.size >= shard or len(self.pieces) >= MOST_DOCUMENTS

    def row(self, schema: pa.Schema) -> pa.RecordBatch:
        index = FmIndex.build(np.concatenate(self.symbols), len(self.vocabulary) + 1)
        row, ident, first, total, start = zip(*self.pieces)
        values = {"n": index.n, "vocabulary": b"\n".join(self.vocabulary), "row": row, "id": ident, "first": first,
                  "total": total, "start": start, **index.to_bytes()}
        return pa.RecordBatch.from_arrays([pa.array([values[f.name]], f.type) for f in schema], schema=schema)


def index_shards(
    documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, shard: int = SHARD,
) -> DataFrame:
    """A written table of FM-indexes: one row a shard, with its pieces ``row, id, first, total, start``."""
    small_batches(documents.sparkSession)
    kind = documents.schema[id_column].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, schema = TaskContext.get().partitionId() << 36, _Shard(), None
        for batch in batches:
            if schema is None:
                own = batch.schema.field(0).type
                schema = pa.schema([
                    ("n", pa.int64()), ("vocabulary", pa.binary()), ("counts", pa.binary()), ("levels", pa.binary()),
                    ("marks", pa.binary()), ("positions", pa.binary()), ("row", pa.list_(pa.int64())), ("id", pa.list_(own)),
                    ("first", pa.list_(pa.int64())), ("total", pa.list_(pa.int64())), ("start", pa.list_(pa.int64())),
                ])
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = words(text.as_py())
                for first in range(0, max(len(found), 1), shard):
                    held.add(found[first: first + shard + window - 1], number, ident, first, len(found))
                    if held.full(shard):
                        yield held.row(schema)
                        held = _Shard()
                number += 1
        if held.pieces:
            yield held.row(schema)

    return staged(documents.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text")).mapInArrow(
        build, "n bigint, vocabulary binary, counts binary, levels binary, marks binary, positions binary, row array<bigint>, "
        f"id array<{kind}>, first array<bigint>, total array<bigint>, start array<bigint>"
    ), "decontaminate-index")


def item_pieces(benchmark: DataFrame, item_column: str = "item_id", text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """``item, words, size``: items in pieces of at most ``PIECE`` windows, joined by spaces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = words(text.as_py())
                for first in range(0, max(len(found) - window + 1, min(len(found), 1)), PIECE):
                    piece = found[first: first + PIECE + window - 1]
                    out.append((item, b" ".join(piece), len(piece)))
            yield pa.RecordBatch.from_arrays([
                pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.int64()),
            ], names=["item", "words", "size"])

    return benchmark.select(F.col(item_column).cast("string").alias("_item"), F.col(text_column).alias("_text")).mapInArrow(
        cut, "item string, words binary, size bigint"
    )


class Phrases:
    """The different windows of a block of items, and the items that have each."""

    def __init__(self, pieces: list[tuple[str | None, bytes]], window: int = WINDOW):
        vocabulary, rows, owners = _Vocabulary(), [], []
        for number, (_, joined) in enumerate(pieces):
            ids = np.fromiter(map(vocabulary.__getitem__, joined.split()), np.int64)
            ids = np.concatenate([np.zeros(max(window - len(ids), 0), dtype=np.int64), ids])
            rows.append(np.lib.stride_tricks.sliding_window_view(ids, window))
            owners.append(np.full(len(rows[-1]), number))
        self.items, self.vocabulary = [item for item, _ in pieces], dict(vocabulary)
        self.windows, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.ravel(), np.concatenate(owners)], axis=1), axis=0)
        self.first_owner, self.owners = np.searchsorted(pairs[:, 0], np.arange(len(self.windows) + 1)), pairs[:, 1]
        self.lengths = (self.windows > 0).sum(axis=1)

    def of_index(self, known: list[bytes]) -> np.ndarray:
        """The windows in the numbers of an index; -1 for words that it does not have."""
        own = np.full(len(self.vocabulary) + 1, -1, dtype=np.int64)
        own[0] = 0
        for number, word in enumerate(known, 1):
            if word in self.vocabulary:
                own[self.vocabulary[word]] = number
        return own[self.windows]


def _found(index: FmIndex, phrases: Phrases, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position and window of every occurrence, in no order."""
    low, high = index.search(patterns)
    hits = np.flatnonzero(low < high)
    sizes = (high - low)[hits]
    window = np.repeat(hits, sizes)
    at = np.arange(len(window)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low[hits], sizes)
    located = [index.locate(at[i: i + WALK]) for i in range(0, len(at), WALK)]
    return np.concatenate([np.zeros(0, dtype=np.int64), *located]), window


def merged_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that touch or overlap as one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.r_[True, starts[1:] > reach[:-1]])
    return starts[new], reach[np.r_[new[1:] - 1, len(reach) - 1]]


def find_phrases(index: DataFrame, phrases: Phrases) -> DataFrame:
    """``row, items, starts, ends``: for each piece with a hit the items and the merged spans of document words."""
    sent = index.sparkSession.sparkContext.broadcast(phrases)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                known = shard["vocabulary"].split(b"\n") if shard["vocabulary"] else []
                own = FmIndex.from_bytes(shard["n"], len(known) + 1, shard)
                positions, window = _found(own, sent.value, sent.value.of_index(known))
                yield _by_piece(shard, sent.value, positions, window)

    return index.select("n", "vocabulary", "counts", "levels", "marks", "positions", "row", "first", "start").mapInArrow(
        search, "row bigint, items array<string>, starts array<bigint>, ends array<bigint>"
    )


def _by_piece(shard: dict, phrases: Phrases, positions: np.ndarray, window: np.ndarray) -> pa.RecordBatch:
    start = np.array(shard["start"])
    starts, ends = merged_spans(positions, positions + phrases.lengths[window])
    span_piece = np.searchsorted(start, starts, side="right") - 1
    pairs = np.unique(np.stack([np.searchsorted(start, positions, side="right") - 1, window], axis=1), axis=0)
    many = phrases.first_owner[pairs[:, 1] + 1] - phrases.first_owner[pairs[:, 1]]
    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(phrases.first_owner[pairs[:, 1]], many)
    owned = np.unique(np.stack([np.repeat(pairs[:, 0], many), phrases.owners[place]], axis=1), axis=0)
    pieces, out = np.unique(span_piece), []
    for piece in pieces.tolist():
        spans = slice(*np.searchsorted(span_piece, [piece, piece + 1]))
        items = owned[slice(*np.searchsorted(owned[:, 0], [piece, piece + 1])), 1]
        shift = shard["first"][piece] - shard["start"][piece]
        names = sorted({phrases.items[i] or "" for i in items.tolist()})
        out.append((shard["row"][piece], names, starts[spans] + shift, ends[spans] + shift))
    return pa.RecordBatch.from_arrays([
        pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.list_(pa.string())),
        pa.array([o[2] for o in out], pa.list_(pa.int64())), pa.array([o[3] for o in out], pa.list_(pa.int64())),
    ], names=["row", "items", "starts", "ends"])


def contamination(index: DataFrame, pieces: DataFrame, *, window: int = WINDOW, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Of the documents in ``index`` with a hit: ``row, items``, and removal spans ``row, start, end``."""
    pieces = staged(pieces, "decontaminate-items")
    blocks = max(-(-(pieces.agg(F.sum("size")).first()[0] or 0) // block), 1)
    dealt = pieces.distinct().withColumn("block", F.pmod(F.xxhash64("words"), F.lit(blocks)))
    hits = None
    for number in range(blocks):
        held = [(r.item, bytes(r.words)) for r in dealt.where(F.col("block") == number).collect()]
        if held:
            found = staged(find_phrases(index, Phrases(held, window)), "decontaminate-hits")
            hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = index.sparkSession.createDataFrame([], "row bigint, items array<string>, starts array<bigint>, ends array<bigint>")
    items = hits.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    spans = hits.select("row", F.explode(F.arrays_zip("starts", "ends")).alias("s")).select("row", F.col("s.starts").alias("start"), F.col("s.ends").alias("end"))
    order = Window.partitionBy("row").orderBy("start")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.sum(F.when(F.col("start") <= F.col("_reach"), 0).otherwise(1)).over(order)
    merged = spans.withColumn("_reach", reach).withColumn("_span", new).groupBy("row", "_span").agg(
        F.min("start").alias("start"), F.max("end").alias("end")
    ).drop("_span")
    return items, merged


def benchmark_hits(
    documents: DataFrame, benchmark: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id",
    item_text_column: str = "text", window: int = WINDOW, shard: int = SHARD, block: int = BLOCK,
) -> DataFrame:
    """A row for each document: words, words hit, items with a window in it, and whether there are any."""
    index = index_shards(documents, id_column=id_column, text_column=text_column, window=window, shard=shard)
    items, spans = contamination(index, item_pieces(benchmark, item_column, item_text_column, window), window=window, block=block)
    hit = spans.groupBy("row").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"))
    whole = index.select(F.explode(F.arrays_zip("row", "id", "first", "total")).alias("d")).where("d.first = 0").select(
        F.col("d.row").alias("row"), F.col("d.id").alias("_id"), F.col("d.total").alias("n_words")
    )
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return whole.join(hit.join(items, "row"), "row", "left").select(
        F.col("_id").alias(id_column), "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.size(listed).cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", listed), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def benchmark_hits_sql(window: int = WINDOW) -> str:
    """The same for tables ``documents`` and ``benchmark``, for ids that differ."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    found = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
    WITH d AS (SELECT doc_id, {found} AS w FROM documents), b AS (SELECT item_id, {found} AS w FROM benchmark),
    long AS (SELECT DISTINCT item_id, array_to_string(w[i + 1:i + {window}], ' ') AS p, {window} AS n
      FROM (SELECT item_id, w, unnest(range(len(w) - {window - 1})) AS i FROM b WHERE len(w) >= {window})),
    short AS (SELECT DISTINCT item_id, array_to_string(w, ' ') AS p, len(w) AS n FROM b WHERE len(w) BETWEEN 1 AND {window - 1}),
    windows AS (SELECT * FROM long UNION ALL SELECT * FROM short),
    sizes AS (SELECT DISTINCT n FROM windows),
    places AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + n], ' ') AS p
      FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM d CROSS JOIN sizes WHERE len(w) >= n)),
    hits AS (SELECT doc_id, i, n, item_id FROM places JOIN windows USING (n, p)),
    spans AS (SELECT DISTINCT doc_id, i, n FROM hits),
    hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM spans) GROUP BY 1),
    items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
    SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
      CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""
