"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest

import edge
from compare import compare, duck
from gistmill.llm import catalogue, spelling


def counted(documents, one_in=97):
    counts = Counter()
    for ident, text in documents:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                counts[run] += 1
    return {word: n for word, n in counts.items() if n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and (a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:])


def brute(counts):
    out, form = {}, {}
    for word, n in counts.items():
        near = [w for w in counts if abs(len(w) - len(word)) < 2 and one_edit(w, word)]
        best = min(near, key=lambda w: (-counts[w], w), default=None)
        form[word] = best if best and counts[best] >= 2 * n else None
        out[word] = (n, len(near), form[word], counts[form[word]] if form[word] else None)
    for word, row in out.items():
        root = word
        while form[root]:
            root = form[root]
        out[word] = (*row, root)
    return out


def as_dict(frame):
    rows = frame.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


def family(draw, letters, sizes, n):
    words = {}
    for _ in range(n):
        word = "".join(draw.choice(letters) for _ in range(draw.choice(sizes)))
        words[word] = draw.choice([3, 4, 7, 20, 90])
    return words


@pytest.mark.parametrize("hot", [1, 3, 256])
@pytest.mark.parametrize("letters, sizes", [("ab", [5, 6, 7]), ("abcdefgß÷", [5, 6]), ("aé", [9, 10, 11])])
def test_forms(spark, letters, sizes, hot):
    words = family(random.Random(len(letters)), letters, sizes, 150)
    frame = spark.createDataFrame(list(words.items()), "word string, n bigint").repartition(3)
    assert as_dict(spelling.spelling_forms(frame, hot)) == brute(words)


def test_chunk_of_many_words(spark):
    """A third of all words share their first half; all of them their last letters."""
    draw = random.Random(1)
    words = {("station" if k % 3 else "") + "".join(draw.choice("aeinrst") for _ in range(5)) + "ingen": 3 + k % 9 for k in range(600)}
    frame = spark.createDataFrame(list(words.items()), "word string, n bigint")
    for hot in (8, 100_000):
        assert as_dict(spelling.spelling_forms(frame, hot)) == brute(words)


def test_long_chain_of_forms(spark):
    words = {"a" * 4 + "b" * k: 3 * 2**k for k in range(1, 20)} | {"tower": 5, "towre": 4}
    got = as_dict(spelling.spelling_forms(spark.createDataFrame(list(words.items()), "word string, n bigint")))
    assert got == brute(words) and got["aaaab"][-1] == "a" * 4 + "b" * 19


def test_whole_texts(spark):
    draw = random.Random(6)
    words = "station stations statiön straße STRASSE strasse élève éleve number numbers nubmer x÷y×zzz abcde".split()
    rows = edge.rows() * 3 + [
        (200 + i, draw.choice([" ", "\n", "1", "日"]).join(draw.choice(words) for _ in range(40)), None, None, 0, *["x"] * 8) for i in range(30)
    ]
    for one_in in (97, 5, 1):
        got = as_dict(spelling.spelling_variants(edge.documents(spark, rows), one_in=one_in))
        expected = brute(counted([(r[0], r[1]) for r in rows], one_in))
        assert len(expected) > 10 and got == expected


def test_nothing(spark):
    assert spelling.spelling_variants(edge.documents(spark, [])).collect() == []


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    documents = duck(folder).execute("SELECT doc_id, text FROM documents").fetchall()
    assert as_dict(catalogue.op13_spelling(spark, folder)) == brute(counted(documents))
