"""Encoder, token counts, id files, packing: against the library and plain Python."""

import math
import random
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow.fs as fs
import pytest
import public_tokenizers

import edge
from gistmill.llm import packing, token_counts, token_files
from gistmill.llm.encoding import Encoder, load

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LETTERS = "ab'sre  \n\t éßÀ12_-—<|>.,!?'ll'dX  ²ªʼnŉıİ\x1c ſKœ日😀"


def library_ids(path, texts):
    return [one.ids for one in load(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_equals_library(path):
    draw = random.Random(5)
    texts = ["".join(draw.choice(LETTERS) for _ in range(draw.randint(0, 60))) for _ in range(4000)]
    texts += ["", "<|endoftext|>a", "a  <|startoftext|>", " " * 50 + "b", "\r\n\r\n x", "y" * 500, *[t or "" for _, t, *_ in edge.rows()]]
    encoder = Encoder(path)
    for _ in range(2):  # the second time from memory
        assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode(texts)] == library_ids(path, texts)


@pytest.mark.parametrize("chunk, overlap", [(65_536, 512), (64, 32), (200, 40)])
def test_token_counts(spark, chunk, overlap):
    got = token_counts.token_counts(edge.documents(spark), BYTES, limit=50, chunk=chunk, overlap=overlap).collect()
    texts = [(i, t or "") for i, t, *_ in edge.rows()]
    expected = [(i, len(t.encode()), len(ids), len(ids) > 50) for (i, t), ids in zip(texts, library_ids(BYTES, [t for _, t in texts]))]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))


def test_chunks_splice_at_stable_places_only(spark):
    draw = random.Random(8)
    alphabet = ["the", " ", "  ", "\n\n", "don't", "'re", "<|endoftext|>", "<|endof", "text|>", "ab" * 20, " 123", "é", "!!", "日本"]
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randint(30, 300))) for _ in range(150)]
    rows = [(i, t, None, None, 0, *["x"] * 8) for i, t in enumerate(texts)]
    got = token_counts.token_counts(edge.documents(spark, rows), BYTES, chunk=50, overlap=20).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(ids) for i, ids in enumerate(library_ids(BYTES, texts))}


def test_no_documents(spark):
    none = edge.documents(spark, [])
    assert token_counts.token_counts(none, BYTES).collect() == []
    assert token_files.token_files(none, BYTES, end_id=2).collect() == []
    assert packing.pack_documents(none, WORDS).collect() == []


@pytest.mark.parametrize("bits", [False, True])
def test_planes_there_and_back(tmp_path, bits):
    draw = np.random.default_rng(1)
    for n in (1, 7, 8, 1000):
        ids = draw.integers(0, 2**32, n, dtype=np.uint32)
        assert np.array_equal(token_files.from_planes(token_files.to_planes(ids, bits), n, bits), ids)
    path, documents = str(tmp_path / "x.planes"), [draw.integers(0, 50_000, n).astype("<u4") for n in (3, 0, 500, 64, 1, 130)]
    store = fs.LocalFileSystem()
    with store.open_output_stream(path) as out:
        writer = token_files.PlaneWriter(out, block=64, bits=bits)
        for number, ids in enumerate(documents):
            writer.add(number, ids)
        writer.close()
    with store.open_input_file(path) as file:
        reader, start = token_files.PlaneReader(file), 0
        assert len(reader.blocks) == math.ceil(sum(map(len, documents)) / 64)
        for (number, n), ids in zip(reader.documents, documents):
            assert np.array_equal(np.concatenate([*reader.read(start, n), np.zeros(0, "<u4")]), ids)
            start += n
    (tmp_path / "cut.planes").write_bytes(open(path, "rb").read()[:-3])
    with store.open_input_file(str(tmp_path / "cut.planes")) as file, pytest.raises(ValueError):
        token_files.PlaneReader(file)


def test_token_files(spark):
    got = token_files.token_files(edge.documents(spark), BYTES, end_id=2, block=100, files=3).collect()
    texts = [(i, t or "") for i, t, *_ in edge.rows()]
    ids = [(i, [*x, 2]) for (i, _), x in zip(texts, library_ids(BYTES, [t for _, t in texts]))]
    ids.sort(key=lambda x: (x[0] is not None, x[0] or 0))
    expected, start = [], 0
    for i, x in ids:
        expected.append((i, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))


def check_places(rows, length):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= length
    return len(by)


def best_fit(sizes, length):
    gaps, n = [], 0
    for size in sorted(sizes, reverse=True):
        i = bisect_left(gaps, size)
        if i == len(gaps):
            n += 1
            insort(gaps, length - size)
        else:
            insort(gaps, gaps.pop(i) - size)
    return n


def test_pack_documents(spark):
    length = 256
    got = packing.pack_documents(edge.documents(spark), WORDS, length=length).collect()
    texts = [(i, t or "") for i, t, *_ in edge.rows()]
    expected = []
    for (i, _), x in zip(texts, library_ids(WORDS, [t for _, t in texts])):
        x = [*x, 0]
        for piece, at in enumerate(range(0, len(x), length)):
            part = x[at: at + length]
            expected.append((i, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got) == sorted(map(repr, expected))
    assert check_places(got, length) <= best_fit([e[3] for e in expected], length) + 1


@pytest.mark.parametrize("sizes", [
    lambda d: d.randint(1, 100), lambda d: d.choice([10, 10, 10, 90]), lambda d: 7, lambda d: d.randint(1, 6), lambda d: d.choice([50, 51, 100]),
])
@pytest.mark.parametrize("range_rows", [50_000, 150])
def test_packing_is_near_best_fit(spark, monkeypatch, sizes, range_rows):
    monkeypatch.setattr(packing, "RANGE_ROWS", range_rows)
    draw = random.Random(3)
    lengths = [sizes(draw) for _ in range(600)]
    got = packing.pack(spark.createDataFrame(list(enumerate(lengths)), "doc_id bigint, length bigint"), 100).collect()
    assert sorted((r.doc_id, r.length) for r in got) == list(enumerate(lengths))
    assert check_places(got, 100) <= best_fit(lengths, 100) * 1.05 + 2


def test_ranges_match_like_brackets():
    spans = packing.match_ranges([(0, 1, 3, 5), (1, 2, 0, 8), (2, 3, 1, 9)], 10, free=0, placed=0)
    matched = {}
    for kind, part, low, high, rank, does in spans:
        for k in range(low, high):
            if does == "match":
                matched.setdefault(rank + (k - low if kind == "piece" else high - 1 - k), {})[kind] = (part, k)
    assert {(m["piece"], m["gap"]) for m in matched.values()} == {((1, 0), (0, 2)), ((1, 1), (0, 1)), ((2, 0), (0, 0))}
