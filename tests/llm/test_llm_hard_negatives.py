"""Hard negatives against plain Python; Strassen's products against the schoolbook's."""

import random

import numpy as np
import pytest

from compare import compare, duck
from gistmill.llm import catalogue
from gistmill.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, label int, vector array<bigint>, tile string, score string, stripe string, row string, id string"


def brute(rows, every, positives=5, negatives=10):
    """Result rows for ``(vec_id, label, vector)``, each row on its own."""
    use = [(i, l, v) for i, l, v in rows if i is not None and l is not None and v is not None and None not in v]
    out = []
    for k, (anchor, label, vector) in enumerate(use):
        if anchor % every:
            continue
        scored = [(-sum(x * y for x, y in zip(vector, w)), i, l) for j, (i, l, w) in enumerate(use) if j != k]
        for ps, pid, _ in sorted(s for s in scored if s[2] == label)[:positives]:
            fit = sorted(s for s in scored if s[2] != label and 30 * -ps <= 100 * -s[0] <= 90 * -ps)
            out += [(anchor, pid, rank, i, -ps, -ns) for rank, (ns, i, _) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, every, **options):
    frame = spark.createDataFrame([(i, l, v, *["x"] * 5) for i, l, v in rows], SCHEMA).repartition(5)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r[n] for n in names) for r in hn.hard_negatives(frame, every=every, **options).collect())


@pytest.mark.parametrize("shape", [(1, 1, 1), (2, 2, 2), (7, 5, 9), (33, 64, 70), (65, 3, 130), (40, 0, 4)])
def test_strassen(shape):
    draw = np.random.default_rng(3)
    a, b = draw.integers(-2**20, 2**20, shape[:2]), draw.integers(-2**20, 2**20, shape[1:])
    for leaf in (1, 4, 32):
        assert np.array_equal(hn.strassen(a, b, leaf), a @ b)


def test_strassen_is_exact_where_its_sums_overflow():
    a = np.full((8, 8), 2**30 - 1)
    a[1::2] *= -1
    assert np.array_equal(hn.strassen(a, a.T.copy(), 1), (a.astype(object) @ a.T.astype(object)).astype(np.int64))


def test_heaps_merge_in_any_order():
    draw = random.Random(2)
    rows = [(draw.randrange(4), draw.randrange(6), draw.randrange(50), k) for k in range(300)]
    expected = sorted(r for o in range(4) for r in sorted((r for r in rows if r[0] == o), key=lambda r: (-r[1], r[2], r[3]))[:7])
    for size in (1, 17, 300):
        heaps = hn.Heaps(4, 7)
        draw.shuffle(rows)
        for at in range(0, 300, size):
            heaps.push(*(np.array(column) for column in zip(*rows[at: at + size])))
        assert sorted(zip(*(c.tolist() for c in (heaps.owner, heaps.score, heaps.id, heaps.row)))) == expected


@pytest.mark.parametrize("most", [9, 2**15, 2**28])
def test_floats_hold_every_sum(most):
    draw = np.random.default_rng(5)
    for m, k, n in ((70, 64, 90), (64, 65, 33), (9, 300, 5)):
        a, b = draw.choice([-most, most], (m, k)), draw.choice([-most, most], (k, n))
        kind = hn._exact(m, k, n, most, most)
        assert kind == {9: np.float32, 2**15: np.float64, 2**28: np.int64}[most]
        assert np.array_equal(hn.strassen(a.astype(kind), b.astype(kind)).astype(np.int64), a @ b)


@pytest.mark.parametrize("most", [2, 300, 2**28])
@pytest.mark.parametrize("others", [True, False])
def test_heaps_of_an_anchor_tile(most, others):
    draw = np.random.default_rng(6)
    vectors, candidates = draw.integers(-most, most, (5, 3)), draw.integers(-most, most, (4000, 3))
    ids, rows = draw.integers(0, 900, 4000), np.arange(4000)
    own, place = np.array([3, 17, 1200, 3999, -1]), np.array([0, 0, 0, 2, 2, 3, 4])
    middle = np.abs(vectors[place]).sum(axis=1) * most // 3
    lower, upper = middle // 4 * np.array([-9, 0, 1, 1, -1, 2, 9]), middle * np.array([2, 1, 1, 1, 0, 3, 1])
    tile = hn._Anchors(own, vectors, place, lower, upper, 6)
    for at in range(0, 4000, 250):
        part = slice(at, at + 250)
        tile.meet(ids[part], rows[part], {np.int64: candidates[part]}, hn._top(candidates[part]), others)
    tile.settle()
    expected = []
    for k, i in enumerate(place):
        scores = candidates @ vectors[i]
        fit = sorted((-s, d, r) for s, d, r in zip(scores.tolist(), ids.tolist(), rows.tolist())
                     if lower[k] <= s <= upper[k] and (others or r != own[i]))
        expected += [(k, -s, d, r) for s, d, r in fit[:6]]
    heaps = tile.heaps
    assert len(expected) > 20 and sorted(zip(*(c.tolist() for c in (heaps.owner, heaps.score, heaps.id, heaps.row)))) == sorted(expected)


@pytest.mark.parametrize("bundle", [3, 11])
def test_cells_of_bundles_and_stripes(spark, monkeypatch, bundle):
    for name, value in (("TILE", 16), ("ANCHOR_TILE", 2), ("BUNDLE", bundle), ("STRIPES", 3)):
        monkeypatch.setattr(hn, name, value)
    draw = random.Random(7)
    rows = [(i, draw.choice([0, 0, 1, 2**30]), [draw.randint(-4, 9) for _ in range(5)]) for i in range(200)]
    assert mined(spark, rows, 10) == brute(rows, 10) != []


def test_tiles_are_not_joined_or_broadcast(spark):
    frame = spark.createDataFrame([(i, i % 2, [i, 1], *["x"] * 5) for i in range(50)], SCHEMA)
    plan = hn.hard_negatives(frame, every=10)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "Broadcast" not in plan


def test_against_brute_force(spark):
    draw = random.Random(4)
    rows = [(i, draw.choice([0, 0, 0, 1, 2]), [draw.randint(-4, 9) for _ in range(6)]) for i in range(500)]
    rows += [(500, 9, [1] * 6), (501, 1, [3, 1]), (502, 2, []), (503, 0, [5] * 9), (7, 1, [1] * 6), (40, 0, [2] * 6), (40, 0, [2] * 6)]
    rows += [(None, 1, [1] * 6), (504, None, [1] * 6), (505, 1, None), (506, 1, [1, None, 1, 1, 1, 1]), (508, 0, [2**40] + [0] * 5)]
    expected = brute(rows, 20)
    assert len(expected) > 500 and mined(spark, rows, 20) == expected


@pytest.mark.parametrize("tile", [3, 512])
def test_ties_and_one_hot_vector(spark, monkeypatch, tile):
    monkeypatch.setattr(hn, "TILE", tile)
    monkeypatch.setattr(hn, "ANCHOR_TILE", 2)
    rows = [(i, int(i % 3 == 0), [[3, 3, 3], [1, 1, 1], [2, 1, 0], [1, 1, 1]][i % 4]) for i in range(90)]
    assert mined(spark, rows, 10) == brute(rows, 10) != []


def test_nothing(spark):
    assert mined(spark, [], 10) == []
    assert mined(spark, [(1, 0, [1]), (2, 1, [1])], 10) == []


def test_unusable_components_take_no_part(spark):
    vectors = [[0.5, -0.001], [float("nan"), 1.0], [float("inf"), 1.0], [None, 1.0], None, []]
    frame = spark.createDataFrame([(v,) for v in vectors], "v array<float>")
    got = [r.v for r in frame.select(hn.integer_vector(frame.v).alias("v")).collect()]
    assert got == [[128, -1], None, None, None, None, []]


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    assert compare(spark, duck(folder), folder, catalogue.op11_hard_negatives, catalogue.SQLS["op11_hard_negatives"]) is None
