"""SimHash groups, vector links, spot signatures, components: against brute force."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

import edge
from gistmill.llm import components, embeddings, simhash, spotsigs


def test_triples_meet_any_four_positions():
    chosen = [set(t) for t in simhash.byte_triples()]
    assert len(chosen) == 20
    assert all(any(t <= set(four) for t in chosen) for four in combinations(range(8), 4))


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i: i + 4]) for i in range(max(len(words) - 3, 1))]
    hashes = [xxhash.xxh64_intdigest(run.encode(), seed=42) for run in runs]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    for _, text, *_ in edge.rows():
        assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("part", [1024, 8])
def test_near_fingerprints(spark, part):
    draw = random.Random(4)
    prints = {0, 2**64 - 1}
    for _ in range(25):
        seed = draw.getrandbits(64)
        for _ in range(draw.choice([1, 1, 2, 40])):
            prints.add(seed)
            for _ in range(draw.randint(0, 5)):
                prints.add(seed ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 5))))
            seed ^= 1 << draw.randrange(64)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "print bigint").repartition(3)
    roots = {r.node: r.root for r in components.components(simhash.near_fingerprints(frame, part=part)).collect()}
    linked = [(a, b) for a, b in combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    expected = edge.components(signed, linked)
    assert {p: roots.get(p, p) for p in signed} == expected


def test_simhash_groups(spark):
    got = simhash.simhash_groups(edge.documents(spark)).collect()
    rows = [(i, plain_fingerprint(t)) for i, t, *_ in edge.rows()]
    linked = [(a, b) for a, b in combinations(range(len(rows)), 2) if (rows[a][1] ^ rows[b][1]).bit_count() <= 4]
    group = edge.components(range(len(rows)), linked)
    smallest = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            smallest[group[k]] = min(i, smallest.get(group[k], i))
    expected = [(i, f"{p:016x}", smallest.get(group[k])) for k, (i, p) in enumerate(rows)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
    kept = simhash.one_of_each_group(edge.documents(spark))
    assert kept.columns == edge.documents(spark).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(smallest.get(g)) for g in set(group.values()))
    assert simhash.simhash_groups(edge.documents(spark, [])).collect() == []


def test_components(spark):
    draw = random.Random(6)
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(draw.randrange(300, 400), draw.randrange(300, 400)) for _ in range(60)]
    links += [(5, 5), (1, 0)]
    proper = [(a, b) for a, b in links if a != b]
    frame = spark.createDataFrame(links + [(None, 3)], "a bigint, b bigint")
    nodes = sorted({n for a, b in links if a != b for n in (a, b)})
    assert {r.node: r.root for r in components.components(frame).collect()} == edge.components(nodes, proper)
    a, b = components.spanning(*map(np.array, zip(*links)))
    assert edge.components(nodes, zip(a.tolist(), b.tolist())) == edge.components(nodes, proper) and len(a) < len(nodes)


def test_rotation_keeps_distances():
    turn = embeddings.rotation(24)
    assert np.allclose(turn @ turn.T, np.eye(24))


@pytest.mark.parametrize("part, blocks", [(2048, 4), (16, 4), (2048, 8), (2048, 1)])
def test_embedding_links(spark, part, blocks):
    draw = np.random.default_rng(2)
    base = draw.standard_normal((12, 16))
    vectors = [(b + draw.standard_normal(16) * s).tolist() for b in base for s in [0.02, 0.05, 0.1, 0.15] * (25 if b is base[0] else 2)]
    rows = [(i, v, int(i % 17 == 0)) for i, v in enumerate(vectors)]
    n = len(rows)
    rows += [(n, vectors[3], 0), (n + 1, vectors[3], 0), (n + 2, [2 * x for x in vectors[3]], 0), (n + 3, vectors[3], None)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [1.0, 2.0], [5.0]]
    rows += [(n + 4 + k, v, 0) for k, v in enumerate(odd)]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id bigint, embedding array<double>, label int, cls string, n_links string")
    got = {r.vec_id: r for r in embeddings.embedding_links(frame.repartition(3), part=part, blocks=blocks).collect()}
    good = [r for r in rows if r[1] and r[2] is not None and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])]

    def cosine(x, y):
        x, y = np.array(x), np.array(y)
        return x @ y / np.linalg.norm(x) / np.linalg.norm(y)

    linked = [(a[0], b[0]) for a, b in combinations(good, 2) if a[2] == b[2] and len(a[1]) == len(b[1]) and cosine(a[1], b[1]) >= 0.98]
    group = edge.components([r[0] for r in rows], linked)
    for i, *_ in rows:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (sum(i in pair for pair in linked), group[i], group[i] == i)
    assert len(got) == len(rows) and len(linked) > 200


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert embeddings.embedding_links(none).collect() == []


def spots(text):
    words = re.sub(r"[^\w]|_", " ", (text or "").lower()).split()
    tied, before = [], []
    for word in words:
        if word in spotsigs.ANCHORS:
            before.append(word)
        else:
            tied.append((tuple(before), word))
            before = []
    tied += [(tuple(before), "")] if before else []
    anchored = any(anchors for anchors, _ in tied)
    return {(anchors, word, tied[i + 1][1] if i + 1 < len(tied) else "") for i, (anchors, word) in enumerate(tied) if anchors or not anchored}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edited_fingerprints(spark):
    got = spotsigs.edited_fingerprints(edge.documents(spark)).collect()
    rows = sorted(((i, t or "") for i, t, *_ in edge.rows()), key=lambda r: (r[0] is not None, r[0] or 0))
    different = [r for k, r in enumerate(rows) if k == 0 or r != rows[k - 1]]
    assert len(got) == len(rows)
    for r in got:
        k = next(k for k, (i, _) in enumerate(different) if i == r.doc_id)
        text, after = different[k][1], different[(k + 1) % len(different)][1]
        edited = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(text)
        assert r.near_edited == pytest.approx(jaccard(spots(text), spots(edited)), abs=0.01)
        assert r.near_next == pytest.approx(jaccard(spots(text), spots(after)), abs=0.01)
        assert len(r.fingerprint) == 8 * len(spots(text))
    same = {r.fingerprint for r in got if r.doc_id in (1, 6)}
    assert len(same) == 1
    assert spotsigs.edited_fingerprints(edge.documents(spark, [])).collect() == []


def test_near_pairs(spark):
    base = edge.text_of(9, 300).split()
    draw, texts = random.Random(1), []
    for k in range(12):
        words = list(base)
        for _ in range(k * 2):
            words[draw.randrange(len(words))] = f"other{draw.randrange(9)}"
        texts.append(" ".join(words))
    texts += [edge.text_of(20 + k, 200) for k in range(5)] + [texts[0]]
    rows = [(i, t, None, None, 0, *["x"] * 8) for i, t in enumerate(texts)]
    pairs, members = spotsigs.near_pairs(edge.documents(spark, rows), least=0.7)
    prints = {r.doc_id: r.fingerprint for r in members.collect()}
    assert prints[0] == prints[len(texts) - 1]
    got = {frozenset((r.a, r.b)) for r in pairs.collect()}
    expected = {
        frozenset((prints[a], prints[b])) for a, b in combinations(range(len(texts)), 2)
        if prints[a] != prints[b] and jaccard(spots(texts[a]), spots(texts[b])) >= 0.7
    }
    assert got == expected and len(got) > 10
