"""Digest texts in parts of bounded length."""

import random

import pytest
from pyspark.sql import functions as F

from gistmill.operators import cuts, digest as dg
from gistmill.plans import queries as catalogue
from gistmill.sources.digest_text import import_digest

FOLDER = "/root/testdata/sf0.001"


def expected_parts(lines, part_bytes):
    """``{(corpus, part): text}`` by adding up lengths in order."""
    texts, at, numbers = {}, {}, {}
    for corpus, path, value in sorted(lines):
        multiple = at.get(corpus, 0) // part_bytes
        number = numbers.setdefault(corpus, {}).setdefault(multiple, len(numbers[corpus]))
        texts[corpus, number] = texts.get((corpus, number), "") + value
        at[corpus] = at.get(corpus, 0) + len(value.encode())
    return texts


def parts_of(spark, lines, part_bytes):
    frame = spark.createDataFrame(lines, "corpus_id string, relative_path string, value string").repartition(5)
    return {(r.corpus_id, r.part): r.document for r in dg.digest_documents(frame, part_bytes).collect()}


def some_lines(draw, n):
    """Half of all entries in one corpus; some entries longer than a part; a corpus of one."""
    lines = [("one", "", "header\n\n")]
    for i in range(n):
        corpus = "large" if i % 2 else f"corpus {i % 7}"
        size = draw.choice([1, 5, 40, 40, 700 if i % 50 == 3 else 9])
        lines.append((corpus, f"{draw.choice(['src/', 'é/', ''])}{draw.random()}", draw.choice("aé") * size + "\n"))
    return lines


@pytest.mark.parametrize("part_bytes", [1, 64, 300, 10**9])
def test_parts_have_their_length(spark, part_bytes):
    lines = some_lines(random.Random(part_bytes), 400)
    got = parts_of(spark, lines, part_bytes)
    assert got == expected_parts(lines, part_bytes)
    longest = max(len(value.encode()) for _, _, value in lines)
    assert max(len(text.encode()) for text in got.values()) < part_bytes + longest
    for corpus in {c for c, _ in got}:
        assert sorted(p for c, p in got if c == corpus) == list(range(sum(c == corpus for c, _ in got)))


@pytest.mark.parametrize("sample, per_range", [(3, 1), (40, 4)])
def test_cuts_do_not_depend_on_the_sample(spark, sample, per_range):
    lines = some_lines(random.Random(sample), 300)
    rows = spark.createDataFrame(lines, "corpus_id string, relative_path string, value string").select(
        "corpus_id", "relative_path", F.octet_length("value").cast("long").alias("weight")
    )
    some, usual = ({r.corpus_id: r.cuts for r in c.collect()} for c in (cuts.part_cuts(rows, 100, sample, per_range), cuts.part_cuts(rows, 100)))
    assert some == usual


def test_places_by_steps(spark):
    values = spark.createDataFrame([(v, a) for v in range(12) for a in ([], [3], [1, 4, 4, 9], list(range(1, 9)))], "v int, a array<int>")
    got = values.select("v", "a", cuts.places_up_to(F.col("a"), F.col("v"), 4).alias("n")).collect()
    assert all(r.n == sum(x <= r.v for x in r.a) for r in got)


def test_a_thousand_parts_and_ten_thousand(spark):
    lines = [("c", f"{i:05d}", "x" * 99 + "\n") for i in range(10_000)]
    for part_bytes, parts in ((1000, 1000), (100, 10_000)):
        got = parts_of(spark, lines, part_bytes)
        assert len(got) == parts and set(map(len, got.values())) == {part_bytes}


def test_nothing_is_evaluated_while_the_plan_is_built(spark):
    tracker, jobs = spark.sparkContext.statusTracker(), []
    spark.sparkContext.setJobGroup("digest-parts", "plan only")
    try:
        for name in ("digest_document", "digest_import", "scan_class_by_corpus", "attention_list", "run_plan", "status_report"):
            catalogue.QUERIES[name](spark, FOLDER)
        jobs = tracker.getJobIdsForGroup("digest-parts")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not jobs


def test_parts_in_order_are_the_document_and_import_as_one(spark):
    lines = catalogue.digest_lines(spark, FOLDER)
    texts = {}
    for r in sorted(lines.collect(), key=lambda r: (r.corpus_id, r.relative_path)):
        texts[r.corpus_id] = texts.get(r.corpus_id, "") + r.value
    whole = spark.createDataFrame(list(texts.items()), "corpus_id string, document string")
    one = sorted(import_digest(whole).collect())
    for part_bytes in (200, 5000):
        parts = dg.digest_documents(lines, part_bytes)
        joined = {}
        for r in parts.orderBy("corpus_id", "part").collect():
            joined[r.corpus_id] = joined.get(r.corpus_id, "") + r.document
        assert joined == texts
        assert sorted(import_digest(parts).collect()) == one
