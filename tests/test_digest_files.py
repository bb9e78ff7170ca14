"""Digest files put together by tasks are the joined parts of the digest texts."""

import os
import random

import pytest
from pyspark.sql import functions as F

from gistmill.operators import digest as dg
from gistmill.sources import digest_files
from gistmill.sources.digest_files import write_digest_files

LINES = "corpus_id string, relative_path string, value string"


def lines_of(draw, sizes):
    return [
        (corpus, "" if i == 0 else f"d{draw.randrange(50)}/f{i} é.py", draw.choice(["é日😀\n", "x", "", "line\n\n"]) * draw.randrange(60))
        for corpus, size in sizes.items() for i in range(size)
    ]


def texts_of(rows):
    texts = {}
    for corpus, path, value in sorted(rows, key=lambda r: (r[0], r[1].encode())):
        texts[corpus] = texts.get(corpus, "") + (value or "")
    return texts


def paths_of(spark, folder, corpora):
    return spark.createDataFrame([(c, str(folder / c / "digest é.md")) for c in corpora], "corpus_id string, path string")


def read(folder, corpora):
    return {c: (folder / c / "digest é.md").read_bytes().decode() for c in corpora}


@pytest.mark.parametrize("part_bytes", [1, 300, 1 << 20])
def test_files_are_the_joined_parts(spark, tmp_path, part_bytes):
    rows = lines_of(random.Random(part_bytes), {"hot": 900, "small": 7, "one": 1})
    lines = spark.createDataFrame(rows, LINES).repartition(7)
    (tmp_path / "small").mkdir()
    (tmp_path / "small" / "digest é.md").write_text("old" * 100_000)
    write_digest_files(lines, paths_of(spark, tmp_path, ["hot", "small", "one"]), part_bytes)
    assert read(tmp_path, ["hot", "small", "one"]) == texts_of(rows)
    parts = dg.digest_documents(lines, part_bytes).orderBy("corpus_id", "part").collect()
    joined = {}
    for row in parts:
        joined[row.corpus_id] = joined.get(row.corpus_id, "") + row.document
    assert joined == texts_of(rows)
    assert {name for _, _, names in os.walk(tmp_path) for name in names} == {"digest é.md"}


def test_with_shuffled_joins(spark, tmp_path):
    rows = lines_of(random.Random(3), {"hot": 400, "small": 7})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        write_digest_files(spark.createDataFrame(rows, LINES), paths_of(spark, tmp_path, ["hot", "small"]), 500)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert read(tmp_path, ["hot", "small"]) == texts_of(rows)


def test_odd_input(spark, tmp_path):
    rows = [("a", "", "head\n"), ("a", "x", None), ("a", "y", ""), ("a", "z", "end"), ("left out", "x", "no"), ("empty", "", "")]
    lines = spark.createDataFrame(rows, LINES).withColumn("path", F.lit("p")).withColumn("part", F.lit(1)).withColumn("start", F.lit(2))
    (tmp_path / "stays").mkdir()
    (tmp_path / "stays" / "digest é.md").write_text("stays")
    write_digest_files(lines, paths_of(spark, tmp_path, ["a", "empty", "stays"]).withColumn("value", F.lit(3)))
    assert read(tmp_path, ["a", "empty", "stays"]) == {"a": "head\nend", "empty": "", "stays": "stays"}
    assert not (tmp_path / "left out").exists()
    write_digest_files(spark.createDataFrame([], LINES), paths_of(spark, tmp_path, ["a"]))
    assert read(tmp_path, ["a"]) == {"a": "head\nend"}


def test_no_row_grows_with_its_corpus(spark, tmp_path, monkeypatch):
    """Places are found from short rows, in many ranges, also for keys that are null or repeated."""
    monkeypatch.setattr(digest_files, "RANGE_BITS", 2, raising=False)
    staged, keep = [], digest_files.Staging.keep

    def kept(staging, rows, label):
        staged.append((label, rows.schema))
        return keep(staging, rows, label)

    monkeypatch.setattr(digest_files.Staging, "keep", kept)
    rows = lines_of(random.Random(5), {"hot": 300, "small": 5})
    again = [("hot", "d7/twice", "same é\n")] * 11 + [("hot", None, "no path\n")] * 3
    lines = spark.createDataFrame(rows + again + [(None, "x", "no corpus")], LINES).repartition(5)
    write_digest_files(lines, paths_of(spark, tmp_path, ["hot", "small"]), 40)
    assert read(tmp_path, ["hot", "small"]) == texts_of([(c, p or "", v) for c, p, v in again[-3:] + rows + again[:-3]])
    assert [(label, field.name) for label, schema in staged for field in schema if field.dataType.typeName() in ("array", "map")] == []


def test_a_lost_run_leaves_the_old_file(spark, tmp_path, monkeypatch):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "digest é.md").write_text("old")
    lines = spark.createDataFrame([("a", "x", "new"), ("a", "y", "er")], LINES)
    monkeypatch.setattr(digest_files, "_writer", lambda label: lambda batches: (1 / 0 for _ in batches))
    with pytest.raises(Exception, match="ZeroDivisionError|division by zero"):
        write_digest_files(lines, paths_of(spark, tmp_path, ["a"]))
    assert read(tmp_path, ["a"]) == {"a": "old"} and os.listdir(tmp_path / "a") == ["digest é.md"]


def test_a_task_that_runs_again(tmp_path):
    """Bytes and places do not change, and a finished file is left alone."""
    import pyarrow as pa

    path = str(tmp_path / "digest.md")
    digest_files._begin(path + ".part", 5)
    batch = pa.RecordBatch.from_pydict({"path": [path, path], "at": [2, 0], "value": [b"cde", b"ab"]})
    for _ in range(2):
        assert [b.to_pylist() for b in digest_files._writer(".part")([batch])] == [[{"path": path, "written": 5}]]
    for _ in range(2):
        digest_files._finish(path, ".part", 5, 5)
    with pytest.raises(FileNotFoundError):
        list(digest_files._writer(".part")([batch]))
    with pytest.raises(ValueError):
        digest_files._finish(path, ".part", 5, 4)
    assert (tmp_path / "digest.md").read_bytes() == b"abcde" and os.listdir(tmp_path) == ["digest.md"]
