"""Whole jobs on real trees, and what must hold between runs."""

import datetime
import json
import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from conftest import LARGE
from gistmill import fixed_values as fv
from gistmill.operators import ignore, report
from gistmill.options import DigestMode, DigestOptions
from gistmill.plans import jobs
from gistmill.sources import tree as trees
from gistmill.sources.tables import StateStore

cloudpickle.register_pickle_by_value(sys.modules[__name__])
DAY = datetime.timedelta(days=1)
NOW = datetime.datetime(2024, 5, 1, 8, 30)
MOCK = DigestOptions(mode=DigestMode.MOCK)


def scan(spark, **roots):
    return trees.read_contents(trees.list_corpora(spark, {c: str(r) for c, r in roots.items()}))


def digest(store):
    return {r.relative_path: r for r in store.read().collect()}


def outcomes(store):
    return {r.relative_path: (r.status, r.outcome) for r in store.run_log().collect()}


def test_rebuild_then_update(spark, tree, tmp_path):
    store = StateStore(spark, str(tmp_path / "state"))
    jobs.run_job(scan(spark, p=tree), store, MOCK, NOW, everything=True)
    first = digest(store)
    assert set(first) == {"small.py", "large.py", "README.md", "config.json"}
    assert first["small.py"].content == 'print("hello")' and first["large.py"].content == fv.MOCK_SUMMARY
    assert "mocked summary" in first["large.py"].content.lower()
    assert outcomes(store)["binary_file.bin"] == ("new", "error")

    os.remove(tree / "small.py")
    (tree / "large.py").write_text("# changed\n")
    (tree / "added.py").write_text("x = 1\n")
    jobs.run_job(scan(spark, p=tree), store, MOCK, NOW + DAY)
    second = digest(store)
    assert set(second) == {"large.py", "README.md", "config.json", "added.py"}
    assert second["large.py"].content == "# changed\n" and second["large.py"].summary_date == NOW + DAY
    assert second["README.md"] == first["README.md"]
    assert outcomes(store) == {
        "large.py": ("outdated", "completed"), "added.py": ("new", "completed"), "binary_file.bin": ("new", "error"),
        "README.md": ("up-to-date", None), "config.json": ("up-to-date", None),
    }
    stats = report.completion_stats(store.run_log()).first()
    assert (stats.processed, stats.up_to_date) == (2, 2)

    # nothing changed: same digest; a deletion alone is applied, too
    jobs.run_job(scan(spark, p=tree), store, MOCK, NOW + 2 * DAY)
    assert digest(store) == second
    os.remove(tree / "added.py")
    jobs.run_job(scan(spark, p=tree), store, MOCK, NOW + 3 * DAY)
    assert set(digest(store)) == set(second) - {"added.py"}


def test_update_from_nothing_equals_rebuild(spark, tree, tmp_path):
    one, two = (StateStore(spark, str(tmp_path / name)) for name in ("one", "two"))
    files = scan(spark, p=tree)
    jobs.run_job(files, one, MOCK, NOW)
    jobs.run_job(files, two, MOCK, NOW, everything=True)
    assert digest(one) == digest(two)


def test_corpus_without_files_keeps_its_entries(spark, tree, tmp_path):
    other = tmp_path / "other"
    other.mkdir()
    (other / "a.py").write_text("a = 1\n")
    store = StateStore(spark, str(tmp_path / "state"))
    jobs.run_job(scan(spark, p=tree, q=other), store, MOCK, NOW)
    os.remove(other / "a.py")
    listing = trees.list_corpora(spark, {"p": str(tree), "q": str(other)})
    jobs.run_job(trees.read_contents(listing), store, MOCK, NOW + DAY, names=listing)
    rows = {(r.corpus_id, r.relative_path) for r in store.read().collect()}
    assert ("q", "a.py") in rows and ("p", "small.py") in rows


def test_copy_mode_and_size_limit(spark, tree, tmp_path):
    (tree / "wide.txt").write_text("w" * 3000)
    (tree / "__init__.py").write_text("")
    store = StateStore(spark, str(tmp_path / "state"))
    options = DigestOptions(mode=DigestMode.COPY, max_file_size_mb=0.0025)
    jobs.run_job(scan(spark, p=tree), store, options, NOW)
    got = digest(store)
    assert got["wide.txt"].content == "File size (0.0MB) exceeds limit (0.0025MB)"
    assert got["large.py"].content.startswith("File size") == (len(LARGE) > 0.0025 * 1024 * 1024)
    assert got["__init__.py"].content == ""
    assert got["README.md"].content == (tree / "README.md").read_text()


def test_files_too_large_for_a_row(spark, tree, tmp_path):
    (tree / "wide.txt").write_text("é" * 3000)
    (tree / "latin.txt").write_bytes(b"\xe9" * 5000)
    (tree / "wide.bin").write_bytes(b"\0" + b"x" * 5000)
    (tree / "odd.txt").write_bytes(b"\x01" * 600 + b"y" * 4500)
    (tree / "control.txt").write_bytes(b"\x01" * 600 + b"y" * 5400)
    options = DigestOptions(mode=DigestMode.MOCK, max_file_size_mb=0.001)
    got = []
    for row_bytes in (2000, trees.ROW_BYTES):
        store = StateStore(spark, str(tmp_path / f"state{row_bytes}"))
        listing = trees.list_corpora(spark, {"p": str(tree)})
        jobs.run_job(trees.read_contents(listing, row_bytes=row_bytes), store, options, NOW)
        jobs.run_job(trees.read_contents(listing, row_bytes=row_bytes), store, options, NOW + DAY)
        assert outcomes(store)["wide.txt"] == ("up-to-date", None) and outcomes(store)["wide.bin"] == ("new", "error")
        got.append(digest(store))
    assert got[0] == got[1] and got[0]["wide.txt"].content.startswith("File size (0.0MB)")
    assert {"wide.txt", "latin.txt", "control.txt"} <= set(got[0]) and not {"wide.bin", "odd.txt"} & set(got[0])
    with pytest.raises(ValueError):
        DigestOptions(mode=DigestMode.MOCK, max_file_size_mb=2000)


def test_own_names_of_digest_and_rule_files(spark, tree, tmp_path):
    (tree / "summary.md").write_text("old digest")
    (tree / "skip.list").write_text("*.json\n")
    store = StateStore(spark, str(tmp_path / "state"))
    options = DigestOptions(mode=DigestMode.MOCK, output_file="out/summary.md", ignore_file="skip.list")
    roots = {"p": str(tree)}
    own = ignore.usable_rules(trees.rule_lines(spark, roots, options.ignore_file))
    listing = trees.list_corpora(spark, roots, options.ignore_file, output_file="summary.md")
    jobs.run_job(trees.read_contents(listing), store, options, NOW, own_rules=own)
    assert set(digest(store)) == {"small.py", "large.py", "README.md", "skip.list"}


def test_rule_file_that_is_not_text_concerns_its_corpus_only(spark, tree, tmp_path):
    other = tmp_path / "other"
    other.mkdir()
    (other / "a.py").write_text("a = 1\n")
    (other / fv.IGNORE_FILE).write_bytes(b"\xff\xfe*.py")
    (tree / fv.IGNORE_FILE).write_text("*.json\n")
    roots = {"p": str(tree), "q": str(other)}
    assert [(r.corpus_id, r.line) for r in trees.rule_lines(spark, roots).collect()] == [("p", "*.json")]
    names = {(r.corpus_id, r.relative_path) for r in trees.list_corpora(spark, roots).collect()}
    assert ("q", "a.py") in names and ("p", "small.py") in names


def answer(request):
    question = json.loads(request)["messages"][1]["content"]
    if "Path: large.py" in question and "changed" in question:
        return 500, "busy"
    return 200, json.dumps({"choices": [{"message": {"content": "- **Role**: " + question.split("Path: ")[1].split("\n")[0]}}]})


def test_model_job_and_failed_refresh(spark, tree, tmp_path):
    options = DigestOptions(mode=DigestMode.AI, api_key="k", model="m", retry_pause=0.0)
    store = StateStore(spark, str(tmp_path / "state"))
    files, staging = scan(spark, p=tree), spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(staging))
    jobs.run_job(files, store, options, NOW, client=answer)
    assert set(os.listdir(staging)) == before  # nothing staged is left behind
    first = digest(store)
    assert first["large.py"].content == "- **Role**: large.py" and first["small.py"].content == 'print("hello")'
    (tree / "large.py").write_text(LARGE + "# changed\n")
    jobs.run_job(scan(spark, p=tree), store, options, NOW + DAY, client=answer)
    # the old entry stays whole, so the file is due again
    assert digest(store) == first
    assert outcomes(store)["large.py"] == ("outdated", "error")
    jobs.run_job(scan(spark, p=tree), store, options, NOW + 2 * DAY, client=answer, fetch=trees.read_contents, tasks=2)
    assert outcomes(store)["large.py"] == ("outdated", "error")


def test_preconditions(spark, tree, tmp_path):
    store = StateStore(spark, str(tmp_path / "state"))
    with pytest.raises(ValueError):
        jobs.run_job(None, store, DigestOptions(mode=DigestMode.AI, model="m"), NOW, client=answer)
    with pytest.raises(ValueError):
        jobs.run_job(None, store, DigestOptions(mode=DigestMode.AI, api_key="k"), NOW, client=answer)
    with pytest.raises(ValueError):
        jobs.run_job(None, store, DigestOptions(mode=DigestMode.AI, api_key="k", model="m"), NOW)
    assert store.versions() == []


def test_status_job_and_process_files(spark, tree, tmp_path):
    (tree / "debug.log").write_text("log")
    (tree / "build").mkdir()
    (tree / "build" / "x.py").write_text("x")
    store = StateStore(spark, str(tmp_path / "state"))
    files = scan(spark, p=tree)
    jobs.run_job(files, store, MOCK, NOW)
    (tree / "small.py").write_text("changed")
    rules = spark.createDataFrame([("p", r) for r in fv.DEFAULT_IGNORE_RULES], "corpus_id string, pattern string")
    status = jobs.status_job(scan(spark, p=tree), store.read(), rules)
    row = status.counts.first()
    assert (row.up_to_date, row.outdated, row.new, row.ignored, row.patterns) == (3, 1, 1, 1, 107)
    shown = {r.relative_path: (r.size, r.status) for r in status.attention.collect()}
    assert shown["small.py"] == ("7B", "outdated") and shown["binary_file.bin"] == ("5B", "new") and len(shown) == 5
    current = jobs.current_files(scan(spark, p=tree))
    entries = jobs.process_files(current, store.read(), MOCK, NOW, "update").collect()
    assert [r.entry.split("\n")[0] for r in entries] == ["## small.py"]
    assert jobs.process_files(current, store.read(), MOCK, NOW, "status").count() == 0
    assert jobs.process_files(current, store.read(), MOCK, NOW).count() == 4


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_texts_to_be_summarised_stay_in_the_scan(spark):
    from gistmill.plans import testbed

    options = DigestOptions(mode=DigestMode.AI, api_key="k", model="m")
    frame = jobs.routed(jobs.current_files(testbed.files(spark, "/root/testdata/sf0.001")), options)
    assert "text" not in frame.columns and "content" not in frame.columns
    assert frame.where("route = 'summarise'").agg(F.max(F.length("ready"))).first()[0] is None


def test_due_files_are_known_before_contents_are_read(spark, tree, tmp_path):
    from gistmill.sources.tables import files_from_table

    store = StateStore(spark, str(tmp_path / "state"))
    scan(spark, p=tree).write.parquet(str(tmp_path / "files"))
    files = files_from_table(spark.read.parquet(str(tmp_path / "files")))
    jobs.run_job(files, store, MOCK, NOW)
    current = jobs.current_files(files)
    keys = jobs.compared(current, store.read())
    assert "content" not in plan_of(keys)
    assert jobs.due_only(current, keys, False).select("relative_path").collect()[0].relative_path == "binary_file.bin"
    # counting moves no contents between tasks
    counts = report.completion_stats(jobs.plan_current(files, store.read(), MOCK, NOW))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = plan_of(report.completion_stats(jobs.plan_current(files, store.read(), MOCK, NOW))).split("\n")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert counts.first().up_to_date == 4
    assert not [line for line in lines if "Aggregate" in line and ("ready#" in line or "content#" in line)]


def test_status_reads_no_contents_of_tables_with_checksums(spark, tree, tmp_path):
    from gistmill.sources.tables import empty_state, files_from_table

    scan(spark, p=tree).write.parquet(str(tmp_path / "files"))
    files = files_from_table(spark.read.parquet(str(tmp_path / "files")))
    rules = spark.createDataFrame([("p", "*.x")], "corpus_id string, pattern string")
    status = jobs.status_job(files, empty_state(spark), rules)
    for frame in (status.counts, status.attention):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "ReadSchema" in plan and "content:binary" not in plan
