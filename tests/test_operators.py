"""Status, merges, reports, and calls to a model that misbehaves."""

import datetime
import json
import sys

import pytest
from pyspark import cloudpickle

from gistmill import fixed_values as fv
from gistmill.operators import digest as dg
from gistmill.operators import report, status, summarise
from gistmill.options import DigestMode, DigestOptions
from gistmill.schemas import KEY, STATE

cloudpickle.register_pickle_by_value(sys.modules[__name__])
OLD, NOW = datetime.datetime(2024, 1, 1), datetime.datetime(2024, 5, 1, 8, 30)
AI = DigestOptions(mode=DigestMode.AI, api_key="k", model="m", retry_pause=0.0)
FILES = "corpus_id string, relative_path string, checksum string"


def state(spark, *rows):
    return spark.createDataFrame([("c", p, OLD, h, t) for p, h, t in rows], STATE)


def test_status_and_the_two_readings_of_a_missing_checksum(spark):
    files = spark.createDataFrame([("c", p, "h") for p in ("equal", "other", "null", "empty", "fresh")], FILES)
    stored = state(spark, ("equal", "h", ""), ("other", "x", ""), ("null", None, ""), ("empty", "", ""), ("gone", "h", ""))
    got = {r.relative_path: r.status for r in status.with_status(files, stored).collect()}
    assert got == {"equal": "up-to-date", "other": "outdated", "null": "up-to-date", "empty": "up-to-date", "fresh": "new"}
    assert {r[1] for r in status.needs_update(files, stored).collect()} == {"other", "fresh"}
    assert {r[1] for r in status.needs_update(files, stored, strict=True).collect()} == {"other", "fresh", "null", "empty"}
    assert [r[1] for r in status.new_files(files, stored).collect()] == ["fresh"]
    assert [r[1] for r in status.stale_entries(stored, files).collect()] == ["gone"]


def test_comparing_reads_no_stored_contents(spark, tmp_path):
    state(spark, ("a", "h", "long text")).write.parquet(str(tmp_path / "s"))
    files = spark.createDataFrame([("c", "a", "h")], FILES)
    frame = status.with_status(files, spark.read.parquet(str(tmp_path / "s"))).select(*KEY, "status")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema", 1)[1].split("\n")[0]


def test_merges_take_entries_whole(spark):
    current = spark.createDataFrame([("c", p) for p in ("a", "b", "d", "e")], "corpus_id string, relative_path string")
    previous = state(spark, ("a", "h1", "old a"), ("b", "h2", "old b"), ("gone", "h3", "old"))
    fresh = spark.createDataFrame([("c", "a", NOW, None, "new a"), ("c", "d", NOW, "h4", "new d")], STATE)
    got = {r.relative_path: tuple(r)[2:] for r in dg.merge_current(current, fresh, previous).collect()}
    assert got == {"a": (NOW, None, "new a"), "b": (OLD, "h2", "old b"), "d": (NOW, "h4", "new d")}
    both = {r.relative_path: r.content for r in dg.merge_all(fresh, previous).collect()}
    assert both == {"a": "new a", "b": "old b", "d": "new d", "gone": "old"}


def test_lists_and_counts(spark):
    rows = [("big", f"f{i:03d}", "new" if i % 2 else "up-to-date") for i in range(60)]
    rows += [("small", f"f{i:03d}", "up-to-date") for i in range(20)] + [("calm", f"f{i:03d}", "up-to-date") for i in range(21)]
    frame = spark.createDataFrame(rows, "corpus_id string, relative_path string, status string")
    got = report.attention_list(frame).collect()
    assert [r.relative_path for r in sorted(got) if r.corpus_id == "big"] == [f"f{i:03d}" for i in range(1, 31, 2)]
    assert {(r.files, r.due, r.more) for r in got if r.corpus_id == "big"} == {(60, 30, 15)}
    assert len([r for r in got if r.corpus_id == "small"]) == 20
    assert not [r for r in got if r.corpus_id == "calm"]
    counts = {r.corpus_id: tuple(r)[1:] for r in report.status_counts(frame).collect()}
    assert counts == {"big": (30, 0, 30), "small": (20, 0, 0), "calm": (21, 0, 0)}
    plan = report.run_plan(frame.where("status = 'new'")).collect()
    assert [(r.relative_path, r.to_process) for r in plan] == [(None, 30)]
    short = report.run_plan(frame.where("corpus_id = 'small'").limit(10)).collect()
    assert len(short) == 10 and {r.to_process for r in short} == {10}


def test_lists_and_counts_evaluate_their_input_once(spark):
    frame = spark.range(1000).selectExpr(
        "concat('c', id % 3) AS corpus_id", "cast(id AS string) AS relative_path", "if(id % 2 = 0, 'new', 'up-to-date') AS status"
    )
    for made in (report.attention_list(frame), report.run_plan(frame)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Range (") == 1, plan
        # a corpus meets in one place only after its groups have been cut to their first rows
        assert plan.index("hashpartitioning(corpus_id") < plan.rindex("Filter (rank") < plan.index("_group#", plan.rindex("Exchange"))


@pytest.mark.parametrize("groups", [1, 7])
def test_first_rows_and_counts(spark, monkeypatch, groups):
    monkeypatch.setattr(report, "GROUPS", groups)
    rows = [("large", f"p{i * 37 % 101:03d}", ["new", "up-to-date", "outdated"][i % 3]) for i in range(101)]
    rows += [("small", f"q{i}", "up-to-date") for i in range(4)]
    frame = spark.createDataFrame(rows, "corpus_id string, relative_path string, status string").repartition(3)
    got = sorted(tuple(r) for r in report.attention_list(frame, small_corpus=10, shown=6).collect())
    due = sorted((c, p, s) for c, p, s in rows if c == "large" and s != "up-to-date")
    expected = [(*r, 101, len(due), len(due) - 6) for r in due[:6]] + [(*r, 4, 0, 0) for r in sorted(rows) if r[0] == "small"]
    assert got == expected
    plan = sorted(map(tuple, report.run_plan(frame, short=4).collect()), key=str)
    assert plan == sorted([("large", None, None, 101)] + [(*r, 4) for r in rows if r[0] == "small"], key=str)


def reply(text):
    return json.dumps({"choices": [{"message": {"role": "assistant", "content": text}}]})


class Requests:
    class exceptions:
        class RequestException(OSError):
            pass

        class Timeout(RequestException):
            pass


class Faulty:
    """Behaves as the file's name says."""

    def __init__(self):
        self.calls = {}

    def __call__(self, request):
        question = json.loads(request)["messages"][1]["content"]
        path = question.split("Path: ", 1)[1].split("\n", 1)[0]
        self.calls[path] = self.calls.get(path, 0) + 1
        if path == "third" and self.calls[path] < 3:
            raise ConnectionError("refused")
        if path == "down":
            return 500, "no"
        if path == "late":
            raise Requests.exceptions.Timeout("late")
        if path == "lost":
            raise ConnectionError("refused")
        if path == "broken":
            raise Requests.exceptions.RequestException("bad url")
        if path == "odd":
            raise KeyError("x")
        if path == "none":
            return 200, '{"choices": []}'
        if path == "null":
            return 200, '{"choices": [{"message": {"content": null}}]}'
        if path == "number":
            return 200, '{"choices": [{"message": {"content": 5}}]}'
        if path == "page":
            return 200, "<html>busy</html>"
        if path == "head":
            return 200, reply(f" ## File: {path}\n\n body ")
        return 200, reply("Error: not really")


def asked(spark, *paths):
    return spark.createDataFrame([("c", p, f"text of {p}") for p in paths], "corpus_id string, relative_path string, text string")


def test_model_calls(spark):
    names = ["ok", "third", "down", "late", "lost", "broken", "odd", "none", "null", "head", "number", "page"]
    rows = summarise.call_model(asked(spark, *names), AI, Faulty(), tasks=3).collect()
    got = {r.relative_path: (r.summary, r.error, r.attempts) for r in rows}
    assert got["ok"] == ("Error: not really", None, 1)
    assert got["third"] == ("Error: not really", None, 3)
    assert got["head"] == ("body", None, 1)
    assert got["down"] == (None, "API error 500: no", 3)
    assert got["late"] == (None, "API request timed out after 30.0s", 3)
    assert got["lost"] == (None, "Connection error: refused", 3)
    assert got["broken"] == (None, "API request failed: bad url", 3)
    assert got["odd"] == (None, "Unexpected error: 'x'", 3)
    assert got["none"] == (None, fv.NO_CHOICES, 3)
    assert got["null"][0] is None and got["null"][1].startswith("Unexpected error") and len(got) == len(names)
    # a number is no answer, and what is not JSON is a failed request
    assert got["number"] == (None, fv.NO_TEXT, 3) and got["page"] == (None, fv.REQUEST_FAILED + fv.NOT_JSON, 3)


def test_model_without_key(spark):
    options = DigestOptions(mode=DigestMode.AI)
    row = summarise.call_model(asked(spark, "a"), options, Faulty()).first()
    assert (row.summary, row.error, row.attempts) == (None, "API key not provided", 0)
    with pytest.raises(ValueError):
        options.require_key()
    DigestOptions(mode="mock").require_key()


def test_folding_attempts(spark):
    rows = [
        ("c", "won", 1, 500, None, "no"), ("c", "won", 2, 200, None, reply("yes")), ("c", "won", 3, 200, None, reply("late")),
        ("c", "lost", 1, 500, None, "a"), ("c", "lost", 2, 429, None, "b"), ("c", "lost", 3, None, "timeout", ""),
        ("c", "beyond", 1, 500, None, "a"), ("c", "beyond", 4, 200, None, reply("too late")),
    ]
    frame = spark.createDataFrame(rows, "corpus_id string, relative_path string, attempt int, status_code int, error_kind string, body string")
    got = {r.relative_path: (r.summary, r.error, r.attempts) for r in summarise.fold_attempts(frame, AI).collect()}
    assert got == {
        "won": ("yes", None, 2),
        "lost": (None, "API request timed out after 30.0s", 3),
        "beyond": (None, "API error 500: a", 1),
    }


def test_failed_texts_and_mode_switch(spark):
    frame = spark.createDataFrame([("a", "Error: x"), ("b", "fine Error:")], "relative_path string, summary string")
    assert [r.relative_path for r in summarise.drop_failed(frame).collect()] == ["b"]
    assert DigestMode.choose(mock=True, copy=True) is DigestMode.MOCK
    assert DigestMode.choose(copy=True) is DigestMode.COPY and DigestMode.choose() is DigestMode.AI
