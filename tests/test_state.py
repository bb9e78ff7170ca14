"""The stored digest as a base and changes: what a run writes, reads and moves."""

import datetime
import os
import random

from pyspark.sql import functions as F

from gistmill.operators.ignore import usable_rules
from gistmill.options import DigestMode, DigestOptions
from gistmill.plans import jobs
from gistmill.schemas import FILES
from gistmill.sources.tables import StateStore, files_from_table

DAY = datetime.timedelta(days=1)
NOW = datetime.datetime(2024, 5, 1, 8, 30)
COPY = DigestOptions(mode=DigestMode.COPY)


def table(spark, tmp_path, contents, name):
    """Files ``{(corpus, path): text or bytes}`` as a table on disk."""
    rows = [(c, f"/{c}/{p}", p, len(t), NOW, None, t.encode() if isinstance(t, str) else t) for (c, p), t in contents.items()]
    path = str(tmp_path / name)
    spark.createDataFrame(rows, FILES).drop("checksum").write.parquet(path)
    return files_from_table(spark.read.parquet(path))


def digest(store, version=None):
    return {(r.corpus_id, r.relative_path): (r.summary_date, r.content) for r in store.read(version).collect()}


def log(store):
    return {(r.corpus_id, r.relative_path): (r.status, r.outcome, r.content) for r in store.run_log().collect()}


def bytes_below(path):
    return sum(os.path.getsize(os.path.join(d, n)) for d, _, names in os.walk(path) for n in names if n.endswith(".parquet"))


def test_update_writes_what_is_due(spark, tmp_path):
    draw = random.Random(3)
    text = lambda: "".join(draw.choice("abcdefgh ijklmnop\n") for _ in range(700))
    contents = {(f"c{i % 3}", f"src/f{i:05d}.py"): text() for i in range(4000)}
    store = StateStore(spark, str(tmp_path / "state"))
    jobs.run_job(table(spark, tmp_path, contents, "one"), store, COPY, NOW)
    for key in list(contents)[::100]:
        contents[key] = text()
    assert jobs.run_job(table(spark, tmp_path, contents, "two"), store, COPY, NOW + DAY) == 2
    base, change = (sum(bytes_below(tmp_path / "state" / kind / f"version={v}") for kind in ("rows", "dropped")) for v in (1, 2))
    assert change < base * 0.02
    got = digest(store)
    assert {k: c for k, (_, c) in got.items()} == contents
    assert sum(d == NOW + DAY for d, _ in got.values()) == 40


def plan_of(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return plan[plan.find("Initial Plan"):] if "Initial Plan" in plan else plan


def test_plans_move_no_stored_contents(spark, tmp_path):
    contents = {("c", f"f{i}.py"): f"text {i}" for i in range(50)}
    store = StateStore(spark, str(tmp_path / "state"))
    jobs.run_job(table(spark, tmp_path, contents, "one"), store, COPY, NOW)
    contents["c", "f7.py"] = "new"
    files = table(spark, tmp_path, contents, "two")
    jobs.run_job(files, store, COPY, NOW + DAY)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        changes = jobs.changed(files, files.select("corpus_id").distinct(), store.read(origin=True))
        changes.collect()
        scans = [line for line in plan_of(changes).split("\n") if "ReadSchema" in line and "summary_date" in line]
        assert scans and not any("content" in line.split("ReadSchema")[1] for line in scans)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    read = store.read()
    read.collect()
    moved = [line for line in plan_of(read).split("\n") if "Exchange" in line and "hashpartitioning" in line]
    assert not moved and "BroadcastHashJoin" in plan_of(read)


def plain_run(state, contents, day, everything, bad):
    """What a run makes of ``{key: (date, text)}``; files in ``bad`` are binary."""
    corpora = {c for c, _ in contents}
    after = {k: e for k, e in state.items() if k in contents or k[0] not in corpora}
    for key, text in contents.items():
        if key not in bad and (everything or key not in state or state[key][1] != text):
            after[key] = (day, text)
    return after


def test_many_runs_against_plain_merges(spark, tmp_path):
    """Changes, deletions, failures, corpora that come and go, rebuilds and compactions."""
    draw = random.Random(11)
    store, state, contents = StateStore(spark, str(tmp_path / "state")), {}, {}
    history = {}
    for run in range(9):
        for _ in range(12):
            key = (f"c{draw.randrange(4)}", f"d/f{draw.randrange(12)}.txt")
            contents[key] = f"{key} in run {run}"
        for key in draw.sample(sorted(contents), 5):
            del contents[key]
        if run in (3, 6):
            contents = {k: t for k, t in contents.items() if k[0] != "c2"}
        bad = set(draw.sample(sorted(contents), 3))
        given = {k: (b"\0" + t.encode() if k in bad else t) for k, t in contents.items()}
        everything, day = run == 5, NOW + run * DAY
        before = state
        state = plain_run(state, contents, day, everything, bad)
        files = table(spark, tmp_path, given, f"run{run}")
        version = jobs.run_job(files, store, COPY, day, everything=everything, compact_after=3)
        assert digest(store) == state
        history[version] = state
        seen = log(store)
        assert set(seen) == set(state) | set(contents)
        for key, (status, outcome, content) in seen.items():
            assert content == (state[key][1] if key in state else None)
            if key in bad:
                assert (status, outcome) == ("outdated" if key in before else "new", "error")
            elif key not in contents:
                assert status is None and outcome is None
            elif everything or state[key][0] == day:
                assert outcome == "completed"
            else:
                assert (status, outcome) == ("up-to-date", None)
    assert any(len(store.parts(v)) == 1 for v in store.versions()[2:]) and any(len(store.parts(v)) > 2 for v in store.versions())
    for version, expected in history.items():
        assert digest(store, version) == expected


def test_lost_run_is_not_seen(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "state"))
    files = table(spark, tmp_path, {("c", "a.py"): "a"}, "one")
    assert jobs.run_job(files, store, COPY, NOW) == 1
    store.put(store.begin(), "rows", store.read())
    assert store.versions() == [1] and store.begin() == 3
    assert jobs.run_job(files, store, COPY, NOW + DAY) == 3 and digest(store) == {("c", "a.py"): (NOW, "a")}
    assert store.compact() == 4 and store.compact() == 4 and store.parts(4) == [4]
    assert digest(store) == {("c", "a.py"): (NOW, "a")}


def test_nothing_at_all(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "state"))
    none = files_from_table(spark.createDataFrame([], FILES).drop("checksum"))
    assert store.run_log() is None and store.compact() is None
    jobs.run_job(none, store, COPY, NOW)
    jobs.run_job(none, store, COPY, NOW + DAY)
    assert digest(store) == {} and store.run_log().count() == 0
    jobs.run_job(table(spark, tmp_path, {("c", "a.py"): "a"}, "one"), store, COPY, NOW + 2 * DAY)
    jobs.run_job(none, store, COPY, NOW + 3 * DAY)
    assert digest(store) == {("c", "a.py"): (NOW + 2 * DAY, "a")}


def test_own_rules_drop_entries(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "state"))
    files = table(spark, tmp_path, {("c", "a.py"): "a", ("c", "b.md"): "b", ("d", "b.md"): "b"}, "one")
    jobs.run_job(files, store, COPY, NOW)
    rules = usable_rules(spark.createDataFrame([("c", "*.md")], "corpus_id string, line string"))
    jobs.run_job(files, store, COPY, NOW + DAY, own_rules=rules)
    assert set(digest(store)) == {("c", "a.py"), ("d", "b.md")}
    assert store.read().where(F.col("summary_date") > NOW).count() == 0
