"""Answers outlive the task, the job and the run that got them."""

import collections
import datetime
import json
import os
import sys

import pytest
from pyspark import cloudpickle

from gistmill.operators.summarise import AnswerLog, call_model
from gistmill.options import DigestMode, DigestOptions
from gistmill.plans import jobs
from gistmill.sources import tree as trees
from gistmill.sources.tables import StateStore

cloudpickle.register_pickle_by_value(sys.modules[__name__])
AI = DigestOptions(mode=DigestMode.AI, api_key="k", model="m", retry_pause=0.0, retry_attempts=2, calls_per_task=1)
NOW = datetime.datetime(2024, 5, 1, 8, 30)


class Counting:
    """Notes each call in a file; ends the task at a path, or fails there, while ``there`` exists."""

    def __init__(self, folder, ends=None, there=None):
        self.folder, self.ends, self.there = str(folder), ends, str(there)

    def __call__(self, request):
        path = json.loads(request)["messages"][1]["content"].split("Path: ")[1].split("\n")[0]
        if path == self.ends and os.path.exists(self.there):
            if not self.there.endswith("always"):
                os.remove(self.there)
            raise SystemExit("the worker is lost")
        with open(os.path.join(self.folder, path.replace("/", "-")), "a") as notes:
            notes.write(".")
        if path.startswith("bad"):
            return 500, "busy"
        return 200, json.dumps({"choices": [{"message": {"content": f"about {path}"}}]})

    def calls(self):
        return {name: os.path.getsize(os.path.join(self.folder, name)) for name in os.listdir(self.folder)}


def asked(spark, *paths, text="text"):
    rows = [("c", p, f"{text} of {p}") for p in paths]
    return spark.createDataFrame(rows, "corpus_id string, relative_path string, text string")


def answers(frame):
    return {r.relative_path: (r.summary, r.error is None) for r in frame.collect()}


@pytest.fixture
def notes(tmp_path):
    (tmp_path / "notes").mkdir()
    return tmp_path / "notes"


def test_known_answers_are_not_asked_again(spark, tmp_path, notes):
    log, client = AnswerLog(f"file:{tmp_path}/log"), Counting(notes)
    first = answers(call_model(asked(spark, "a", "b", "bad"), AI, client, tasks=2, log=log))
    assert first == {"a": ("about a", True), "b": ("about b", True), "bad": (None, False)}
    assert client.calls() == {"a": 1, "b": 1, "bad": 2}
    second = answers(call_model(asked(spark, "a", "b", "bad", "d"), AI, client, tasks=2, log=log))
    assert second == first | {"d": ("about d", True)} and client.calls() == {"a": 1, "b": 1, "bad": 4, "d": 1}
    # another text, or another model, is another request
    answers(call_model(asked(spark, "a", text="new text"), AI, client, tasks=1, log=log))
    assert client.calls()["a"] == 2
    assert answers(call_model(asked(spark, "a").limit(0), AI, client, tasks=1, log=log)) == {}


def test_job_after_a_lost_one_asks_for_the_rest(spark, tmp_path, notes):
    paths = [f"f{i:02d}" for i in range(30)]
    (tmp_path / "always").write_text("")
    log, client = AnswerLog(str(tmp_path / "log")), Counting(notes, "f15", tmp_path / "always")
    with pytest.raises(Exception):
        call_model(asked(spark, *paths), AI, client, tasks=1, log=log).collect()
    had = collections.Counter(r.relative_path for r in log.read(spark).collect())
    assert 4 <= len(had) < 30 and set(had.values()) == {1} and "f15" not in had
    (tmp_path / "always").unlink()
    assert answers(call_model(asked(spark, *paths), AI, client, tasks=1, log=log)) == {p: (f"about {p}", True) for p in paths}
    assert all(client.calls()[p] == 1 for p in had)


def test_second_attempt_of_a_task_reads_what_the_first_has_left(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "log" / "run-0")
    import pandas as pd

    from gistmill.operators import summarise

    first = summarise._TaskLog(folder)
    first.add(pd.DataFrame([("c", "a", "h", 1, 200, None, "body")], columns=summarise._LOGGED_ARROW.names))
    (tmp_path / "log" / "run-0" / "_half.parquet").write_bytes(b"PAR1")
    again = summarise._TaskLog(folder)
    assert set(again.known) == {("c", "a", "h")} and again.known["c", "a", "h"].body == "body"


def test_run_after_a_lost_run(spark, tmp_path, notes):
    root = tmp_path / "project"
    root.mkdir()
    for i in range(24):
        (root / f"f{i:02d}.py").write_text(f"# file {i}\n" + "word and word\n" * 300)
    (tmp_path / "always").write_text("")
    client, store = Counting(notes, "f12.py", tmp_path / "always"), StateStore(spark, str(tmp_path / "state"))
    files = trees.read_contents(trees.list_corpora(spark, {"p": str(root)}))
    with pytest.raises(Exception):
        jobs.run_job(files, store, AI, NOW, client=client, tasks=1)
    had = client.calls()
    assert had and store.versions() == []
    (tmp_path / "always").unlink()
    jobs.run_job(files, store, AI, NOW, client=client, tasks=1)
    logged = [p for p in had if client.calls()[p] == 1]
    assert len(logged) >= 4 and len(store.read().collect()) == 24
    assert not os.path.exists(tmp_path / "state" / "answers")
    # a rebuild asks anew
    jobs.run_job(files, store, AI, NOW, client=client, tasks=2, everything=True)
    assert client.calls()["f00.py"] >= 2
