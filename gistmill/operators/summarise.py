"""Summaries from a model, with retries, and their result."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmill import fixed_values as fv
from gistmill.functions import chat
from gistmill.options import DigestMode, DigestOptions
from gistmill.schemas import KEY

# Takes the JSON request, returns the status code and the body; raises when no response came.
ChatClient = Callable[[str], tuple[int, str]]

# Calls of one thread before their results are handed on.
GROUP_CALLS = 4

# A request is known by these; a log has them with the outcome of the call.
_ASKED = [*KEY, "request_hash"]
_LOGGED = "corpus_id string, relative_path string, request_hash string, attempts int, status_code int, error_kind string, body string"
_LOGGED_ARROW = pa.schema([(name, pa.int32() if kind == "int" else pa.string()) for name, kind in (f.split() for f in _LOGGED.split(", "))])


def _error_kind(error: Exception) -> str:
    names = {kind.__name__ for kind in type(error).__mro__}
    if names & {"Timeout", "TimeoutError"}:
        return "timeout"
    if "ConnectionError" in names:
        return "connection"
    if names & {"RequestException", "URLError", "OSError"}:
        return "request"
    return "unexpected"


def _has_answer(status_code: int, body: str) -> bool:
    if status_code != 200:
        return False
    try:
        return isinstance(json.loads(body)["choices"][0]["message"]["content"], str)
    except (ValueError, LookupError, TypeError):
        return False


def _call(client: ChatClient, request: str, limit: int, pause: float) -> tuple:
    """Call until there is an answer or ``limit`` attempts are used up; the last one counts."""
    outcome = (0, None, "unexpected", "no attempt was allowed")
    for attempt in range(1, limit + 1):
        try:
            status_code, body = client(request)
            outcome = (attempt, status_code, None, body)
            if _has_answer(status_code, body):
                break
        except Exception as error:  # whatever a client raises concerns this file only
            outcome = (attempt, None, _error_kind(error), str(error))
        if attempt < limit:
            time.sleep(pause)
    return outcome


class AnswerLog:
    """Answers on shared storage, written by the tasks that got them, so that lost tasks and runs repeat only the rest.

    Every task adds small Parquet files to a folder of its own and renames them when they are
    complete.  An answer counts for the same file and the same request, by its hash.
    """

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def read(self, spark: SparkSession) -> DataFrame:
        """``corpus_id, relative_path, request_hash`` and the call's outcome, one row for each."""
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return spark.createDataFrame([], _LOGGED)
        logged = spark.read.schema(_LOGGED).option("recursiveFileLookup", "true").parquet(self.root)
        # tasks that ran twice at a time may both have asked
        outcome = F.min(F.struct("attempts", "status_code", "error_kind", "body")).alias("outcome")
        return logged.groupBy(*KEY, "request_hash").agg(outcome).select(*KEY, "request_hash", "outcome.*")

    def of_task(self, run: str) -> "_TaskLog":
        return _TaskLog(f"{self.root}/{run}-{TaskContext.get().partitionId()}")


class _TaskLog:
    """The part of a log that one task writes, with what earlier attempts of the task have left there."""

    def __init__(self, folder: str):
        self.store, self.folder = pa.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (
            pa.fs.LocalFileSystem(), folder
        )
        self.store.create_dir(self.folder, recursive=True)
        found = self.store.get_file_info(pa.fs.FileSelector(self.folder))
        tables = [pq.read_table(f.path, filesystem=self.store).to_pandas() for f in found if not f.base_name.startswith("_")]
        self.known = {(r.corpus_id, r.relative_path, r.request_hash): r for t in tables for r in t.itertuples()}

    def add(self, called: pd.DataFrame) -> None:
        if called.empty:
            return
        name = f"{uuid.uuid4().hex}.parquet"
        table = pa.Table.from_pandas(called, _LOGGED_ARROW, preserve_index=False)
        pq.write_table(table, f"{self.folder}/_{name}", filesystem=self.store)
        self.store.move(f"{self.folder}/_{name}", f"{self.folder}/{name}")


def call_model(
    texts: DataFrame, options: DigestOptions, client: ChatClient, tasks: int | None = None, log: AnswerLog | None = None
) -> DataFrame:
    """Ask the model about each row of ``corpus_id, relative_path, text``.

    Returns ``corpus_id, relative_path, summary, error, attempts``; exactly one of
    ``summary`` and ``error`` is set.  Building requests and reading answers are column
    functions; Python only makes the calls, ``options.calls_per_task`` at a time in each of
    ``tasks`` tasks (as many as shuffle partitions, unless given), so ``client`` is called
    from several threads.  Evaluate the result once, into a table: every evaluation calls
    the model.  With a ``log``, answers that it has are taken from there, and new ones are
    added as they come; errors are not kept.
    """
    limit, pause, at_once, run = options.retry_attempts, options.retry_pause, options.calls_per_task, uuid.uuid4().hex

    def calls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = log and log.of_task(run)
        for batch in batches:
            # small groups: what a lost task had finished before the last one is handed on
            for start in range(0, len(batch), GROUP_CALLS * at_once):
                group = batch.iloc[start: start + GROUP_CALLS * at_once]
                known = [own.known.get(key) if own else None for key in group[_ASKED].itertuples(index=False, name=None)]
                with ThreadPoolExecutor(at_once) as pool:
                    fresh = pool.map(lambda pair: _call(client, pair[1], limit, pause) if pair[0] is None else None,
                                     zip(known, group["request"]))
                    outcomes = [(k.attempts, k.status_code, k.error_kind, k.body) if k else f for k, f in zip(known, fresh)]
                called = pd.DataFrame(
                    outcomes, columns=["attempts", "status_code", "error_kind", "body"], index=group.index
                )
                called["status_code"] = called["status_code"].astype("Int32")
                called = pd.concat([group[_ASKED], called], axis=1)
                if own:
                    good = [k is None and kind is None and _has_answer(code, body) for k, (_, code, kind, body) in zip(known, outcomes)]
                    own.add(called[good])
                yield called

    request = chat.chat_request(F.col("relative_path"), F.col("text"), options.model)
    requests = texts.select(*KEY, request.alias("request"))
    if not options.api_key:
        answered = requests.select(
            *KEY, F.lit(0).alias("attempts"), F.lit(None).cast("int").alias("status_code"),
            F.lit("no_key").alias("error_kind"), F.lit(None).cast("string").alias("body"),
        )
    else:
        tasks = tasks or int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        requests = requests.select(*_ASKED[:2], F.sha2("request", 256).alias("request_hash"), "request")
        before = log.read(texts.sparkSession) if log else None
        if before is not None:
            beside = requests.join(before, _ASKED, "left")
            requests, before = beside.where(F.col("attempts").isNull()).select(*requests.columns), beside.where(F.col("attempts").isNotNull())
        answered = requests.repartition(tasks, *KEY).mapInPandas(calls, _LOGGED)
        if before is not None:
            answered = answered.unionByName(before.select(*answered.columns))
    code, kind, body = F.col("status_code"), F.col("error_kind"), F.col("body")
    return answered.select(
        *KEY,
        F.when(kind.isNull(), chat.chat_answer(code, body, F.col("relative_path"))).alias("summary"),
        chat.attempt_error(code, kind, body, options.timeout).alias("error"),
        "attempts",
    )


def fold_attempts(attempts: DataFrame, options: DigestOptions) -> DataFrame:
    """Result per file from a log of attempts: the first answer, else the last error.

    ``attempts`` has ``corpus_id, relative_path, attempt, status_code, error_kind, body``;
    attempts beyond the limit do not count.  Both picks combine before the shuffle.
    """
    code, kind, body = F.col("status_code"), F.col("error_kind"), F.col("body")
    read = attempts.where(F.col("attempt") <= options.retry_attempts).select(
        *KEY, "attempt",
        F.when(kind.isNull(), chat.chat_answer(code, body, F.col("relative_path"))).alias("answer"),
        chat.attempt_error(code, kind, body, options.timeout).alias("failure"),
    )
    answered = F.when(F.col("answer").isNotNull(), F.col("attempt"))
    folded = read.groupBy(*KEY).agg(
        F.min_by("answer", answered).alias("summary"),
        F.max_by("failure", "attempt").alias("last_error"),
        F.min(answered).alias("first_answer"),
        F.max("attempt").alias("last_attempt"),
    )
    return folded.select(
        *KEY,
        "summary",
        F.when(F.col("first_answer").isNull(), F.col("last_error")).alias("error"),
        F.coalesce("first_answer", "last_attempt").alias("attempts"),
    )


def drop_failed(results: DataFrame, column: str = "summary") -> DataFrame:
    """Drop results whose text reports a failure."""
    return results.where(~chat.is_failed_text(F.col(column)))


def ready_content(options: DigestOptions) -> Column:
    """Entry content of a routed row where no model is needed, else NULL.

    Mock mode writes one constant for every file to be summarised.  Copy mode routes no
    file there, and the model's answers come from :func:`call_model`.
    """
    if options.mode is DigestMode.MOCK:
        return F.when(F.col("route") == "summarise", F.lit(fv.MOCK_SUMMARY)).otherwise(F.col("payload"))
    return F.col("payload")
