"""Queries: every operator and job over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmill import fixed_values as fv
from gistmill.functions import chat, entries
from gistmill.functions import text as tx
from gistmill.operators import digest as dg
from gistmill.operators import ignore, report, route, status, summarise
from gistmill.operators.once import add_once
from gistmill.options import DigestMode, DigestOptions
from gistmill.plans import jobs, testbed
from gistmill.schemas import KEY
from gistmill.session import staged, staging_path
from gistmill.sources import stores, tree
from gistmill.sources.digest_files import write_digest_files
from gistmill.sources.digest_text import import_digest, read_digest_texts
from gistmill.sources.tables import StateStore, files_from_table

MOCK = DigestOptions(mode=DigestMode.MOCK, max_file_size_mb=0.01)
COPY = DigestOptions(mode=DigestMode.COPY, max_file_size_mb=0.01)
MODEL = DigestOptions(mode=DigestMode.AI, api_key="key", model="some-model", max_file_size_mb=0.01, retry_pause=0.0)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _dated(rows: DataFrame) -> DataFrame:
    """Dates as text, equal in every engine."""
    return rows.withColumn("summary_date", F.date_format("summary_date", fv.STAMP_FORMAT))


def _all_files(spark: SparkSession, folder: str) -> DataFrame:
    documents = files_from_table(testbed.files(spark, folder))
    return documents.unionByName(files_from_table(testbed.page_files(spark, folder)))


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return route.with_text(testbed.files(spark, folder))


def _current(spark: SparkSession, folder: str, by_source: bool = False) -> DataFrame:
    return jobs.current_files(testbed.files(spark, folder, by_source))


def _statuses(spark: SparkSession, folder: str, by_source: bool = False) -> DataFrame:
    return status.with_status(
        _current(spark, folder, by_source), testbed.state(spark, folder, by_source)
    )


def _rules(spark: SparkSession, folder: str) -> DataFrame:
    corpora = testbed.read_table(spark, folder, "documents").select(F.col("lang").alias("corpus_id"))
    return ignore.rule_table(testbed.rule_lines(spark, folder), corpora.distinct())


def _own_rules(spark: SparkSession, folder: str) -> DataFrame:
    return ignore.usable_rules(testbed.rule_lines(spark, folder))


def _fresh(spark: SparkSession, folder: str, options: DigestOptions) -> DataFrame:
    """Fresh entries of all current files."""
    empty = testbed.state(spark, folder).where(F.lit(False))
    return jobs.digest_of(
        jobs.plan_current(testbed.files(spark, folder), empty, options, testbed.RUN_TIME, everything=True)
    )


# ---- sources and sinks ---------------------------------------------------------------

@query
def corpus_scan(spark, folder):
    return _all_files(spark, folder).select(
        *KEY, "size", F.date_format("modified_time", fv.STAMP_FORMAT).alias("modified"), "checksum"
    )


@query
def tree_listing(spark, folder):
    """Documents written as file trees by tasks, walked and read again."""
    roots = testbed.write_trees(spark, folder)
    return tree.read_contents(tree.list_corpora(spark, roots)).select(*KEY, "size", "checksum")


@query
def store_listing(spark, folder):
    """Documents written to a store by tasks, listed and read by tasks from a table of roots."""
    return stores.read_stores(stores.list_stores(testbed.write_stores(spark, folder))).select(*KEY, "size", "checksum")


@query
def ignore_rules(spark, folder):
    return _rules(spark, folder)


@query
def digest_lines(spark, folder):
    stored = testbed.state(spark, folder)
    totals = stored.groupBy("corpus_id").agg(F.count(F.lit(1)).alias("total"))
    return dg.digest_lines(stored, totals, testbed.RUN_TIME)


@query
def digest_import(spark, folder):
    """Digests in parts of bounded length, read as if each were one text."""
    return _dated(import_digest(dg.digest_documents(digest_lines(spark, folder), testbed.PART_BYTES)))


# ---- filters -------------------------------------------------------------------------

@query
def digest_files(spark, folder):
    """Digests written by tasks, one file a corpus on a mount, and read back in byte ranges."""
    top = staging_path(spark, "digest-files").removeprefix("file:")
    lines = digest_lines(spark, folder)
    path = F.concat(F.lit(f"{top}/"), "corpus_id", F.lit(f"/{fv.DIGEST_FILE}"))
    paths = staged(lines.select("corpus_id").distinct().withColumn("path", path), "digest-paths")
    write_digest_files(lines, paths, testbed.PART_BYTES)
    return _dated(import_digest(read_digest_texts(spark, {row.corpus_id: f"file:{row.path}" for row in paths.collect()})))


@query
def ignore_match(spark, folder):
    return _all_files(spark, folder).select(
        *KEY, ignore.is_ignored(F.col("relative_path")).alias("ignored")
    )


@query
def ignore_match_by_corpus(spark, folder):
    ruled = ignore.with_corpus_rules(testbed.files(spark, folder).select(*KEY), _own_rules(spark, folder))
    return ruled.where(ignore.own_rules_hit()).select(*KEY)


@query
def scan_class(spark, folder):
    return _all_files(spark, folder).select(*KEY, ignore.scan_class(F.col("relative_path")).alias("scan_class"))


@query
def scan_class_by_corpus(spark, folder):
    files = testbed.files(spark, folder).select(*KEY)
    return ignore.with_scan_class(files, _own_rules(spark, folder))


@query
def own_output(spark, folder):
    """Current files where the digest has the name of one of them."""
    return jobs.current_files(testbed.files(spark, folder).select(*KEY), output_file="out/doc_0.py").select(*KEY)


@query
def text_only(spark, folder):
    return _texts(spark, folder).where(~tx.is_binary(F.col("text"))).select(
        *KEY, F.length("text").cast("long").alias("characters")
    )


@query
def oversize(spark, folder):
    return _all_files(spark, folder).where(
        tx.exceeds_limit(F.col("size"), MOCK.max_file_size_mb)
    ).select(*KEY, "size")


@query
def needs_update(spark, folder):
    return status.needs_update(
        _current(spark, folder), testbed.state(spark, folder)
    ).select(*KEY, "status")


@query
def needs_update_strict(spark, folder):
    return status.needs_update(
        _current(spark, folder), testbed.state(spark, folder), strict=True
    ).select(*KEY, "checksum")


@query
def below_threshold(spark, folder):
    return _texts(spark, folder).where(
        route.below_threshold(F.col("text"), fv.TOKEN_THRESHOLD)
    ).select(*KEY)


@query
def drop_failed(spark, folder):
    return summarise.drop_failed(testbed.results(spark, folder))


# ---- projections ---------------------------------------------------------------------

@query
def checksum(spark, folder):
    return testbed.files(spark, folder).select(*KEY, tx.checksum(F.col("content")).alias("checksum"))


@query
def decode_text(spark, folder):
    """Valid UTF-8 for most documents, invalid bytes in front of every third."""
    content = F.encode("text", "UTF-8")
    broken = F.when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.lit("FFFE20")), content)).otherwise(content)
    return testbed.read_table(spark, folder, "documents").select("doc_id", tx.decode(broken).alias("text"))


@query
def size_label(spark, folder):
    size = F.col("size")
    return _all_files(spark, folder).select(
        *KEY,
        tx.size_label(size).alias("as_is"),
        tx.size_label(F.pmod(size, F.lit(1100))).alias("small"),
        tx.size_label(size * 1024).alias("large"),
    )


@query
def modified_label(spark, folder):
    return testbed.files(spark, folder).select(*KEY, tx.modified_label(F.col("modified_time")).alias("modified"))


@query
def normalise_newlines(spark, folder):
    return testbed.files(spark, folder).select(*KEY, tx.normalise_newlines(tx.decode(F.col("content"))).alias("text"))


@query
def token_estimate(spark, folder):
    return _texts(spark, folder).select(*KEY, tx.token_estimate(F.col("text")).alias("tokens"))


@query
def route_files(spark, folder):
    return route.with_route(_current(spark, folder), MOCK).select(*KEY, "route", "payload")


@query
def oversize_message(spark, folder):
    return _all_files(spark, folder).select(
        *KEY,
        tx.oversize_message(F.col("size") * 1021, 10.0).alias("message"),
        tx.oversize_message(F.col("size") * 262144, 0.5).alias("tie_message"),
    )


@query
def chat_request(spark, folder):
    request = chat.chat_request(F.col("relative_path"), F.col("text"), MODEL.model)
    return _texts(spark, folder).select(*KEY, request.alias("r")).select(
        *KEY,
        F.get_json_object("r", "$.model").alias("model"),
        F.get_json_object("r", "$.messages[0].content").alias("instruction"),
        F.get_json_object("r", "$.messages[1].role").alias("role"),
        F.get_json_object("r", "$.messages[1].content").alias("question"),
        F.get_json_object("r", "$.temperature").cast("double").alias("temperature"),
        F.get_json_object("r", "$.max_tokens").cast("int").alias("max_tokens"),
    )


@query
def chat_response(spark, folder):
    return testbed.attempts(spark, folder).select(
        *KEY, "attempt",
        chat.chat_answer(F.col("status_code"), F.col("body"), F.col("relative_path")).alias("answer"),
    )


@query
def error_class(spark, folder):
    return testbed.attempts(spark, folder).select(
        *KEY, "attempt",
        chat.attempt_error(F.col("status_code"), F.col("error_kind"), F.col("body"), MODEL.timeout).alias("error"),
    )


@query
def strip_header(spark, folder):
    return _texts(spark, folder).select(
        *KEY, entries.strip_header(F.col("text"), F.col("relative_path")).alias("content")
    )


@query
def entry_format(spark, folder):
    return dg.rendered(testbed.state(spark, folder))


@query
def entry_path(spark, folder):
    texts = dg.rendered(testbed.state(spark, folder)).select("corpus_id", F.col("entry").alias("t"))
    plain = testbed.results(spark, folder).select("corpus_id", F.col("summary").alias("t"))
    return texts.union(plain).select(
        "corpus_id", entries.entry_path(F.col("t")).alias("relative_path")
    ).where(F.col("relative_path").isNotNull())


# ---- joins and merges ----------------------------------------------------------------

@query
def file_status(spark, folder):
    return _statuses(spark, folder).select(*KEY, "status")


@query
def new_files(spark, folder):
    return status.new_files(_current(spark, folder), testbed.state(spark, folder)).select(*KEY)


@query
def stale_entries(spark, folder):
    return status.stale_entries(testbed.state(spark, folder), _current(spark, folder)).select(*KEY)


@query
def digest_merge(spark, folder):
    return _dated(dg.merge_current(
        _current(spark, folder), _fresh(spark, folder, MOCK), testbed.state(spark, folder)
    ))


@query
def digest_upsert(spark, folder):
    return _dated(dg.merge_all(_fresh(spark, folder, MOCK), testbed.state(spark, folder)))


# ---- counts and lists ----------------------------------------------------------------

@query
def status_counts(spark, folder):
    return report.status_counts(_statuses(spark, folder))


@query
def scan_counts(spark, folder):
    classified = ignore.with_scan_class(testbed.files(spark, folder).select(*KEY))
    return report.scan_counts(classified, _rules(spark, folder))


@query
def outcome_counts(spark, folder):
    """Outcomes of the files with attempts; conversations without an assistant turn are pending."""
    asked = testbed.read_table(spark, folder, "conversations").select(
        F.concat(F.lit("c"), (F.col("conv_id") % 4).cast("string")).alias("corpus_id"),
        F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("relative_path"),
    ).distinct()
    results = summarise.fold_attempts(testbed.attempts(spark, folder), MODEL).select(*KEY, F.col("summary").isNotNull().alias("done"))
    outcomes = asked.join(results, KEY, "left").withColumn("outcome", report.outcome())
    return report.outcome_counts(outcomes)


@query
def completion_stats(spark, folder):
    return report.completion_stats(jobs.plan_current(
        testbed.files(spark, folder), testbed.state(spark, folder), MOCK, testbed.RUN_TIME
    ))


@query
def digest_document(spark, folder):
    return dg.digest_documents(digest_lines(spark, folder), testbed.PART_BYTES)


@query
def attention_list(spark, folder):
    return report.attention_list(
        _statuses(spark, folder, by_source=True).select(*KEY, "status")
    )


@query
def run_plan(spark, folder):
    due = status.needs_update(
        _current(spark, folder, by_source=True), testbed.state(spark, folder, by_source=True)
    )
    return report.run_plan(due.select(*KEY, "status"))


# ---- summaries -----------------------------------------------------------------------

@query
def mock_digest(spark, folder):
    return _dated(_fresh(spark, folder, MOCK))


@query
def copy_digest(spark, folder):
    return _dated(_fresh(spark, folder, COPY))


@query
def retry_outcome(spark, folder):
    return summarise.fold_attempts(testbed.attempts(spark, folder), MODEL)


@query
def model_answers(spark, folder):
    texts = add_once(route.with_text(_current(spark, folder)), route=route.route(MODEL))
    asked = texts.where(F.col("route") == route.SUMMARISE)
    return summarise.call_model(asked, MODEL, testbed.UnsteadyClient())


# ---- jobs ----------------------------------------------------------------------------

@query
def status_report(spark, folder):
    return jobs.status_job(
        testbed.files(spark, folder), testbed.state(spark, folder), _rules(spark, folder),
        _own_rules(spark, folder),
    ).counts


@query
def status_attention(spark, folder):
    return jobs.status_job(
        testbed.files(spark, folder), testbed.state(spark, folder), _rules(spark, folder)
    ).attention


@query
def status_together(spark, folder):
    """Counts and attention list of each corpus in one row."""
    both = jobs.status_job(
        testbed.files(spark, folder), testbed.state(spark, folder), _rules(spark, folder), _own_rules(spark, folder)
    ).together
    lines = F.transform("listed", lambda e: F.concat_ws("|", e.relative_path, e.size, e.modified, e.status))
    return both.withColumn("listed", F.array_join(lines, "\n"))


def _after_stored_update(spark: SparkSession, folder: str) -> StateStore:
    store = StateStore(spark, staging_path(spark, "stored-update"))
    store.write(testbed.state(spark, folder))
    jobs.run_job(testbed.files(spark, folder), store, MOCK, testbed.RUN_TIME)
    return store


@query
def stored_update(spark, folder):
    """An update of a stored digest, of which only the changes are written, read back."""
    return _dated(_after_stored_update(spark, folder).read())


@query
def stored_run_log(spark, folder):
    return _after_stored_update(spark, folder).run_log().select(*KEY, "status", "route", "outcome")


@query
def update_digest(spark, folder):
    return _dated(jobs.digest_of(jobs.plan_run(
        testbed.files(spark, folder), testbed.state(spark, folder), MOCK, testbed.RUN_TIME
    )))


@query
def rebuild_digest(spark, folder):
    return _dated(jobs.digest_of(jobs.plan_run(
        testbed.files(spark, folder), testbed.state(spark, folder), MOCK, testbed.RUN_TIME, everything=True
    )))


@query
def process_files_update(spark, folder):
    return jobs.process_files(
        _current(spark, folder), testbed.state(spark, folder), MOCK, testbed.RUN_TIME, "update"
    )


# The table that names the operators calls this one "route".
QUERIES["route"] = QUERIES.pop("route_files")
