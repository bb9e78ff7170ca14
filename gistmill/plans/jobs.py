"""Whole jobs: status, update, rebuild.

A run first compares keys and checksums with those of the stored digest, which are short
rows, and so knows which files are due.  Only their contents are decoded, routed and turned
into entries; contents that did not change stay where they are.
"""

from __future__ import annotations

import contextlib
import dataclasses
import datetime
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill import fixed_values as fv
from gistmill.functions import text as tx
from gistmill.operators import ignore, report, route, status
from gistmill.operators.digest import rendered, stamp
from gistmill.operators.key_filter import FilterSize, filter_words, may_be_key
from gistmill.operators.skew import join_by_corpus
from gistmill.operators.summarise import AnswerLog, ChatClient, call_model, ready_content
from gistmill.options import DigestMode, DigestOptions
from gistmill.schemas import ENTRY, KEY, LISTING, STATE
from gistmill.session import Staging
from gistmill.sources.tables import StateStore


#: Versions that a digest may be made of before it is written as one again.
COMPACT_AFTER = 16


def current_files(files: DataFrame, own_rules: DataFrame | None = None, output_file: str = fv.DIGEST_FILE) -> DataFrame:
    """Files that the rules keep, the digest's own file left out."""
    return ignore.kept(ignore.with_scan_class(files, own_rules, own_output=os.path.basename(output_file)))


def compared(current: DataFrame, state: DataFrame, everything: bool = False, strict: bool = False) -> DataFrame:
    """``corpus_id, relative_path, checksum, status, due`` of each current file, from short rows on both sides."""
    rows = status.with_status(current.select(*KEY, "checksum"), state)
    due = F.lit(True) if everything else status.is_due(strict)
    return rows.select(*KEY, "checksum", "status", due.alias("due"))


def due_only(files: DataFrame, keys: DataFrame, everything: bool) -> DataFrame:
    """Files, with their contents, that are due; few keys reach the scan, many are joined."""
    if everything:
        return files
    return files.join(keys.where("due").select(*KEY), KEY, "left_semi")


def near_due(files: DataFrame, changes: DataFrame, staging: Staging) -> DataFrame:
    """Files that are due, and a few others: the rest leave in the scan, before any join moves their contents."""
    keys = changes.where("due").select(*KEY)
    size = FilterSize.of(keys.count())
    return files.where(may_be_key(staging.keep(filter_words(keys, size), "due-keys"), size))


def routed(files: DataFrame, options: DigestOptions, *more: str) -> DataFrame:
    """``corpus_id, relative_path, route, ready, is_ready``: entry content where no model is needed; and ``more`` of the files."""
    ready = ready_content(options)
    return route.with_route(files, options).select(
        *KEY, "route", ready.alias("ready"), ready.isNotNull().alias("is_ready"), *more
    )


def _fresh(run_time: datetime.datetime, content: Column) -> Column:
    return F.struct(stamp(run_time).alias("summary_date"), F.col("checksum"), content.alias("content"))


def conclude(rows: DataFrame, state: DataFrame, content: Column, done: Column, run_time: datetime.datetime) -> DataFrame:
    """Run log: per current file its status, route, outcome and resulting entry.

    Files that are not due have neither route nor outcome.  The entry columns are NULL where
    a file got no entry now and had none before.  ``done`` says whether ``content`` is there,
    so that counting outcomes moves no contents.
    """
    finished = rows.withColumn("done", F.col("due") & F.coalesce(done, F.lit(False)))
    stored = state.select(*KEY, F.struct(*ENTRY.fieldNames()).alias("stored"))
    return finished.join(stored, KEY, "left").select(
        *KEY, "status", "route",
        F.when(F.col("due"), report.outcome()).alias("outcome"),
        F.when(F.col("done"), _fresh(run_time, content)).otherwise(F.col("stored")).alias("entry"),
    ).select(*KEY, "status", "route", "outcome", "entry.*")


def with_untouched(log: DataFrame, state: DataFrame, names: DataFrame) -> DataFrame:
    """Add the stored entries of corpora without any current file; a run leaves them alone.

    Usually there are none, and nothing is left of this side once their names are known.
    ``names`` has the keys of the current files.
    """
    stored, present = state.select("corpus_id").distinct(), names.select("corpus_id").distinct()
    absent = stored.join(present, "corpus_id", "left_anti")
    return log.unionByName(join_by_corpus(state, absent, "left_semi"), allowMissingColumns=True)


def plan_current(
    files: DataFrame,
    state: DataFrame,
    options: DigestOptions,
    run_time: datetime.datetime,
    everything: bool = False,
    strict: bool = False,
    own_rules: DataFrame | None = None,
) -> DataFrame:
    """Run log of the current files, for modes that need no model."""
    current = current_files(files, own_rules, options.output_file)
    keys = compared(current, state, everything, strict)
    # rules per corpus have been at work on the keys; they need not see the contents
    made = routed(due_only(current_files(files, None, options.output_file), keys, everything), options)
    return conclude(keys.join(made, KEY, "left"), state, F.col("ready"), F.col("is_ready"), run_time)


def plan_run(
    files: DataFrame,
    state: DataFrame,
    options: DigestOptions,
    run_time: datetime.datetime,
    everything: bool = False,
    own_rules: DataFrame | None = None,
    names: DataFrame | None = None,
) -> DataFrame:
    """Run log of an update, or of a rebuild with ``everything``.

    ``names`` may give the keys and sizes of the files where ``files`` itself cannot leave
    out the contents, as when they are read from a file tree.
    """
    log = plan_current(files, state, options, run_time, everything, own_rules=own_rules)
    return with_untouched(log, state, current_files(files if names is None else names, own_rules, options.output_file))


def digest_of(log: DataFrame) -> DataFrame:
    """Digest rows of a run log."""
    return log.where(F.col("content").isNotNull()).select(*STATE.fieldNames())


def process_files(
    files: DataFrame,
    state: DataFrame,
    options: DigestOptions,
    run_time: datetime.datetime,
    mode: str = "all",
) -> DataFrame:
    """Fresh entries as text for given files, without rules and without a merge.

    ``update`` takes the files that are due, a missing stored checksum included; ``status``
    gives no rows; anything else takes all files.
    """
    if mode == "status":
        files = files.where(F.lit(False))
    keys = compared(files, state, mode != "update", strict=True)
    made = routed(due_only(files, keys, mode != "update"), options).where("is_ready")
    return rendered(made.join(keys.select(*KEY, "checksum"), KEY).select(*KEY, _fresh(run_time, F.col("ready")).alias("fresh")).select(*KEY, "fresh.*"))


@dataclasses.dataclass(frozen=True)
class StatusReport:
    """``counts`` and ``attention`` are cheapest one by one; ``together`` has both for one evaluation of the input."""

    counts: DataFrame
    attention: DataFrame
    together: DataFrame


def status_job(
    files: DataFrame, state: DataFrame, rules: DataFrame, own_rules: DataFrame | None = None, output_file: str = fv.DIGEST_FILE
) -> StatusReport:
    """Counts and attention list; reads only, and needs no key.

    ``rules`` has the rules in force per corpus, for their number.
    """
    seen = ignore.with_scan_class(files, own_rules, own_output=os.path.basename(output_file)).where(F.col("scan_class") != "pruned")
    is_kept = F.col("scan_class") == "kept"
    with_class = status.with_previous(
        seen.withColumn("checksum", F.when(is_kept, F.col("checksum"))), state
    ).withColumn("status", F.when(is_kept, status.file_status()))
    is_one = {name: F.col("status") == value for name, value in
              (("up_to_date", status.UP_TO_DATE), ("outdated", status.OUTDATED), ("new", status.NEW))}
    is_one["ignored"] = F.col("status").isNull()
    counts = with_class.groupBy("corpus_id").agg(*[F.count_if(condition).alias(name) for name, condition in is_one.items()])
    patterns = rules.groupBy("corpus_id").agg(F.count_distinct("pattern").alias("patterns"))
    shown = [tx.size_label(F.col("size")).alias("size"), tx.modified_label(F.col("modified_time")).alias("modified"), "status"]
    statuses = with_class.select(*KEY, "size", "modified_time", "status")
    listed = report.attention_list(statuses.where(F.col("status").isNotNull())).select(*KEY, *shown, "files", "due", "more")
    both = report.attention_with_counts(statuses, is_one, F.struct("relative_path", *shown))
    return StatusReport(
        counts.join(patterns, "corpus_id", "left"), listed, both.join(patterns, "corpus_id", "left")
    )


def changed(current: DataFrame, present: DataFrame, state: DataFrame, everything: bool = False) -> DataFrame:
    """``corpus_id, relative_path, status, due, origin`` of the files that are due and of entries whose file is gone.

    Short rows of both sides meet in one join.  ``present`` has the corpora with files; entries of
    others are left alone.  ``origin`` is the version that holds the entry so far.
    """
    stored = state.select(*KEY, F.lit(True).alias("known"), F.col("checksum").alias("previous_checksum"), "origin")
    both = current.select(*KEY, "checksum", F.lit(True).alias("is_there")).join(stored, KEY, "full")
    due = F.col("is_there") if everything else F.col("is_there") & status.is_due()
    rows = both.select(
        *KEY, F.when(F.col("is_there"), status.file_status()).alias("status"), F.coalesce(due, F.lit(False)).alias("due"), "origin"
    ).where(F.col("due") | F.col("status").isNull())
    beside = join_by_corpus(rows, present.select("corpus_id", F.lit(True).alias("has_files")), "left")
    return beside.where(F.col("due") | F.col("has_files")).drop("has_files")


def run_job(
    files: DataFrame,
    store: StateStore,
    options: DigestOptions,
    run_time: datetime.datetime,
    everything: bool = False,
    own_rules: DataFrame | None = None,
    names: DataFrame | None = None,
    client: ChatClient | None = None,
    fetch: Callable[[DataFrame], DataFrame] | None = None,
    tasks: int | None = None,
    compact_after: int = COMPACT_AFTER,
) -> int:
    """Run an update, or a rebuild with ``everything``, and store the new version.

    An update writes what it worked on and which entries no longer hold, and reads no stored
    contents; every ``compact_after`` versions they are put together.  A rebuild starts a new
    base.  Deletions are applied even when nothing else changed.  With a model the run writes
    what is due, the routes, the answers, and the new version; whatever is lost is computed
    again from the last of them.  Answers are logged as they come, so the run after a lost one
    asks for the others only.  ``client`` makes the calls and is needed only then.
    ``names`` may give the keys and sizes of the files where ``files`` itself cannot leave out
    the contents, as when they are read from a file tree.  ``fetch`` reads the contents of
    listed files, so that only the files to be summarised are opened again; without it
    ``files`` is scanned again for them.
    """
    options.require_key()
    if options.mode is DigestMode.AI and client is None:
        raise ValueError("summarising with a model needs a client")
    state = store.read(origin=True)
    with contextlib.closing(Staging(files.sparkSession)) as staging:
        current = current_files(files, own_rules, options.output_file)
        seen = current if names is None else current_files(names, own_rules, options.output_file)
        present = seen.select("corpus_id").distinct()
        changes = staging.keep(changed(current, present, state, everything), "changes")
        # rules per corpus have been at work on the keys; they need not see the contents
        contents = current_files(files, None, options.output_file)
        if not everything:
            contents = near_due(contents, changes, staging)
        due = due_only(contents, changes, everything)
        if options.mode is DigestMode.AI:
            made = _asked(due if own_rules is None else due.join(changes.where("due").select(*KEY), KEY, "left_semi"),
                          contents, options, client, fetch, tasks, staging, AnswerLog(store.answers()))
        else:
            made = routed(due, options, "checksum")
        entry = F.when(F.col("is_ready"), _fresh(run_time, F.col("ready")))
        worked = made.join(changes.where("due").select(*KEY, "status"), KEY).withColumn("done", F.coalesce("is_ready", F.lit(False)))
        return _store_run(store, worked.select(*KEY, "status", "route", report.outcome().alias("outcome"), entry.alias("entry")).select(
            *KEY, "status", "route", "outcome", "entry.*"
        ), changes, present, state, everything, staging, compact_after)


def _asked(
    due: DataFrame, files: DataFrame, options: DigestOptions, client: ChatClient, fetch: Callable[[DataFrame], DataFrame] | None,
    tasks: int | None, staging: Staging, log: AnswerLog,
) -> DataFrame:
    """What ``routed`` gives, with the model's answers where there was nothing ready."""
    listing = [name for name in LISTING.fieldNames() if name not in KEY]
    made = staging.keep(routed(due, options, "checksum", *listing), "routed")
    asked = made.where(F.col("route") == route.SUMMARISE)
    contents = files.join(asked.select(*KEY), KEY, "left_semi") if fetch is None else fetch(asked.select(*LISTING.fieldNames()))
    answers = staging.keep(call_model(route.with_text(contents), options, client, tasks, log), "answers")
    return made.drop(*listing).join(answers.select(*KEY, "summary"), KEY, "left").select(
        *KEY, "route", "checksum", F.coalesce("ready", "summary").alias("ready"),
        (F.col("is_ready") | F.col("summary").isNotNull()).alias("is_ready"),
    )


def _store_run(
    store: StateStore, worked: DataFrame, changes: DataFrame, present: DataFrame, state: DataFrame, everything: bool, staging: Staging,
    compact_after: int,
) -> int:
    earlier = store.versions()
    parts = store.parts(earlier[-1]) if earlier else []
    carried = store.begin()
    version = carried + 1 if everything and parts else carried
    rows = store.put(version, "rows", worked)
    store.put(version, "corpora", present)
    if not parts:
        return store.finish(version, [version])
    written = rows.where(F.col("summary_date").isNotNull()).select(*KEY)
    replaced = changes.where("due AND origin IS NOT NULL").join(written, KEY, "left_semi")
    dropped = replaced.unionByName(changes.where("NOT due")).select(*KEY, "origin")
    if everything:
        # a base holds all that is left of earlier versions: usually little, so contents are looked up by key
        left = staging.keep(state.select(*KEY).join(dropped.select(*KEY), KEY, "left_anti"), "carried")
        store.put(carried, "rows", state.join(left, KEY, "left_semi"))
        store.put(version, "dropped", dropped.where(F.lit(False)))
        return store.finish(version, [carried, version])
    store.put(version, "dropped", dropped)
    store.finish(version, [*parts, version])
    return version if len(parts) < compact_after else store.compact()
