"""Counts and short lists about a run.

Counts alone combine before the shuffle.  Lists with counts evaluate their input once: a
corpus is dealt over many groups by the hash of the path, each group ranks and counts its
rows, and only its first few, the first of them with the group's counts, meet the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill import fixed_values as fv
from gistmill.operators.status import NEW, OUTDATED, UP_TO_DATE


def _count(condition: Column) -> Column:
    return F.count_if(condition).cast("long")


# Groups of a corpus, which may hold a large part of all files.
GROUPS = 512


def first_with_counts(rows: DataFrame, limit: int, kind: Column, **counts: Column) -> DataFrame:
    """First rows in path order per corpus and ``kind``, their ``rank``, and counts over the whole corpus.

    Every corpus has its counts on each of its rows; conditions in ``counts`` are counted.
    """
    dealt = rows.withColumn("_kind", kind).withColumn("_group", F.pmod(F.xxhash64("relative_path"), F.lit(GROUPS)).cast("int"))
    group = Window.partitionBy("corpus_id", "_group")
    place = F.row_number().over(group.orderBy("_kind", "relative_path"))
    rank = F.row_number().over(Window.partitionBy("corpus_id", "_group", "_kind").orderBy("relative_path"))
    first = dealt.select(
        *rows.columns, "_kind", place.alias("_place"), rank.alias("rank"),
        *[F.count_if(condition).over(group).alias(name) for name, condition in counts.items()],
    ).where(F.col("rank") <= limit)
    corpus = Window.partitionBy("corpus_id")
    rank = F.row_number().over(Window.partitionBy("corpus_id", "_kind").orderBy("relative_path"))
    return first.select(
        *rows.columns, rank.alias("rank"),
        *[F.sum(F.when(F.col("_place") == 1, F.col(name)).otherwise(0)).over(corpus).cast("long").alias(name) for name in counts],
    ).where(F.col("rank") <= limit)


def status_counts(statuses: DataFrame) -> DataFrame:
    """Files per status, with zeros."""
    return statuses.groupBy("corpus_id").agg(
        _count(F.col("status") == UP_TO_DATE).alias("up_to_date"),
        _count(F.col("status") == OUTDATED).alias("outdated"),
        _count(F.col("status") == NEW).alias("new"),
    )


def scan_counts(classified: DataFrame, rules: DataFrame) -> DataFrame:
    """Kept and ignored files and rules per corpus; files below pruned directories count nowhere."""
    files = classified.groupBy("corpus_id").agg(
        _count(F.col("scan_class") == "kept").alias("kept"),
        _count(F.col("scan_class") == "ignored").alias("ignored"),
    )
    patterns = rules.groupBy("corpus_id").agg(F.count_distinct("pattern").alias("patterns"))
    return files.join(patterns, "corpus_id", "left").select(
        "corpus_id", "kept", "ignored", F.coalesce("patterns", F.lit(0)).cast("long").alias("patterns")
    )


def outcome() -> Column:
    """Outcome of a file of a run: no result yet, an entry, or a failure."""
    return (
        F.when(F.col("done").isNull(), F.lit("pending"))
        .when(F.col("done"), F.lit("completed"))
        .otherwise(F.lit("error"))
    )


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """Files per outcome; no file counts twice."""
    return outcomes.groupBy("corpus_id").agg(
        _count(F.col("outcome") == "completed").alias("completed"),
        _count(F.col("outcome") == "error").alias("error"),
        _count(F.col("outcome") == "pending").alias("pending"),
    )


def completion_stats(run: DataFrame) -> DataFrame:
    """Files that got a fresh entry, and files that were up to date."""
    return run.groupBy("corpus_id").agg(
        _count(F.col("outcome") == "completed").alias("processed"),
        _count(F.col("status") == UP_TO_DATE).alias("up_to_date"),
    )


def attention_list(
    statuses: DataFrame,
    small_corpus: int = fv.SMALL_CORPUS_FILES,
    shown: int = fv.ATTENTION_ROWS,
) -> DataFrame:
    """All files of small corpora; of others the first few that need an update.

    ``more`` counts the files needing an update beyond those shown.
    """
    is_due, is_small = F.col("status").isin(NEW, OUTDATED), F.col("files") <= small_corpus
    # the first due files and the first others hold both kinds of list
    first = first_with_counts(statuses, max(small_corpus, shown), is_due, files=F.lit(True), due=is_due)
    more = F.when(is_small, F.lit(0)).otherwise(F.greatest(F.col("due") - shown, F.lit(0))).cast("long")
    return first.where(is_small | (is_due & (F.col("rank") <= shown))).withColumn("more", more).drop("rank")


def attention_with_counts(
    statuses: DataFrame, counts: dict[str, Column], entry: Column,
    small_corpus: int = fv.SMALL_CORPUS_FILES, shown: int = fv.ATTENTION_ROWS,
) -> DataFrame:
    """One row a corpus: its counts, ``files, due, more``, and ``listed``, the ``entry`` of each file of its attention list.

    Rows without a status, which are ignored files, are counted and never listed.
    """
    is_due = F.col("status").isin(NEW, OUTDATED)
    kind = F.when(is_due, 0).when(F.col("status").isNotNull(), 1).otherwise(2)
    first = first_with_counts(
        statuses, max(small_corpus, shown), kind, **counts, files=F.col("status").isNotNull(), due=is_due
    )
    is_small = F.col("files") <= small_corpus
    is_listed = F.when(is_small, F.col("status").isNotNull()).otherwise(is_due & (F.col("rank") <= shown))
    # every count stands on each row of its corpus
    names = [*counts, "files", "due"]
    rows = first.groupBy("corpus_id").agg(
        *[F.max(name).alias(name) for name in names], F.array_sort(F.collect_list(F.when(is_listed, entry))).alias("listed")
    )
    more = F.when(is_small, F.lit(0)).otherwise(F.greatest(F.col("due") - shown, F.lit(0))).cast("long")
    return rows.select("corpus_id", *names, more.alias("more"), "listed")


def run_plan(due_files: DataFrame, short: int = fv.SHORT_PLAN_ROWS) -> DataFrame:
    """Files about to be processed: each one where they are few, else one row with their number."""
    is_short = F.col("to_process") <= short
    first = first_with_counts(due_files, short, F.lit(0), to_process=F.lit(True)).where(is_short | (F.col("rank") == 1))
    listed = [F.when(is_short, F.col(name)).alias(name) for name in due_files.columns if name != "corpus_id"]
    return first.select("corpus_id", *listed, "to_process")
