"""Joins of files with one row per corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# One corpus may hold a large part of all files; its rows are dealt over this many tasks.
SALTS = 32


def join_by_corpus(files: DataFrame, per_corpus: DataFrame, how: str = "inner") -> DataFrame:
    """Join files with a table of one row per corpus without gathering a corpus in one task.

    The number of corpora has no bound, so nothing is broadcast by hand: the adaptive
    planner does so when the small side turns out to be small, and otherwise every corpus
    is spread over ``SALTS`` tasks by the hash of the path.
    """
    salt = F.pmod(F.xxhash64("relative_path"), F.lit(SALTS)).cast("int")
    spread = per_corpus.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (
        files.withColumn("_salt", salt)
        .join(spread, ["corpus_id", "_salt"], how)
        .drop("_salt")
    )
