"""Comparison of the current snapshot with the stored digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.schemas import ENTRY, KEY

NEW, OUTDATED, UP_TO_DATE = "new", "outdated", "up-to-date"


def with_previous(files: DataFrame, state: DataFrame) -> DataFrame:
    """Add the stored entry of each file as ``known`` and three ``previous_…`` columns.

    ``known`` is NULL where there is no entry, which differs from an entry without a
    checksum.  The columns stay apart so that a plan that only compares checksums leaves
    the stored contents in their table; :func:`previous_entry` puts them together.
    """
    stored = state.select(
        *KEY, F.lit(True).alias("known"),
        *[F.col(name).alias(f"previous_{name}") for name in ENTRY.fieldNames()],
    )
    return files.join(stored, KEY, "left")


def previous_entry() -> Column:
    """Stored entry as one value, so that date, checksum and content stay together."""
    return F.when(F.col("known"), F.struct(
        *[F.col(f"previous_{name}").alias(name) for name in ENTRY.fieldNames()]
    ))


def _differs(missing_differs: bool) -> Column:
    stored = F.nullif(F.col("previous_checksum"), F.lit(""))
    return F.coalesce(F.col("checksum") != stored, F.lit(missing_differs))


def file_status() -> Column:
    """``new``, ``outdated`` or ``up-to-date``; no stored checksum means up to date."""
    return (
        F.when(F.col("known").isNull(), F.lit(NEW))
        .when(_differs(False), F.lit(OUTDATED))
        .otherwise(F.lit(UP_TO_DATE))
    )


def with_status(files: DataFrame, state: DataFrame) -> DataFrame:
    """Add the stored entry and ``status`` to files that have a ``checksum``."""
    return with_previous(files, state).withColumn("status", file_status())


def is_due(strict: bool = False) -> Column:
    """Whether a file beside its stored entry needs an update; ``strict`` distrusts a missing checksum."""
    return F.col("known").isNull() | _differs(strict)


def needs_update(files: DataFrame, state: DataFrame, strict: bool = False) -> DataFrame:
    return with_status(files, state).where(is_due(strict)).select(*files.columns, "status")


def new_files(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files without any stored entry."""
    return files.join(state.select(*KEY), KEY, "left_anti")


def stale_entries(state: DataFrame, files: DataFrame) -> DataFrame:
    """Stored entries whose file is gone."""
    return state.join(files.select(*KEY), KEY, "left_anti")
