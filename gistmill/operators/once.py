"""Costly columns that later steps use several times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add_once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed exactly once per row.

    A filter on a plain computed column is pushed below the projection, and the expression
    copied into it wherever the column occurs; for decoded texts that multiplies the work,
    and generated code outgrows what the JVM compiles.  A one-row generator holds the
    columns in place and is part of the same generated code.
    """
    fields = [column.alias(name) for name, column in columns.items()]
    return rows.select("*", F.inline(F.array(F.struct(*fields))))
