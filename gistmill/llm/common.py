"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows handed to a Python worker at a time; a batch of long texts has to fit beside the heap.
BATCH_ROWS = 512

#: Word of the contracts: anything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of one Arrow batch; changes speed and memory only."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def whole_row(rows: DataFrame) -> Column:
    """All columns as one."""
    return F.struct(*[F.col("`" + name.replace("`", "``") + "`") for name in rows.columns])


def chunked(rows: Iterable, size: int) -> Iterator[list]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def with_running_total(ranged: DataFrame, by: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over the rows before this one, within ``by``.

    ``ranged`` has been dealt by range of ``by`` and the order, numbered by partition in a
    column ``_part`` and written, so that the numbers stay.  Every partition is summed on
    its own; only one row for each partition and ``by`` meets in the second window.
    """
    parts = ranged.groupBy(*by, "_part").agg(F.sum(value).alias("_sum"))
    above = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = above.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = reduce(lambda a, b: a & b, [summed[c].eqNullSafe(parts[c]) for c in [*by, "_part"]])
    keep = [summed[c] for c in summed.columns if c != "_inside"]
    return summed.join(parts, same).select(*keep, (F.col("_before") + F.col("_inside")).alias(name))
