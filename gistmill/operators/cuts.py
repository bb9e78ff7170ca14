"""Cutting the sorted rows of each corpus into parts of about equal weight.

The cuts are exact and depend on the rows alone.  A bounded sample of each corpus gives
ranges of paths to work in, whatever the size of the corpus; weights are summed inside the
ranges, the sums of the ranges are added up in front of them, and a part begins with the
first row behind each multiple of the weight.  Nothing is evaluated while the plan is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.operators.skew import join_by_corpus

#: Rows of a corpus that are sampled, and how many of them make a range.
SAMPLE, SAMPLES_PER_RANGE = 16_384, 8

#: Groups that the rows of a corpus are dealt over to be sampled.
SAMPLE_GROUPS = 512


def places_up_to(ascending: Column, value: Column, bits: int) -> Column:
    """How many elements of a sorted array, of fewer than ``2 ** bits``, are at most ``value``."""
    steps = F.array(*[F.lit(1 << bit) for bit in reversed(range(bits))])

    def step(at: Column, by: Column) -> Column:
        fits = (at + by <= F.size(ascending)) & (F.get(ascending, at + by - 1) <= value)
        return F.when(fits, at + by).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def range_bounds(rows: DataFrame, sample: int = SAMPLE, per_range: int = SAMPLES_PER_RANGE) -> DataFrame:
    """``corpus_id, bounds``: paths that cut the rows of a corpus into about even ranges.

    The sample has the smallest hashes of each group of a corpus; tasks drop the others before
    the shuffle, and the groups of a large corpus are spread over all tasks.
    """
    groups = min(SAMPLE_GROUPS, sample)
    order = Window.partitionBy("corpus_id", "_group").orderBy(F.xxhash64("relative_path"), "relative_path")
    dealt = rows.select("corpus_id", "relative_path", F.pmod(F.hash("relative_path"), F.lit(groups)).alias("_group"))
    drawn = dealt.withColumn("drawn", F.row_number().over(order)).where(F.col("drawn") <= sample // groups)
    gathered = drawn.groupBy("corpus_id").agg(F.array_sort(F.collect_list("relative_path")).alias("paths"))
    return gathered.select("corpus_id", F.filter("paths", lambda _, i: (i > 0) & (i % per_range == 0)).alias("bounds"))


def part_cuts(rows: DataFrame, weight: int, sample: int = SAMPLE, per_range: int = SAMPLES_PER_RANGE) -> DataFrame:
    """``corpus_id, cuts``: the first path of each part, in order, for rows with a ``weight`` column.

    A row belongs to the part in which it begins, so a part weighs less than ``weight`` and
    its last row together.
    """
    ranged = join_by_corpus(rows.select("corpus_id", "relative_path", "weight"), range_bounds(rows, sample, per_range)).select(
        "corpus_id", "relative_path", "weight", places_up_to(F.col("bounds"), F.col("relative_path"), sample.bit_length()).alias("range")
    )
    # dealt once: sums and running sums read the same shuffle, so both take the same columns
    dealt = ranged.repartition("corpus_id", "range")
    above = Window.partitionBy("corpus_id").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("corpus_id", "range").agg(F.sum("weight").alias("sum"), F.min("relative_path").alias("first"))
    sums = sums.select("corpus_id", "range", F.coalesce(F.sum("sum").over(above), F.lit(0)).alias("above"))
    inside = Window.partitionBy("corpus_id", "range").orderBy("relative_path").rowsBetween(Window.unboundedPreceding, -1)
    begins = F.col("above") + F.col("inside")
    return (
        dealt.withColumn("inside", F.coalesce(F.sum("weight").over(inside), F.lit(0)))
        .join(sums, ["corpus_id", "range"])
        .groupBy("corpus_id", F.floor(begins / weight).alias("multiple")).agg(F.min("relative_path").alias("path"))
        .groupBy("corpus_id").agg(F.array_sort(F.collect_list("path")).alias("cuts"))
    )


def with_part(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Add ``part``, from 0, by the cuts of the row's corpus."""
    part = places_up_to(F.col("cuts"), F.col("relative_path"), 30) - 1
    return join_by_corpus(rows, cuts).withColumn("part", part).drop("cuts")
