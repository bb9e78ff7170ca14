"""Mixing sources to target weights by sampling without replacement.

Every document draws an exponential key, ``-ln(u) / weight`` with ``u`` a hash of its id and
the seed, so heavier documents come earlier; this is sampling by weight without replacement,
and any rerun draws the same.  A source's target is met by whole epochs of all its documents
first and then by the documents with the smallest keys, as far as their running sum of
words goes; the document at the edge is taken if that brings the sum nearer.

Targets share the total of all sizes by source weight.  A source stops at ``most`` times its
own size and what it leaves is shared among the others by weight, again and again until none
is above: with sources ordered by size over weight, the first k stop where the level that
the rest can reach, (total - their caps) / (weight of the rest), is below every later cap.

One source may hold most rows: running sums are taken inside ranges of the sorted rows, and
only one row for each range and source is summed across ranges.

Defined results: null or empty text has size 0 and its ``taken`` is 0, and it is in the mix no
more than ``most`` times; a null source is a
source of its own, after all others; null, non-positive or absent document weights count as 1; rows
that repeat an id draw the same key and are taken one after the other; an empty table gives
no rows; other columns are kept by ``mixed_documents`` and ignored by ``mixture``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.llm.common import WORD, whole_row, with_running_total
from gistmill.session import staged

SOURCE_WEIGHTS, MOST, SEED = (5, 2, 1), 3, "mix"


def unit_draw(id_column: Column, seed: str = SEED) -> Column:
    """Even draw in (0, 1) from 52 bits of a hash of the id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(2**52))


def source_targets(sizes: DataFrame, source: str, weights: tuple = SOURCE_WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size, target``; one row a source, which is all that meets in one window."""
    alone = Window.partitionBy(F.lit(0))
    sources = sizes.groupBy(source).agg(F.sum("size").alias("source_size"))
    named = alone.orderBy(F.col(source).asc_nulls_last())
    place = (F.row_number().over(named) - 1) % len(weights) + 1
    sources = sources.select("*", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), place).alias("_w"))
    filled = alone.orderBy(F.col("source_size") / F.col("_w"), F.col(source).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(alone)
    rest = total - F.lit(most) * F.coalesce(F.sum("source_size").over(filled), F.lit(0))
    left = F.sum("_w").over(alone) - F.coalesce(F.sum("_w").over(filled), F.lit(0))
    sources = sources.select("*", (rest / left).alias("_level"), (F.lit(most) * F.col("source_size")).alias("_cap"))
    # the level with the first k stopped; it holds from the first source whose cap is not below it
    stops = F.col("_cap") < F.col("_level") * F.col("_w")
    level = F.min(F.when(~stops, F.struct((F.col("source_size") / F.col("_w")).alias("o"), F.col("_level").alias("v")))).over(alone)["v"]
    reach = F.coalesce(level * F.col("_w"), F.col("_cap").cast("double"))
    return sources.select(source, "source_size", F.least(reach, F.col("_cap").cast("double")).alias("target"))


def _mixed(documents: DataFrame, carried: dict[str, Column], options: dict) -> DataFrame:
    """Rows with ``carried`` columns, ``size, source_size, target`` and how many times each is taken."""
    rows = documents.select(
        F.col(options["id_column"]).alias("_id"), F.col(options["source_column"]).alias("_source"),
        F.coalesce(F.regexp_count(F.col(options["text_column"]), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        *[column.alias(name) for name, column in carried.items()],
    )
    weight = F.lit(1.0)
    if options["quality"] is not None:  # texts are behind these rows already
        given = options["quality"].select(F.col(options["id_column"]).alias("_named"), F.col("weight").cast("double").alias("_weight"))
        rows = rows.join(given, F.col("_id") == F.col("_named"), "left").drop("_named")
        weight = F.coalesce(F.when(F.col("_weight") > 0, F.col("_weight")), F.lit(1.0))
    rows = rows.withColumn("_key", -F.log(unit_draw(F.col("_id"), options["seed"])) / weight).drop("_weight")
    order = [F.col("_key"), F.col("_id"), F.col("size"), *[F.col(name) for name in carried]]
    files = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = staged(
        rows.repartitionByRange(files, F.col("_source"), *order).withColumn("_part", F.spark_partition_id()), "mix-ranges"
    )
    targets = source_targets(ranged, "_source", options["weights"], options["most"])
    summed = with_running_total(ranged, ["_source"], order, "size", "_before")
    joined = summed.join(targets.withColumnRenamed("_source", "_named"), F.col("_source").eqNullSafe(F.col("_named")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    budget = F.col("target") - F.col("_epochs") * F.col("source_size")
    # nothing is left of a target of whole epochs, also for what has no size
    more = ((budget > 0) & (F.col("_before") + F.col("size") / 2 <= budget)).cast("bigint")
    return joined.withColumn("_epochs", epochs).withColumn("_times", F.col("_epochs") + more)


def mixture(
    documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
    quality: DataFrame | None = None, weights: tuple = SOURCE_WEIGHTS, most: int = MOST, seed: str = SEED,
) -> DataFrame:
    """``id, size, source_size, target, taken`` of every row; ``quality`` has ids, each once, and a ``weight``."""
    options = dict(id_column=id_column, text_column=text_column, source_column=source_column, quality=quality, weights=weights, most=most, seed=seed)
    return _mixed(documents, {}, options).select(
        F.col("_id").alias(id_column), "size", "source_size", "target", (F.col("_times") * F.col("size")).alias("taken")
    )


def mixed_documents(
    documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
    quality: DataFrame | None = None, weights: tuple = SOURCE_WEIGHTS, most: int = MOST, seed: str = SEED,
) -> DataFrame:
    """The mix itself: every document, with all its columns, as many times as it is taken.

    Rows are told apart by a hash of their columns; rows that are equal in all of them share
    what is taken of them.  Texts cross one shuffle, whatever their number.
    """
    options = dict(id_column=id_column, text_column=text_column, source_column=source_column, quality=quality, weights=weights, most=most, seed=seed)
    row = F.xxhash64(whole_row(documents))
    times = staged(
        _mixed(documents, {"_row": row}, options).groupBy("_row").agg(F.sum("_times").alias("_times"), F.count(F.lit(1)).alias("_alike"))
        .where("_times > 0"), "mix-times"
    ).hint("merge")
    # a document travels as one column, so that no name of its own meets a helper's
    joined = documents.select(whole_row(documents).alias("_document"), row.alias("_row")).join(times, "_row")
    once = joined.where("_alike = 1").unionByName(joined.where("_alike > 1").dropDuplicates(["_row"]))
    return once.select("_document", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select("_document.*")


def mixture_sql(documents: str, weight: str, seed: str = SEED, most: int = MOST) -> str:
    """The same in one statement, for an engine that need not split its windows."""
    return f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
    -ln((('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5) / {float(2**52)}) / ({weight}) AS k
  FROM {documents}),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM sized GROUP BY source),
levels AS (
  SELECT *, (sum(source_size) OVER () - {most} * coalesce(sum(source_size) OVER b, 0))::DOUBLE
      / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS lvl
  FROM sources WINDOW b AS (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size,
    least(coalesce((SELECT arg_min(lvl, source_size::DOUBLE / w) FROM levels WHERE NOT {most} * source_size < lvl * w) * w,
      ({most} * source_size)::DOUBLE), ({most} * source_size)::DOUBLE) AS target
  FROM levels),
summed AS (
  SELECT s.*, t.source_size, t.target,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
counted AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM summed)
SELECT doc_id, size, source_size, target,
  ((epochs + (before + size / 2 <= target - epochs * source_size)::BIGINT) * size)::BIGINT AS taken
FROM counted"""
