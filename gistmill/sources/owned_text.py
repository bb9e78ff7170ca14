"""Text files that belong to known corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmill.sources.objects import plain_path, qualified_path


def read_owned_texts(spark: SparkSession, paths: dict[str, str], separator: str) -> DataFrame:
    """Files ``{corpus_id: path}`` as ``corpus_id, start, at, value``: pieces between separators, in one scan.

    Spark splits files at byte ranges and finds the next separator by itself, so no row holds
    more than a piece.  ``start`` is where a range begins in its file, ``at`` grows inside it.
    """
    if not paths:
        return spark.createDataFrame([], "corpus_id string, start bigint, at bigint, value string")
    owners = spark.createDataFrame(
        [(corpus, qualified_path(spark, path)) for corpus, path in paths.items()],
        "corpus_id string, file string",
    )
    file = F.regexp_replace(plain_path(F.col("_metadata.file_path")), "^file:/+", "file:/")
    texts = spark.read.option("lineSep", separator).text(list(paths.values())).select(
        "value", file.alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at")
    )
    return texts.join(owners, "file").select("corpus_id", "start", "at", "value")
