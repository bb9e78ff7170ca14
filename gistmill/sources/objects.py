"""File trees in an object store, through Spark's ``binaryFile`` source.

Scales with the store and prunes unused contents, but leaves out empty files and names
starting with ``_`` or ``.``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmill.functions.text import checksum
from gistmill.schemas import FILES


def plain_path(path: Column) -> Column:
    """File URI of a metadata column without its percent escapes; a plus sign stays one."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def relative_path(path: Column, root: Column) -> Column:
    """Part of a plain path below the corpus root."""
    return F.substring(path, F.length(root) + 2, F.length(path))


def qualified_path(spark: SparkSession, path: str) -> str:
    """Path with the scheme and authority of its file system."""
    given = spark._jvm.org.apache.hadoop.fs.Path(path)
    return given.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(given).toString()


def path_exists(spark: SparkSession, path: str) -> bool:
    given = spark._jvm.org.apache.hadoop.fs.Path(path)
    return given.getFileSystem(spark._jsc.hadoopConfiguration()).exists(given)


def read_objects(spark: SparkSession, root: str, corpus_id: str | None = None) -> DataFrame:
    """Files below ``root`` as one corpus, or, without ``corpus_id``, one corpus per child directory."""
    source = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = relative_path(F.col("path"), F.lit(qualified_path(spark, root)))
    if corpus_id is None:
        corpus = F.substring_index(below, "/", 1)
        inside, wanted = relative_path(below, corpus), F.contains(below, F.lit("/"))
    else:
        corpus, inside, wanted = F.lit(corpus_id), below, F.lit(True)
    return source.where(wanted).select(
        corpus.alias("corpus_id"),
        "path",
        inside.alias("relative_path"),
        F.col("length").alias("size"),
        F.col("modificationTime").cast("timestamp_ntz").alias("modified_time"),
        checksum(F.col("content")).alias("checksum"),
        "content",
    ).select(*FILES.fieldNames())
