"""A session with the settings the jobs assume."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "gistmill", master: str | None = None, **conf) -> SparkSession:
    """Session with adaptive execution and the UTC zone; cluster settings are kept."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def staging_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder that the cluster names for intermediate results.

    ``spark.checkpoint.dir`` is read from the session.  Only a local session without the
    setting gets a temporary folder of its own; a cluster must name a shared one, because
    a machine-local folder is lost with its executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gistmill-staging-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def staged(rows: DataFrame, label: str, group_bytes: int | None = None) -> DataFrame:
    """Write rows to the shared staging folder and read them back, evaluating them once.

    ``group_bytes`` bounds a row group, which readers of large binary values hold whole.
    """
    path = staging_path(rows.sparkSession, label)
    options = {"parquet.block.size": group_bytes} if group_bytes else {}
    rows.write.mode("errorifexists").options(**options).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


class Staging:
    """Staged tables of one run, removed when it is over."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, []

    def keep(self, rows: DataFrame, label: str) -> DataFrame:
        path = staging_path(self.spark, label)
        self.folders.append(path)
        rows.write.mode("errorifexists").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def close(self) -> None:
        for folder in self.folders:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.folders = []
