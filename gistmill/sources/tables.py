"""Tables of files, and the stored digest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmill.functions.text import checksum
from gistmill.operators.status import UP_TO_DATE
from gistmill.schemas import CORPORA, DROPPED, FILES, KEY, LOG, STATE


def files_from_table(table: DataFrame) -> DataFrame:
    """Any table with the file columns; the checksum is computed if it has none."""
    if "checksum" not in table.columns:
        table = table.withColumn("checksum", checksum(F.col("content")))
    return table.select(*FILES.fieldNames())


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE)


class StateStore:
    """The stored digest as versions below one folder: a base and what later runs changed.

    A version has three Parquet tables, each a partition ``version=N`` of its kind:

    * ``rows``: the files that the run worked on, with status, route, outcome and, if there is
      one, their entry; a base has every entry;
    * ``dropped``: keys of entries that no longer hold, and the version that has each;
    * ``corpora``: the corpora that had files.

    The manifest, written last, names the versions that make up the digest, so a run lost
    halfway leaves the old one in place, and what a plan reads is never overwritten.  An entry
    holds unless a later version drops it: reading is one scan of the rows and an anti join
    with the dropped keys, and needs no contents where none are asked for.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self, kind: str, prefix: str, suffix: str = "") -> list[int]:
        folder = self._path(f"{self.root}/{kind}")
        if not self._fs.exists(folder):
            return []
        names = [status.getPath().getName() for status in self._fs.listStatus(folder)]
        return sorted(int(n.removeprefix(prefix).removesuffix(suffix)) for n in names if n.startswith(prefix) and n.endswith(suffix))

    def versions(self) -> list[int]:
        """Complete versions, oldest first."""
        return self._numbers("manifests", "version-", ".json")

    def parts(self, version: int) -> list[int]:
        """The versions that make up a version's digest, its base first."""
        lines = self.spark.read.text(f"{self.root}/manifests/version-{version}.json", wholetext=True).first()
        return json.loads(lines.value)["parts"]

    def _table(self, kind: str, schema: T.StructType, parts: list[int]) -> DataFrame:
        paths = [f"{self.root}/{kind}/version={part}" for part in parts]
        full = T.StructType([*schema.fields, T.StructField("version", T.LongType())])
        return self.spark.read.schema(full).option("basePath", f"{self.root}/{kind}").parquet(*paths)

    def read(self, version: int | None = None, origin: bool = False) -> DataFrame:
        """Stored digest; empty before the first run.  With ``origin``, and the version that has each entry."""
        complete = self.versions()
        if not complete:
            found = empty_state(self.spark).withColumn("version", F.lit(None).cast("long"))
        else:
            parts = self.parts(complete[-1] if version is None else version)
            found = self._table("rows", LOG, parts).where(F.col("summary_date").isNotNull())
            if len(parts) > 1:
                dropped = self._table("dropped", DROPPED, parts[1:]).select(*KEY, F.col("origin").alias("version"))
                found = found.join(dropped, [*KEY, "version"], "left_anti")
        return found.select(*STATE.fieldNames(), *[F.col("version").alias("origin")] * origin)

    def run_log(self, version: int | None = None) -> DataFrame | None:
        """Status, route and outcome of every current file of a run, beside the entry it has now.

        Files that were not due are those with an entry in a corpus that had files; entries of
        other corpora have no status.
        """
        complete = self.versions()
        if not complete:
            return None
        version = complete[-1] if version is None else version
        worked = self._table("rows", LOG, [version]).where(F.col("status").isNotNull()).drop("version")
        entries = self.read(version)
        done, failed = worked.where(F.col("summary_date").isNotNull()), worked.where(F.col("summary_date").isNull())
        kept = failed.select(*KEY, "status", "route", "outcome").join(entries, KEY, "left")
        others = entries.join(worked.select(*KEY), KEY, "left_anti").join(
            self._table("corpora", CORPORA, [version]).select("corpus_id", F.lit(UP_TO_DATE).alias("status")), "corpus_id", "left"
        )
        columns = LOG.fieldNames()
        return done.select(*columns).unionByName(kept.select(*columns)).unionByName(others, allowMissingColumns=True).select(*columns)

    def answers(self) -> str:
        """Where the answers of runs are logged that follow the latest version; removed with the next."""
        return f"{self.root}/answers/after-{max(self.versions(), default=0)}"

    def begin(self) -> int:
        """Number of a new version, above those of runs that were lost."""
        return max(self.versions() + self._numbers("rows", "version="), default=0) + 1

    def put(self, version: int, kind: str, table: DataFrame) -> DataFrame:
        """Write one table of a version that has begun, and read it back."""
        schema = {"rows": LOG, "dropped": DROPPED, "corpora": CORPORA}[kind]
        there = set(table.columns)
        columns = [(F.col(f.name) if f.name in there else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
        table.select(*columns).write.mode("errorifexists").parquet(f"{self.root}/{kind}/version={version}")
        return self._table(kind, schema, [version])

    def finish(self, version: int, parts: list[int]) -> int:
        """Make a version visible, its tables being complete."""
        lines = self.spark.createDataFrame([(json.dumps({"parts": parts}),)], "value string").coalesce(1)
        beside, there = f"{self.root}/writing/version-{version}", self._path(f"{self.root}/manifests/version-{version}.json")
        lines.write.mode("overwrite").text(beside)
        (part,) = [s.getPath() for s in self._fs.listStatus(self._path(beside)) if s.getPath().getName().startswith("part-")]
        self._fs.mkdirs(there.getParent())
        if not self._fs.rename(part, there):
            raise OSError(f"version {version} could not be made visible")
        self._fs.delete(self._path(beside), True)
        self._fs.delete(self._path(f"{self.root}/answers"), True)
        return version

    def write(self, digest: DataFrame) -> int:
        """Write a digest, or a run log, as a new base and return its number."""
        version = self.begin()
        rows = self.put(version, "rows", digest)
        self.put(version, "corpora", rows.select("corpus_id").distinct())
        return self.finish(version, [version])

    def compact(self) -> int | None:
        """Write what the latest version amounts to as a base of its own."""
        complete = self.versions()
        if not complete or len(self.parts(complete[-1])) == 1:
            return complete[-1] if complete else None
        version = self.begin()
        self.put(version, "rows", self.run_log())
        self.put(version, "corpora", self._table("corpora", CORPORA, complete[-1:]))
        return self.finish(version, [version])
