"""One digest file per corpus, written by many tasks at once.

Every piece of a digest text has a place in its file, the sum of the bytes in front of it.
Tasks write their pieces at these places, so a file of any length is put together without a
task, or a row, that holds it.  It grows under another name and gets its own when all of it
is there; a task that is run again writes the same bytes to the same places.
"""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gistmill.operators.digest import PART_BYTES
from gistmill.operators.skew import join_by_corpus
from gistmill.schemas import KEY
from gistmill.session import Staging

_PART = ["corpus_id", "part"]

#: Rows of a range, as a power of two.
RANGE_BITS = 12


def _sum_before(value: str, window: WindowSpec) -> Column:
    return F.coalesce(F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def ranged(weighed: DataFrame) -> DataFrame:
    """Rows with the number of their ``range``: up to ``2 ** RANGE_BITS`` rows that follow each other by corpus and path.

    Another evaluation may cut elsewhere, so the result has to be staged.
    """
    in_order = weighed.repartitionByRange(*KEY).sortWithinPartitions(*KEY)
    return in_order.withColumn("range", F.shiftright(F.monotonically_increasing_id(), RANGE_BITS))


def placed_keys(ranges: DataFrame, part_bytes: int) -> DataFrame:
    """``corpus_id, relative_path, at, weight, part``: where the pieces of each key begin, their bytes, and their part.

    One row a key.  Only short rows are moved, and none holds more than its own key: a list of cuts
    beside every row would grow with the corpus, as the rows do.  Only one row for each range of a
    corpus meets in a window.
    """
    sums = ranges.groupBy("corpus_id", "range").agg(F.sum("weight").alias("sum"))
    above = sums.select("corpus_id", "range", _sum_before("sum", Window.partitionBy("corpus_id").orderBy("range")).alias("above"))
    inside = _sum_before("weight", Window.partitionBy("corpus_id", "range").orderBy("relative_path"))
    begun = ranges.withColumn("inside", inside).join(above, ["corpus_id", "range"]).withColumn("at", F.col("above") + F.col("inside"))
    keys = begun.groupBy(*KEY).agg(F.min("at").alias("at"), F.sum("weight").alias("weight"))
    return keys.withColumn("part", F.floor(F.col("at") / part_bytes))


def manifest(keys: DataFrame) -> DataFrame:
    """``corpus_id, part, start, length`` of the parts of each text, in bytes."""
    return keys.groupBy(*_PART).agg(F.min("at").alias("start"), F.sum("weight").alias("length"))


def placed(lines: DataFrame, keys: DataFrame, parts: DataFrame) -> DataFrame:
    """``path, at, value``: pieces as bytes with their places, in order inside a task.

    ``parts`` is the manifest with the ``path`` of each file.  Contents meet their part by key, are
    shuffled by part, and the window that adds up their lengths uses the same shuffle.
    """
    of = keys.select(F.col("corpus_id").alias("_corpus"), F.col("relative_path").alias("_key"), "part")
    same = (F.col("corpus_id") == F.col("_corpus")) & F.col("relative_path").eqNullSafe(F.col("_key"))
    found = lines.select(*KEY, F.encode("value", "UTF-8").alias("value")).join(of, same).drop("_corpus", "_key")
    weighed = found.join(parts.select(*_PART, "start", "path"), _PART).withColumn("weight", F.octet_length("value").cast("long"))
    inside = _sum_before("weight", Window.partitionBy(*_PART).orderBy("relative_path"))
    return weighed.select("path", (F.col("start") + inside).alias("at"), "value")


def _writer(label: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes pieces at their places in the growing files and tells how many bytes of which."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written: dict[str, int] = {}
        for batch in batches:
            opened, file = None, -1
            try:
                for path, at, value in zip(*batch.columns):
                    path, rest, place = path.as_py(), value.as_buffer(), at.as_py()
                    if path != opened:
                        if file >= 0:
                            os.close(file)
                        # not created here: a task left over from a lost executor must not bring the name back
                        opened, file = path, os.open(path + label, os.O_WRONLY)
                    written[path] = written.get(path, 0) + rest.size
                    while rest.size:
                        done = os.pwrite(file, rest, place)
                        rest, place = rest.slice(done), place + done
            finally:
                if file >= 0:
                    os.fsync(file)
                    os.close(file)
        yield pa.RecordBatch.from_pydict(
            {"path": list(written), "written": list(written.values())}, schema=pa.schema([("path", pa.string()), ("written", pa.int64())])
        )

    return write


def _begin(path: str, length: int) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    file = os.open(path, os.O_WRONLY | os.O_CREAT, 0o666)
    os.ftruncate(file, length)
    os.close(file)


def _finish(path: str, label: str, length: int, written: int) -> None:
    if written != length:
        raise ValueError(f"{path}: {written} of {length} bytes were written")
    try:
        os.replace(path + label, path)
    except FileNotFoundError:  # an earlier try of this task has done it
        if os.path.getsize(path) != length:
            raise


def _remove(path: str) -> None:
    with contextlib.suppress(FileNotFoundError):
        os.unlink(path)


def _for_each(files: DataFrame, step: Callable[[dict], None]) -> None:
    """One call for each row, in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                step(row)
            yield batch.select(["path"])

    spread = files.repartition(files.sparkSession.sparkContext.defaultParallelism, "path")
    spread.mapInArrow(run, "path string").write.format("noop").mode("overwrite").save()


def write_digest_files(lines: DataFrame, paths: DataFrame, part_bytes: int = PART_BYTES) -> None:
    """Write the text of each corpus to its file, the joined parts of ``digest_documents``.

    ``lines`` are those of ``digest_lines``; ``paths`` has ``corpus_id, path``, one row a corpus, on
    a mount that all tasks share.  A file that is there is replaced when the new one is complete,
    and folders are made.  Corpora without a path are not written, paths of corpora without lines
    stay as they are, pieces without text are empty, and other columns are left aside.  Texts are
    evaluated twice, for their lengths and for themselves.
    """
    label = f".{uuid.uuid4().hex}.part"
    with contextlib.closing(Staging(lines.sparkSession)) as staging:
        to = staging.keep(paths.select("corpus_id", "path").dropna(), "paths")
        wanted = join_by_corpus(lines.select(*KEY, "value").where("value IS NOT NULL"), to.select("corpus_id"), "left_semi")
        weighed = staging.keep(wanted.select(*KEY, F.octet_length("value").cast("long").alias("weight")), "weights")
        ranges = staging.keep(ranged(weighed), "ranges")
        keys = staging.keep(placed_keys(ranges, part_bytes), "keys")
        parts = staging.keep(manifest(keys).join(to, "corpus_id"), "manifest")
        files = staging.keep(parts.groupBy("path").agg(F.sum("length").alias("length")), "files")
        try:
            _for_each(files, lambda row: _begin(row["path"] + label, row["length"]))
            written = placed(wanted, keys, parts).mapInArrow(_writer(label), "path string, written bigint")
            sums = staging.keep(written.groupBy("path").agg(F.sum("written").alias("written")), "written")
            _for_each(files.join(sums, "path"), lambda row: _finish(row["path"], label, row["length"], row["written"]))
        except BaseException:
            _for_each(files, lambda row: _remove(row["path"] + label))
            raise
