"""File trees on a shared mount, with every file a directory walk sees.

Spark's own ``binaryFile`` source leaves out empty files and names starting with ``_`` or
``.``; see :mod:`gistmill.sources.stores` for the same walk over object stores.  Here the
tasks walk the directories, in rounds: a task that has opened its share hands the rest of
its directories back, and the next round deals them out over all tasks.  A corpus that
holds most of the files is thus spread like any other.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import io
import math
import os
from collections import deque
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmill import fixed_values as fv
from gistmill.functions.globs import RuleRegex, compile_rules
from gistmill.functions.text import checksum
from gistmill.options import LARGEST_ROW
from gistmill.schemas import FILES, KEY, LISTING
from gistmill.session import staged

# A task opens this many directories in a round, and hands over rows in batches.
DIRECTORIES_PER_TASK = 2000
BATCH_ROWS = 10_000
# A task reads about this many bytes of files, and hands contents over in smaller batches.
BYTES_PER_TASK = 256 * 1024 * 1024
BATCH_BYTES = 64 * 1024 * 1024
# Larger files are streamed: they have an entry that names their size, never their text.
ROW_BYTES = LARGEST_ROW


def rule_file_lines(root: str, ignore_file: str = fv.IGNORE_FILE) -> list[str]:
    """Usable rules in the rule file at a corpus root; none if it cannot be read or is not UTF-8."""
    return usable_lines(lambda: open(os.path.join(root, ignore_file), "rb"))


def usable_lines(open_rules: Callable[[], BinaryIO]) -> list[str]:
    """Rules of a file, comments left out; none if it cannot be read or is not UTF-8."""
    try:
        with io.TextIOWrapper(open_rules(), encoding="utf-8") as lines:
            stripped = [line.strip() for line in lines]
    except (OSError, UnicodeDecodeError):  # concerns this corpus only
        return []
    return [line for line in stripped if line and not line.startswith("#")]


# What a walk finds: files with their listing columns, and directories still to be opened.
_FOUND = "corpus_id string, root string, relative_path string, size bigint, modified_time timestamp_ntz, is_directory boolean"
_FOUND_ARROW = pa.schema([
    ("corpus_id", pa.string()), ("root", pa.string()), ("relative_path", pa.string()),
    ("size", pa.int64()), ("modified_time", pa.timestamp("us")), ("is_directory", pa.bool_()),
])


def _entries(root: str, directory: str, rules: RuleRegex) -> Iterator[tuple[str, os.DirEntry | None]]:
    """Files with their entry; directories to go into, which are not links, without one."""
    try:
        found = os.scandir(os.path.join(root, directory) if directory else root)
    except OSError:
        return
    with found:
        for entry in found:
            path = f"{directory}/{entry.name}" if directory else entry.name
            try:
                is_directory = entry.is_dir()
            except OSError:
                is_directory = False
            if not is_directory:
                yield path, entry
            elif not entry.is_symlink() and not rules.hits(path):
                yield path, None


def _file_row(corpus: str, root: str, path: str, entry: os.DirEntry) -> tuple:
    try:
        found = entry.stat()
        size, modified = found.st_size, datetime.datetime.fromtimestamp(found.st_mtime)
    except OSError:
        size = modified = None
    return corpus, root, path, size, modified, False


def _walk(directories: Iterator[tuple[str, str, str]], limit: int, ignore_file: str, output_file: str) -> Iterator[tuple]:
    """Open up to ``limit`` directories, nearest first; hand back those left over."""

    @functools.cache
    def rules(root: str) -> RuleRegex:
        own = rule_file_lines(root, ignore_file)
        return compile_rules(fv.DEFAULT_IGNORE_RULES + tuple(own), output_file)

    waiting, opened = deque(), 0
    for given in directories:
        waiting.append(given)
        while waiting and opened < limit:
            corpus, root, directory = waiting.popleft()
            opened += 1
            for path, entry in _entries(root, directory, rules(root)):
                if entry is None:
                    waiting.append((corpus, root, path))
                else:
                    yield _file_row(corpus, root, path, entry)
        while waiting:
            yield *waiting.popleft(), None, None, True


def list_corpora(
    spark: SparkSession,
    roots: dict[str, str],
    ignore_file: str = fv.IGNORE_FILE,
    directories_per_task: int = DIRECTORIES_PER_TASK,
    output_file: str = fv.DIGEST_FILE,
) -> DataFrame:
    """List the files of corpora given as ``{corpus_id: directory}``.

    Directories the rules exclude, or that have the digest's own name, are not entered.  A file without ``size`` could not be
    examined; it counts as ignored.  The listing is written to the staging folder, so using
    it again does not walk again.
    """
    absolute = {corpus: os.path.abspath(root) for corpus, root in roots.items()}
    for root in absolute.values():
        if not os.path.exists(root):
            raise ValueError(f"Directory does not exist: {root}")
        if not os.path.isdir(root):
            raise ValueError(f"Path is not a directory: {root}")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = (
            (row["corpus_id"], row["root"], row["relative_path"]) for batch in batches for row in batch.to_pylist()
        )
        rows = []
        for row in _walk(given, directories_per_task, ignore_file, output_file):
            rows.append(dict(zip(_FOUND_ARROW.names, row)))
            if len(rows) == BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(rows, schema=_FOUND_ARROW)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, schema=_FOUND_ARROW)

    frontier = spark.createDataFrame(
        [(corpus, root, "") for corpus, root in absolute.items()], "corpus_id string, root string, relative_path string"
    )
    tasks = max(
        spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    )
    listing = None
    while True:
        # a fixed number: by their few bytes the directories would be merged into one task
        found = staged(frontier.repartition(tasks, *KEY).mapInArrow(walk, _FOUND), "listing")
        files = found.where(~F.col("is_directory"))
        listing = files if listing is None else listing.unionByName(files)
        frontier = found.where("is_directory").select("corpus_id", "root", "relative_path")
        if frontier.isEmpty():
            break
    return listing.select(
        "corpus_id", F.concat("root", F.lit("/"), "relative_path").alias("path"), "relative_path", "size", "modified_time"
    )


def _is_text(opened: BinaryIO, encoding: str) -> bool:
    """Whether a file read as text has no NUL and at most a tenth of control characters; in pieces."""
    characters = controls = 0
    with io.TextIOWrapper(opened, encoding=encoding) as file:
        while piece := file.read(1 << 20):
            if "\0" in piece:
                return False
            characters += len(piece)
            controls += len(piece) - len(piece.translate(_NO_CONTROLS))
    return controls * 10 <= characters


_NO_CONTROLS = dict.fromkeys(map(ord, fv.CONTROL_CHARACTERS))


#: Opens a file, given by its path and its path below the root, for reading bytes.
Opener = Callable[[str, str], BinaryIO]


def open_mounted(path: str, relative_path: str) -> BinaryIO:
    return open(path, "rb")


def _read_file(open_again: Callable[[], BinaryIO], size: int | None, row_bytes: int) -> tuple[bytes | None, str | None]:
    """Content; beyond ``row_bytes`` the checksum, and empty content if it is text, else none."""
    try:
        with open_again() as file:
            if (size or 0) <= row_bytes:
                return file.read(), None
            digest = hashlib.file_digest(file, "sha256").hexdigest()
        try:
            return (b"" if _is_text(open_again(), "utf-8") else None), digest
        except UnicodeDecodeError:
            return (b"" if _is_text(open_again(), "latin-1") else None), digest
    except OSError:
        return None, None


def _read_batches(batches: Iterator[pa.RecordBatch], row_bytes: int, open_file: Opener) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        start, held, read = 0, 0, []
        for path, below, size in zip(*[batch.column(name).to_pylist() for name in ("path", "relative_path", "size")]):
            read.append(_read_file(functools.partial(open_file, path, below), size, row_bytes))
            held += len(read[-1][0] or b"")
            if held >= BATCH_BYTES:
                yield _with_contents(batch.slice(start, len(read)), read)
                start, held, read = start + len(read), 0, []
        if read:
            yield _with_contents(batch.slice(start, len(read)), read)


def _with_contents(batch: pa.RecordBatch, read: list[tuple]) -> pa.RecordBatch:
    contents, checksums = zip(*read)
    return batch.append_column("content", pa.array(contents, pa.binary())).append_column(
        "large_checksum", pa.array(checksums, pa.string())
    )


def read_contents(
    listing: DataFrame, tasks: int | None = None, row_bytes: int = ROW_BYTES, open_file: Opener = open_mounted
) -> DataFrame:
    """Add ``content`` and ``checksum``; content is NULL where a file cannot be read.

    Files above ``row_bytes``, which no row could hold, are streamed.  They have their
    checksum, and instead of their content an empty one if they are text and NULL if they
    are binary: with their size that leads to the same entry, because the options allow no
    size limit above it.

    Files are dealt out by the hash of their path first, so the files of one big directory
    are read by all tasks.  There are as many tasks as the listed sizes call for, unless
    ``tasks`` says otherwise.
    """
    if tasks is None:
        total = listing.agg(F.sum("size")).first()[0] or 0
        tasks = max(
            listing.sparkSession.sparkContext.defaultParallelism, math.ceil(total / BYTES_PER_TASK)
        )
    spread = listing.repartition(tasks, *KEY)
    columns = LISTING.fieldNames()
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in LISTING) + ", content binary, large_checksum string"
    read = spread.select(*columns).mapInArrow(lambda batches: _read_batches(batches, row_bytes, open_file), schema)
    return read.withColumn(
        "checksum", F.coalesce("large_checksum", checksum(F.col("content")))
    ).select(*FILES.fieldNames())


def rule_lines(
    spark: SparkSession, roots: dict[str, str], ignore_file: str = fv.IGNORE_FILE
) -> DataFrame:
    """``corpus_id, line`` of the rule files at the corpus roots; missing files give no rows.

    Tasks read the files: Spark's text source passes over names that start with a dot.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [
                (corpus, line)
                for corpus, root in zip(batch["corpus_id"], batch["root"])
                for line in rule_file_lines(root, ignore_file)
            ]
            yield pd.DataFrame(found, columns=["corpus_id", "line"], dtype="object")

    corpora = spark.createDataFrame(
        [(corpus, os.path.abspath(root)) for corpus, root in roots.items()], "corpus_id string, root string"
    )
    return corpora.mapInPandas(read, "corpus_id string, line string")
