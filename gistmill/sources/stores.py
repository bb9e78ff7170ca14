"""File trees in object stores and other file systems, with every name a store holds.

The tasks list directories through pyarrow's file systems, so empty files and names starting
with ``_`` or ``.`` are there, and roots are rows of a table: their number has no bound.  As on
a mount a task that has opened its share hands the rest of its directories back; each round is
a folder of one staged table.

Null or repeated rows among the roots count once or not at all; a table without rows has an
empty listing; columns beside ``corpus_id`` and ``root`` are left aside.  One directory is
listed at once, so the names of a single directory have to fit in a task's memory.  Links to
directories are not followed, and links that lead nowhere, on a local file system, are not seen.
"""

from __future__ import annotations

import datetime
import functools
import os
from collections import deque
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill import fixed_values as fv
from gistmill.functions.globs import RuleRegex, compile_rules
from gistmill.schemas import KEY
from gistmill.session import staging_path
from gistmill.sources import tree

#: Gives the file system of a root and the root's path in it.
Connect = Callable[[str], tuple[fs.FileSystem, str]]

_FILE, _DIRECTORY, _ABSENT, _NO_DIRECTORY = "file", "directory", "absent", "no directory"
_FOUND = "corpus_id string, root string, relative_path string, size bigint, modified_time timestamp_ntz, kind string"
_FOUND_ARROW = pa.schema([
    ("corpus_id", pa.string()), ("root", pa.string()), ("relative_path", pa.string()),
    ("size", pa.int64()), ("modified_time", pa.timestamp("us")), ("kind", pa.string()),
])


def connect(root: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI such as ``s3://bucket/prefix``, or of a local path."""
    if "://" in root or root.startswith("file:/"):
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), os.path.abspath(root or "/")


def _below(base: str, relative_path: str) -> str:
    return f"{base.rstrip('/')}/{relative_path}" if relative_path else base


def _links(store: fs.FileSystem) -> Callable[[str], bool]:
    """Whether a path is a link; object stores have none."""
    return os.path.islink if isinstance(store, fs.LocalFileSystem) else lambda path: False


def _modified(found: fs.FileInfo) -> datetime.datetime | None:
    if found.mtime_ns is None:
        return None
    # seconds as stat() gives them; found.mtime divides once and may round to the next microsecond
    seconds, rest = divmod(found.mtime_ns, 10**9)
    return datetime.datetime.fromtimestamp(seconds + 1e-9 * rest, datetime.timezone.utc).replace(tzinfo=None)


def _walk(
    given: Iterator[tuple[str, str, str]], limit: int, ignore_file: str, output_file: str, connect: Connect
) -> Iterator[tuple]:
    """Open up to ``limit`` directories, nearest first; hand back those left over."""

    opened_store = functools.lru_cache(64)(connect)

    @functools.lru_cache(64)
    def rules(root: str) -> RuleRegex:
        store, base = opened_store(root)
        own = tree.usable_lines(lambda: store.open_input_stream(_below(base, ignore_file)))
        return compile_rules(fv.DEFAULT_IGNORE_RULES + tuple(own), output_file)

    waiting, opened = deque(), 0
    for corpus, root, directory in given:
        if not directory:
            store, base = opened_store(root)
            kind = store.get_file_info(base).type
            if kind != fs.FileType.Directory:
                yield corpus, root, "", None, None, _ABSENT if kind == fs.FileType.NotFound else _NO_DIRECTORY
                continue
        waiting.append((corpus, root, directory))
        while waiting and opened < limit:
            corpus, root, directory = waiting.popleft()
            opened += 1
            store, base = opened_store(root)
            is_link = _links(store)
            try:
                entries = store.get_file_info(fs.FileSelector(_below(base, directory), allow_not_found=True))
            except OSError:  # as on a mount, what cannot be opened has no files
                continue
            for found in entries:
                path = f"{directory}/{found.base_name}" if directory else found.base_name
                if found.type != fs.FileType.Directory:
                    there = found.type != fs.FileType.NotFound
                    yield corpus, root, path, found.size if there else None, _modified(found) if there else None, _FILE
                elif not is_link(found.path) and not rules(root).hits(path):
                    waiting.append((corpus, root, path))
        while waiting:
            yield *waiting.popleft(), None, None, _DIRECTORY


def list_stores(
    roots: DataFrame,
    ignore_file: str = fv.IGNORE_FILE,
    directories_per_task: int = tree.DIRECTORIES_PER_TASK,
    output_file: str = fv.DIGEST_FILE,
    connect: Connect = connect,
) -> DataFrame:
    """List the files below roots given as ``corpus_id, root``, where a root is a URI or a local path.

    Directories the rules exclude, or that have the digest's own name, are not entered.  A file
    without ``size`` could not be examined; it counts as ignored.  The listing is written to the
    staging folder.  ``connect`` may give file systems that need more than a URI; it runs in tasks.
    """
    spark = roots.sparkSession
    base = staging_path(spark, "stores")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = (tuple(row.values()) for batch in batches for row in batch.to_pylist())
        rows = []
        for row in _walk(given, directories_per_task, ignore_file, output_file, connect):
            rows.append(dict(zip(_FOUND_ARROW.names, row)))
            if len(rows) == tree.BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(rows, schema=_FOUND_ARROW)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, schema=_FOUND_ARROW)

    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    frontier = roots.select("corpus_id", F.rtrim("root", F.lit("/")).alias("root"), F.lit("").alias("relative_path"))
    frontier = frontier.dropna().distinct()
    turn = 0
    while True:
        # a fixed number: by their few bytes the directories would be merged into one task
        frontier.repartition(tasks, *KEY, "root").mapInArrow(walk, _FOUND).write.parquet(f"{base}/round={turn}")
        found = spark.read.schema(_FOUND).parquet(f"{base}/round={turn}")
        if turn == 0:
            _check(found)
        frontier = found.where(F.col("kind") == _DIRECTORY).select("corpus_id", "root", "relative_path")
        if frontier.isEmpty():
            break
        turn += 1
    files = spark.read.schema(_FOUND).parquet(base).where(F.col("kind") == _FILE)
    return files.select(
        "corpus_id", F.concat("root", F.lit("/"), "relative_path").alias("path"), "relative_path", "size", "modified_time"
    )


def _check(found: DataFrame) -> None:
    """Raise for a root that is no directory."""
    if row := found.where(F.col("kind").isin(_ABSENT, _NO_DIRECTORY)).orderBy("kind", "root").first():
        problem = "Directory does not exist" if row.kind == _ABSENT else "Path is not a directory"
        raise ValueError(f"{problem}: {row.root}")


def read_stores(
    listing: DataFrame, tasks: int | None = None, row_bytes: int = tree.ROW_BYTES, connect: Connect = connect
) -> DataFrame:
    """Add ``content`` and ``checksum`` to what ``list_stores`` lists, as ``tree.read_contents`` does on a mount."""
    return tree.read_contents(listing, tasks, row_bytes, _StoreFiles(connect))


class _StoreFiles:
    """Opens listed files of stores; connections are made once a task."""

    def __init__(self, connect: Connect):
        self.connect, self.connected = connect, {}

    def __call__(self, path: str, relative_path: str) -> BinaryIO:
        root = path[: -len(relative_path) - 1]
        if root not in self.connected:
            if len(self.connected) == 64:
                self.connected.clear()
            self.connected[root] = self.connect(root)
        store, base = self.connected[root]
        return store.open_input_stream(_below(base, relative_path))


def rule_lines(roots: DataFrame, ignore_file: str = fv.IGNORE_FILE, connect: Connect = connect) -> DataFrame:
    """``corpus_id, line`` of the rule files at the roots; missing files give no rows."""
    opened = _StoreFiles(connect)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [
                {"corpus_id": row["corpus_id"], "line": line}
                for row in batch.to_pylist()
                for line in tree.usable_lines(lambda: opened(f"{row['root']}/{ignore_file}", ignore_file))
            ]
            yield pa.RecordBatch.from_pylist(lines, schema=pa.schema([("corpus_id", pa.string()), ("line", pa.string())]))

    given = roots.select("corpus_id", F.rtrim("root", F.lit("/")).alias("root")).dropna().distinct()
    return given.mapInArrow(read, "corpus_id string, line string")
