"""Token ids in binary files of byte or bit planes.

A file holds the ids of a run of documents.  Ids are cut into blocks of a fixed number;
each block is transposed into planes (the lowest bytes or bits of all its ids together,
then the next, ...), every plane that is not all zero is one zstandard frame, and an index
behind the blocks says where each plane is and which documents the file holds::

    magic | plane frames ... | index (one zstandard frame) | index offset, 8 bytes | magic

Planes of ids compress far better than ids: upper bytes hardly change.

Documents are dealt by range of id, so the files in order are the corpus in order.  A task
writes under a name of its own and then renames, so a repeated or speculative attempt leaves
the same complete file.  Files go below the shared folder of the cluster through pyarrow's
file systems.

Defined results: null text is an empty document (its end id alone); rows that repeat an id
follow each other by hash of their text; null ids come first; an empty table gives no files
and no rows; other columns are not looked at.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gistmill.llm.common import chunked, small_batches
from gistmill.llm.encoding import encoder
from gistmill.session import staged, staging_path

MAGIC = b"IDPLANE1"
BLOCK = 65_536
LEVEL = 1


# ---- the format -------------------------------------------------------------------------

def to_planes(ids: np.ndarray, bits: bool) -> np.ndarray:
    """Planes, lowest first, one a row: 4 of bytes or 32 of packed bits."""
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return np.ascontiguousarray(octets.T)
    single = np.unpackbits(octets, axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(single.T), axis=1, bitorder="little")


def from_planes(planes: np.ndarray, n: int, bits: bool) -> np.ndarray:
    if bits:
        single = np.unpackbits(planes, axis=1, bitorder="little")[:, :n]
        planes = np.packbits(np.ascontiguousarray(single.T), axis=1, bitorder="little").T
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4")


class PlaneWriter:
    """Writes one file; holds one block of ids at most, and a few numbers a document."""

    def __init__(self, out, block: int = BLOCK, bits: bool = False):
        self.out, self.block, self.bits = out, block, bits
        self.held, self.n_held, self.at = [], 0, len(MAGIC)
        self.blocks, self.documents, self.n_ids = [], [], 0
        self.press = zstandard.ZstdCompressor(level=LEVEL)
        out.write(MAGIC)

    def add(self, document, ids: np.ndarray) -> None:
        self.documents.append((document, len(ids)))
        self.n_ids += len(ids)
        while len(ids):
            part, ids = ids[: self.block - self.n_held], ids[self.block - self.n_held:]
            self.held.append(part)
            self.n_held += len(part)
            if self.n_held == self.block:
                self._flush()

    def _flush(self) -> None:
        if not self.n_held:
            return
        planes = to_planes(np.concatenate(self.held), self.bits)
        sizes = []
        for plane in planes:
            frame = self.press.compress(plane.tobytes()) if plane.any() else b""
            sizes.append(len(frame))
            self.out.write(frame)
        self.blocks.append((self.at, self.n_held, sizes))
        self.at += sum(sizes)
        self.held, self.n_held = [], 0

    def close(self) -> None:
        self._flush()
        index = {"bits": self.bits, "block": self.block, "blocks": self.blocks, "documents": self.documents}
        self.out.write(self.press.compress(json.dumps(index).encode()))
        self.out.write(struct.pack("<Q", self.at) + MAGIC)


class PlaneReader:
    """Random access to one file through its index."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(size - 8 - len(MAGIC))
        tail = file.read(8 + len(MAGIC))
        if tail[8:] != MAGIC:
            raise ValueError("not a complete file of id planes")
        (at,) = struct.unpack("<Q", tail[:8])
        file.seek(at)
        index = json.loads(zstandard.ZstdDecompressor().decompress(file.read(size - 8 - len(MAGIC) - at)))
        self.bits, self.block = index["bits"], index["block"]
        self.blocks, self.documents = index["blocks"], index["documents"]

    def ids_of_block(self, k: int) -> np.ndarray:
        at, n, sizes = self.blocks[k]
        width = (n + 7) // 8 if self.bits else n
        planes = np.zeros((len(sizes), width), dtype=np.uint8)
        self.file.seek(at)
        for row, size in enumerate(sizes):
            if size:
                planes[row] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.file.read(size)), dtype=np.uint8)
        return from_planes(planes, n, self.bits)

    def read(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Ids from a place in the file on, block by block."""
        while n:
            k, skip = divmod(start, self.block)
            if getattr(self, "_at", None) != k:
                self._at, self._ids = k, self.ids_of_block(k)
            part = self._ids[skip: skip + n]
            yield part
            start, n = start + len(part), n - len(part)


def _file_system(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" in folder:
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder.removeprefix("file:")


# ---- the operator -----------------------------------------------------------------------

def write_token_files(
    documents: DataFrame, folder: str, path: str, *, end_id: int, id_column: str = "doc_id", text_column: str = "text",
    files: int | None = None, block: int = BLOCK, bits: bool = False,
) -> DataFrame:
    """Encode texts, end each with ``end_id``, write the files; one row a file.

    ``file, path, n_documents, n_ids``; files in order hold the documents in order.
    """
    spark = documents.sparkSession
    small_batches(spark)
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select(F.col(id_column).cast("bigint").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    end = np.array([end_id], dtype="<u4")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, writer, out = TaskContext.get().partitionId(), None, None
        store, root = _file_system(folder)
        own, final = f"{root}/.{number:06d}-{uuid.uuid4().hex}", f"{root}/ids-{number:06d}.planes"
        for batch in batches:
            names = [None if pd.isna(name) else int(name) for name in batch["id"].tolist()]
            for held in chunked(zip(names, batch["text"].tolist()), 64):
                for (name, _), octets in zip(held, encoder(path).encode([text for _, text in held])):
                    if writer is None:
                        store.create_dir(root, recursive=True)
                        out = store.open_output_stream(own)
                        writer = PlaneWriter(out, block, bits)
                    writer.add(name, np.concatenate([np.frombuffer(octets, dtype="<u4"), end]))
        if writer is not None:
            writer.close()
            out.close()
            store.move(own, final)
            yield pd.DataFrame({"file": [number], "path": [final], "n_documents": [len(writer.documents)], "n_ids": [writer.n_ids]})

    dealt = rows.repartitionByRange(files, *order).sortWithinPartitions(*order)
    # written once: the files must not be dealt out anew by a second evaluation
    return staged(dealt.mapInPandas(write, "file int, path string, n_documents bigint, n_ids bigint"), "token-files")


def read_token_files(manifest: DataFrame, folder: str, *, id_column: str = "doc_id") -> DataFrame:
    """``id, start, n_tokens, ids_crc32`` of every document, from the files alone.

    ``start`` counts the ids of all documents before it.  One row a file meets in the window.
    """
    before = Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = _file_system(folder)
        for batch in batches:
            for row in batch.itertuples(index=False):
                with store.open_input_file(row.path) as file:
                    reader, start = PlaneReader(file), 0
                    for held in chunked(reader.documents, 10_000):
                        out = []
                        for name, n in held:
                            crc = 0
                            for part in reader.read(start, n):
                                crc = zlib.crc32(part.tobytes(), crc)
                            out.append((name, row.first + start, n, crc))
                            start += n
                        yield pd.DataFrame(out, columns=[id_column, "start", "n_tokens", "ids_crc32"]).astype({id_column: "Int64"})

    files = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shards.repartition(files, "path").mapInPandas(
        read, f"{id_column} bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )


def token_files(documents: DataFrame, path: str, *, end_id: int, **options) -> DataFrame:
    """Write to a fresh shared folder and read back."""
    spark: SparkSession = documents.sparkSession
    folder = staging_path(spark, "id-planes")
    id_column = options.get("id_column", "doc_id")
    return read_token_files(write_token_files(documents, folder, path, end_id=end_id, **options), folder, id_column=id_column)
