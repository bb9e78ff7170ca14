"""Near-duplicates by SimHash, found through an index on bytes at their positions.

Two fingerprints of 64 bits that differ in at most ``bits`` places (4 at most) agree in at
least four of their eight bytes.  A posting list for each single byte value would hold a
256th of all fingerprints, so the index is keyed on byte triples instead: a fixed family of
20 triples of positions such that any four positions contain one of them.  In a posting
list the shared bytes of a pair are counted, pairs with fewer than the guaranteed four are
dropped, and what is left is verified bit by bit.

Copies share a fingerprint, so lists hold different fingerprints only.  Long lists are split
at random into parts and every pair of parts is a group of its own, so a group has a bound
and no pair is lost; of the links in a group, as many leave the task as join the same nodes.

Defined results: null and blank texts have the fingerprint zero and are linked like any
other; repeated rows give a row each; a null id takes part, and the component's id is the
smallest that is not null (null if there is none); an empty table gives no rows; other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.llm.common import small_batches, whole_row
from gistmill.llm.components import components, spanning
from gistmill.session import staged

SHINGLE, SEED, BITS = 4, 42, 4

#: Bytes that any pair within BITS must share, of 8.
GUARANTEED = 8 - BITS

#: Different fingerprints in one part of a posting list.
PART = 1024


def byte_triples() -> list[tuple[int, int, int]]:
    """20 triples of the 8 positions; any 4 positions contain one.

    Positions fall into three classes; a triple lies in one class, or has two positions in
    a class and one in the next.
    """
    kinds = [p % 3 for p in range(8)]
    chosen = []
    for triple in combinations(range(8), 3):
        has = [sum(kinds[p] == k for p in triple) for k in range(3)]
        if 3 in has or any(has[k] == 2 and has[(k + 1) % 3] == 1 for k in range(3)):
            chosen.append(triple)
    return chosen


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> list[int]:
    """Hashes of all word shingles of a whole text; of all its words if they are too few for one."""
    words = (text or "").encode().lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths).tolist(), ends.tolist()
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return [digest(joined, seed)]
    return [digest(joined[s:e], seed) for s, e in zip(starts, ends[shingle - 1:])]


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned fingerprint of a whole text: a bit is 1 if over half of the shingle hashes have it."""
    hashes = shingle_hashes(text, shingle, seed)
    if not hashes:
        return 0
    octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(octets), 16_384):
        ones += np.unpackbits(octets[i: i + 16_384], axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(ones * 2 > len(octets), bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column) -> Column:
    """The fingerprint as a signed bigint of the same bits."""

    @F.pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(text) for text in texts], dtype=np.uint64).view(np.int64))

    return of(text)


def near_fingerprints(prints: DataFrame, bits: int = BITS, part: int = PART) -> DataFrame:
    """Links ``a, b`` that join all of ``print`` (different fingerprints) that are within ``bits`` of each other."""
    if bits > BITS:
        raise ValueError(f"the index finds pairs within {BITS} bits")
    byte = [F.shiftrightunsigned("print", 8 * p).bitwiseAND(F.lit(255)) for p in range(8)]
    keys = [
        F.lit(number << 24) + byte[x] * 65_536 + byte[y] * 256 + byte[z] for number, (x, y, z) in enumerate(byte_triples())
    ]
    posted = prints.select("print", F.explode(F.array(*keys)).alias("key"))
    long = staged(posted.groupBy("key").count().where(F.col("count") > part).select(
        "key", F.ceil(F.col("count") / part).cast("int").alias("parts")
    ), "simhash-long-lists")
    own = F.pmod(F.xxhash64("print"), F.col("parts")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(j, own) * F.col("parts") + F.greatest(j, own))
    dealt = posted.join(long, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).select(
        "key", F.explode(others).alias("pair"), "print"
    )
    files = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_lists = dealt.repartition(files, "key", "pair").sortWithinPartitions("key", "pair")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            held = now if held is None else [np.concatenate(two) for two in zip(held, now)]
            key, pair, _ = held
            last = _start_of_last(key, pair) if len(key) else 0
            if last:
                yield _linked([column[:last] for column in held], bits)
                held = [column[last:] for column in held]
        if held is not None and len(held[0]):
            yield _linked(held, bits)

    return sorted_lists.mapInArrow(link, "a bigint, b bigint").distinct()


def _start_of_last(key: np.ndarray, pair: np.ndarray) -> int:
    other = np.nonzero((key != key[-1]) | (pair != pair[-1]))[0]
    return int(other[-1]) + 1 if len(other) else 0


def _linked(columns: list[np.ndarray], bits: int) -> pa.RecordBatch:
    """Links among rows of the same list; rows of a list stand together."""
    key, pair, signed = columns
    prints = signed.view(np.uint64)
    found_a, found_b, n = [], [], 0
    at, apart = np.arange(len(key) - 1), 1
    while True:
        at = at[at + apart < len(key)]
        at = at[(key[at] == key[at + apart]) & (pair[at] == pair[at + apart])]
        if not len(at):
            break
        differ = prints[at] ^ prints[at + apart]
        shared = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        likely = shared >= GUARANTEED
        near = np.nonzero(likely)[0][np.bitwise_count(differ[likely]) <= bits]
        found_a.append(signed[at[near]])
        found_b.append(signed[at[near] + apart])
        n += len(near)
        if n > 500_000:
            a, b = spanning(np.concatenate(found_a), np.concatenate(found_b))
            found_a, found_b, n = [a], [b], 0
        apart += 1
    a, b = spanning(np.concatenate(found_a), np.concatenate(found_b)) if n or found_a else (signed[:0], signed[:0])
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _grouped(documents: DataFrame, id_column: str, text_column: str, bits: int) -> tuple[DataFrame, DataFrame]:
    """Rows as ``_id, _hash, print``, and ``print, root, component_id`` of the different fingerprints."""
    small_batches(documents.sparkSession)
    prints = staged(documents.select(
        F.col(id_column).alias("_id"), F.xxhash64(text_column).alias("_hash"),
        fingerprint_column(F.col(text_column)).alias("print"),
    ), "simhash-prints")
    different = staged(prints.groupBy("print").agg(F.min("_id").alias("first")), "simhash-different")
    roots = components(near_fingerprints(different.select("print"), bits)).withColumnRenamed("node", "print")
    rooted = different.join(roots, "print", "left").select("print", "first", F.coalesce("root", "print").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints, staged(rooted.join(smallest, "root"), "simhash-named")


def simhash_groups(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", bits: int = BITS) -> DataFrame:
    """``id, fingerprint, component_id`` of every row."""
    prints, named = _grouped(documents, id_column, text_column, bits)
    return prints.join(named.select("print", "component_id"), "print").select(
        F.col("_id").alias(id_column), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each_group(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", bits: int = BITS) -> DataFrame:
    """One document of each group, with all its columns: the one with the smallest id.

    Ids that are null come last; among rows that repeat the id, one with the smallest
    fingerprint and text hash stays.
    """
    prints, named = _grouped(documents, id_column, text_column, bits)
    unnamed = F.col("_id").isNull().alias("unnamed")
    chosen = staged(
        prints.join(named.select("print", "root"), "print").groupBy("root")
        .agg(F.min(F.struct(unnamed, "_id", "print", "_hash")).alias("best")).select("best.*"), "simhash-chosen"
    )
    return single_rows(documents, prints, chosen, id_column, text_column)


def single_rows(documents: DataFrame, prints: DataFrame, chosen: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Documents of the chosen ids and text hashes, one row for each.

    Texts cross one shuffle, whatever their number; only rows that repeat both are
    gathered to leave one.
    """
    repeated = prints.groupBy("_id", "_hash").agg(F.count(F.lit(1)).alias("_rows"))
    wanted = staged(
        chosen.select(F.struct("_id", "_hash").alias("_key")).join(
            repeated.select(F.struct("_id", "_hash").alias("_key"), "_rows"), "_key"
        ).select(F.col("_key._id").alias("_id"), F.col("_key._hash").alias("_hash"), "_rows"), "simhash-wanted"
    ).hint("merge")
    # a document travels as one column, so that no name of its own meets a helper's
    hashed = documents.select(whole_row(documents).alias("_row"), F.col(id_column).alias("_named"), F.xxhash64(text_column).alias("_own"))
    joined = hashed.join(wanted, F.col("_named").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash")))
    once = joined.where("_rows = 1").select("_row")
    return once.unionByName(joined.where("_rows > 1").dropDuplicates(["_named", "_own"]).select("_row")).select("_row.*")
