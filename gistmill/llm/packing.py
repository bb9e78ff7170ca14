"""Packing documents into sequences by bulk-synchronous best fit.

Documents are encoded, ended with an end id and, only if longer than a sequence, cut into
pieces of a sequence's length.  Pieces are then placed in rounds.  In each round the pieces
left and the gaps of the open sequences are sorted together by range of size, largest
first, a gap before a piece of its size.  Each task sweeps its range: gaps are laid on a
stack, and a piece takes the one on top, which is the smallest gap that holds it.  A
sequence that still has room within the range is swept again right away.

What a range could not match meets in a second step: the unmatched pieces of a range stand
before its unmatched gaps, so a few numbers a range suffice to say which ranks of pieces
take which ranks of gaps, as brackets match, and pieces and gaps of equal rank are joined.
A piece that finds no gap anywhere is left for the next round.  New sequences are opened, by
the largest of these pieces, only for the volume that all gaps left could not hold even if
they were used to the last token, or when hardly anything was placed any more.  Gaps are
updated, those smaller than any piece left retire, and the rounds end when every piece has
its place.

Defined results: null text is an empty document (its end id alone); repeated rows are
documents of their own; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.llm.common import chunked, small_batches
from gistmill.llm.encoding import encoder
from gistmill.session import staged

LENGTH = 2048

#: Pieces and gaps in one range.
RANGE_ROWS = 50_000

#: A round that places less than this part of what it leaves opens sequences in any case.
STALLED = 10

_PIECE = "doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"


def encoded_pieces(documents: DataFrame, path: str, *, end_id: int, length: int, id_column: str, text_column: str) -> DataFrame:
    """A row for each piece, with the checksum of its ids."""
    small_batches(documents.sparkSession)
    kind = documents.schema[id_column].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for held in chunked(zip(batch["_id"], batch["_text"]), 64):
                for (name, _), octets in zip(held, encoder(path).encode([text for _, text in held])):
                    octets += end
                    for piece, at in enumerate(range(0, len(octets), 4 * length)):
                        part = octets[at: at + 4 * length]
                        out.append((name, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = documents.select(F.col(id_column).alias("_id"), F.coalesce(F.col(text_column), F.lit("")).alias("_text"))
    return rows.mapInPandas(encode, _PIECE.format(kind=kind))


def pack(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; no piece is longer than ``length``."""
    state = staged(pieces.select(
        F.monotonically_increasing_id().alias("id"), F.col("length").alias("size"), F.struct(*pieces.columns).alias("row")
    ), "packing-pieces")
    # a piece over half a sequence never shares one with another of the kind: each opens one
    opens = F.col("size") * 2 > length
    placed = [state.where(opens).select("row", F.col("id").alias("gap"), F.lit(0).cast("bigint").alias("offset"))]
    gaps = state.where(opens).select("id", (F.lit(length).cast("bigint") - F.col("size")).alias("size"))
    left = state.where(~opens)
    while True:
        n_pieces, smallest = left.agg(F.count(F.lit(1)), F.min("size")).first()
        if not n_pieces:
            break
        gaps = gaps.where(F.col("size") >= smallest)
        swept, after = _round(left, gaps, length, math.ceil((n_pieces + gaps.count()) / RANGE_ROWS))
        placed += [frame.where("kind = 'placed'").select("row", "gap", "offset") for frame in (swept, after)]
        gaps = swept.where("kind = 'gap' AND number IS NULL").select(F.col("gap").alias("id"), "size").unionByName(
            after.where("kind = 'gap'").select(F.col("gap").alias("id"), "size")
        )
        left = after.where("kind = 'piece'").select("id", "size", "row")
    return reduce(DataFrame.unionByName, placed).select("row.*", F.col("gap").alias("sequence_id"), "offset")


def _round(left: DataFrame, gaps: DataFrame, length: int, ranges: int) -> tuple[DataFrame, DataFrame]:
    """One round: what the sweeps of single ranges did, and what was done across ranges."""
    spark = left.sparkSession
    row = left.schema["row"].dataType
    both = left.select("id", "size", F.lit(1).alias("is_piece"), "row").unionByName(
        gaps.select("id", "size", F.lit(0).alias("is_piece"), F.lit(None).cast(row).alias("row"))
    )
    order = [F.col("size").desc(), F.col("is_piece"), F.xxhash64("id")]
    # rows for one range need not be dealt out
    dealt = (both.repartitionByRange(ranges, *order) if ranges > 1 else both.coalesce(1)).sortWithinPartitions(*order)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return sweep_range(batches, length, TaskContext.get().partitionId())

    swept = staged(dealt.mapInArrow(
        sweep, f"kind string, id bigint, size bigint, gap bigint, offset bigint, part int, number bigint, row {row.simpleString()}"
    ), "packing-sweep")
    piece, waits = F.col("kind") == "piece", F.col("number").isNotNull()
    counts = swept.groupBy("part").agg(
        F.count_if(piece).alias("pieces"), F.count_if((F.col("kind") == "gap") & waits).alias("gaps"),
        F.sum(F.when(piece, F.col("size")).otherwise(0)).alias("volume"),
        F.sum(F.when(F.col("kind") == "gap", F.col("size")).otherwise(0)).alias("free"),
        F.count_if(F.col("kind") == "placed").alias("placed"),
    ).orderBy("part").collect()
    spans = match_ranges([(r.part, r.pieces, r.gaps, r.volume) for r in counts], length, sum(r.free for r in counts), sum(r.placed for r in counts))
    # a few rows a range; tasks find the span of a rank in them
    table = F.broadcast(spark.createDataFrame(spans, "_kind string, _part int, low bigint, high bigint, rank bigint, does string"))
    waiting = swept.where("number IS NOT NULL")
    within = (F.col("kind") == F.col("_kind")) & (F.col("part") == F.col("_part")) & F.col("number").between(F.col("low"), F.col("high") - 1)
    # pieces count up and gaps down, as brackets close
    rank = F.when(F.col("kind") == "piece", F.col("rank") + F.col("number") - F.col("low")).otherwise(F.col("rank") + F.col("high") - 1 - F.col("number"))
    ranked = waiting.join(table, within, "left").select("kind", "id", "size", "gap", "row", "does", F.when(F.col("does") == "match", rank).alias("rank"))
    pairs = ranked.where("kind = 'piece' AND does = 'match'").select("rank", F.col("size").alias("need"), "row").join(
        ranked.where("kind = 'gap' AND does = 'match'").select("rank", "gap", "size"), "rank"
    )
    none, full = F.lit(None).cast("bigint"), F.lit(length).cast("bigint")

    def both_rows(place: Column, gap: Column, rest: Column) -> Column:
        """The piece in its place, and the gap that is left."""
        def one(kind, size, offset, piece):
            return F.struct(
                F.lit(kind).alias("kind"), none.alias("id"), size.alias("size"), gap.alias("gap"), offset.alias("offset"), piece.alias("row")
            )
        return F.inline(F.array(one("placed", none, place, F.col("row")), one("gap", rest, none, F.lit(None).cast(row))))

    after = (
        pairs.select(both_rows(full - F.col("size"), F.col("gap"), F.col("size") - F.col("need")))
        .unionByName(ranked.where("does = 'open'").select(both_rows(F.lit(0).cast("bigint"), F.col("id"), full - F.col("size"))))
        .unionByName(ranked.where("does IS NULL").select("kind", "id", "size", "gap", none.alias("offset"), "row"))
    )
    return swept, staged(after, "packing-round")


def sweep_range(batches: Iterator[pa.RecordBatch], length: int, part: int) -> Iterator[pa.RecordBatch]:
    """Best fit within a range: gaps and pieces from large to small, gaps first where equal.

    Every gap on the stack is at least as large as the piece at hand and the top is the
    smallest, because a gap comes onto it only when the sweep has come down to its size.
    """
    stack: list[tuple[int, int]] = []  # (size, sequence), smallest on top
    later: list[tuple[int, int]] = []  # heap of what is left of gaps, below the sweep
    alone = 0
    names = ["kind", "id", "size", "gap", "offset", "part", "number"]
    types = [pa.string(), *[pa.int64()] * 4, pa.int32(), pa.int64()]

    def rows_of(out: list[tuple], row: pa.Array) -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [[]] * len(names)
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types)), row], names=[*names, "row"])

    kind = None
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("row"))
        kind, out, taken = column.type, [], []
        fields = [batch.column(batch.schema.get_field_index(name)).to_pylist() for name in ("id", "size", "is_piece")]
        for at, (name, size, is_piece) in enumerate(zip(*fields)):
            while later and -later[0][0] >= size:
                rest, sequence = heappop(later)
                stack.append((-rest, sequence))
            if not is_piece:
                stack.append((size, name))
                continue
            taken.append(at)
            if not stack:
                out.append(("piece", name, size, None, None, part, alone))
                alone += 1
                continue
            gap, sequence = stack.pop()
            out.append(("placed", name, size, sequence, length - gap, part, None))
            if gap - size >= size:
                stack.append((gap - size, sequence))
            elif gap > size:
                heappush(later, (size - gap, sequence))
        if out:
            yield rows_of(out, column.take(pa.array(taken, pa.int64())))
    if stack or later:
        out = [("gap", None, size, sequence, None, part, number) for number, (size, sequence) in enumerate(stack)]
        out += [("gap", None, -rest, sequence, None, part, None) for rest, sequence in later]
        for held in chunked(out, 10_000):
            yield rows_of(held, pa.nulls(len(held), kind))


def match_ranges(counts: list[tuple], length: int, free: int, placed: int) -> list[tuple]:
    """Which ranks of unmatched pieces take which gaps: ``(kind, part, low, high, rank, does)``.

    ``counts`` has part, pieces, gaps and the pieces' volume, in order; ``free`` is the volume
    of all gaps and ``placed`` what the sweeps placed.  Pieces of a part take
    the gaps of the nearest parts before it, the last gap of a part first.  Of the pieces for
    which none is left, the first open new sequences.
    """
    spans, stack, rank, unplaced = [("none", -1, 0, 0, 0, "none")], [], 0, []
    for part, pieces, gaps, volume in counts:
        low = 0
        while low < pieces and stack:
            owner, first, last = stack.pop()
            n = min(pieces - low, last - first)
            spans.append(("piece", part, low, low + n, rank, "match"))
            spans.append(("gap", owner, last - n, last, rank, "match"))
            rank, low = rank + n, low + n
            if last - n > first:
                stack.append((owner, first, last - n))
        if low < pieces:
            unplaced.append((part, low, pieces, volume / pieces))
        if gaps:
            stack.append((part, 0, gaps))
    volume = sum((high - low) * mean for _, low, high, mean in unplaced)
    free -= sum(volume for *_, volume in counts) - volume
    quota = math.ceil(max(volume - free, 0) / length)
    if (rank + placed) * STALLED < sum(high - low for _, low, high, _ in unplaced):
        quota = max(quota, math.ceil(volume / length / 4))
    for part, low, high, _ in unplaced:
        n = min(quota, high - low)
        if n:
            spans.append(("piece", part, low, low + n, 0, "open"))
        quota -= n
    return spans


def pack_documents(
    documents: DataFrame, path: str, *, end_id: int = 0, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece."""
    return pack(encoded_pieces(documents, path, end_id=end_id, length=length, id_column=id_column, text_column=text_column), length)
