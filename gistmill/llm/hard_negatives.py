"""Hard negatives: integer inner products of anchors and candidates by Strassen's recursion.

Rows are packed into tiles of one label each, anchors and candidates alike.  A product of two
tiles multiplies halves recursively with seven products instead of eight, padding odd sides
with zeros; sums and products are exact, in floating point where all of them are whole numbers
that it holds, else in 64-bit integers.  Candidate tiles are dealt over stripes, anchor tiles
over bundles of bounded size, and a cell is a stripe and a bundle: a task reads the anchors of
its cell first, holds them, and then meets the candidates one tile at a time, so each pair of
tiles meets once, no row carries two tiles and nothing is broadcast.  A task keeps one bounded
heap for each anchor of its bundle: the first positives in the first pass (tiles of equal label
only), the best candidates inside each positive's window in the second (tiles of other labels).
Heaps leave a task packed by anchor tile and are merged by it.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take
no part; an empty vector scores 0 and a shorter one counts as padded with zeros; rows with the
same id are rows of their own, also as anchors; ties go to the smaller id; an empty table gives
no rows; other columns are not looked at.  Scores are exact while ten times a score fits 64
bits; a component beyond that range is held at its end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.session import staged

#: Rows of a tile of candidates, and of anchors.
TILE, ANCHOR_TILE = 512, 1024

#: Anchors whose heaps a task holds at a time, and stripes of candidates at most: heaps on disk grow with
#: the stripes, candidates with the bundles.
BUNDLE, STRIPES = 32768, 32

#: Bytes of tiles in an Arrow batch, and of a Parquet row group of tiles, which Spark reads into memory whole.
BATCH_BYTES = 16 << 20

#: Sides up to which tiles are multiplied directly.
LEAF = 32

POSITIVES, NEGATIVES = 5, 10

#: A negative's score lies between these tenths of the positive's.
WINDOW = (3, 9)

_TILES = "label bigint, tile bigint, n int, kind string, ids binary, rows binary, vectors binary"

_HEAPS = "tile bigint, stripe int, n int, owners binary, scores binary, found binary, about binary"

_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Exact product of two matrices: int64 sums wrap modulo 2**64 and so cancel exactly; for floats see ``_exact``."""
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= leaf:
        return np.einsum("ij,jk->ik", a, b) if a.dtype == np.int64 else a @ b
    if (m | k | n) & 1:
        a = np.pad(a, ((0, m & 1), (0, k & 1)))
        b = np.pad(b, ((0, k & 1), (0, n & 1)))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * l), dtype=a.dtype)
    out[:i, :l], out[:i, l:] = p1 + p4 - p5 + p7, p3 + p5
    out[i:, :l], out[i:, l:] = p2 + p4, p1 - p2 + p3 + p6
    return out[:m, :n]


def _exact(m: int, k: int, n: int, top_a: int, top_b: int, leaf: int = LEAF) -> type:
    """Narrowest type that holds every sum inside ``strassen`` of matrices with entries up to ``top_a`` and ``top_b``.

    A step doubles the entries of both sides and halves ``k``, so its products have twice the
    bound; what is summed from them while it ends has four times the bound it began with.
    """
    steps = 0
    while min(m, k, n) > leaf:
        m, k, n, steps = m + 1 >> 1, k + 1 >> 1, n + 1 >> 1, steps + 1
    most = (k << steps) * top_a * top_b << (steps + 1 if steps else 0)
    return np.float32 if most <= 2**24 else np.float64 if most <= 2**53 else np.int64


def integer_vector(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of every component; null if the vector or a component is unusable."""
    usable = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(usable, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint")))


class Heaps:
    """The best ``size`` of ``score`` (larger first), then ``id``, then ``row``, for each of ``owners``, by owner and score."""

    def __init__(self, owners: int, size: int):
        self.size = size
        self.owner, self.score, self.id, self.row = (np.zeros(0, dtype=np.int64) for _ in range(4))
        #: A score below this cannot enter an owner's heap any more, nor one as large with a larger id.
        self.least, self.last = np.full(owners, _LEAST), np.full(owners, _MOST)

    def push(self, owner: np.ndarray, score: np.ndarray, ident: np.ndarray, row: np.ndarray) -> None:
        if not len(owner):
            return
        columns = [np.concatenate(two) for two in
                   ((self.owner, owner), (self.score, score), (self.id, ident), (self.row, row))]
        top, span = int(columns[1].max()), int(columns[1].max()) - int(columns[1].min()) + 1
        # the complement turns larger first into smaller first without overflow
        order = np.argsort(columns[0] * span + (top - columns[1])) if span * len(self.least) < _MOST else np.lexsort((~columns[1], columns[0]))
        columns = [column[order] for column in columns]
        starts = np.flatnonzero(np.r_[True, columns[0][1:] != columns[0][:-1]])
        sizes = np.diff(np.r_[starts, len(order)])
        full = starts[sizes >= self.size] + self.size - 1
        owners = columns[0][full]
        self.least[owners] = columns[1][full]
        keep = columns[1] >= self.least[columns[0]]
        # of those that tie for the last places only the smallest ids and rows stay
        edge = np.zeros(len(self.least), dtype=bool)
        edge[owners] = True
        tied = np.flatnonzero(edge[columns[0]] & (columns[1] == self.least[columns[0]]))
        tied = tied[np.lexsort((columns[3][tied], columns[2][tied], columns[0][tied]))]
        above = np.bincount(columns[0][keep & (columns[1] > self.least[columns[0]])], minlength=len(edge))
        first = np.flatnonzero(np.r_[True, columns[0][tied][1:] != columns[0][tied][:-1]][: len(tied)])
        place = np.arange(len(tied)) - np.repeat(first, np.diff(np.r_[first, len(tied)]))
        free = self.size - above[columns[0][tied]]
        keep[tied[place >= free]] = False
        ends = tied[place == free - 1]
        self.last[columns[0][ends]] = columns[2][ends]
        self.owner, self.score, self.id, self.row = (column[keep] for column in columns)


class _Anchors:
    """An anchor tile and its heaps: ``place`` of each owner (its anchor, ascending), scores from ``lower`` to ``upper``."""

    def __init__(self, own: np.ndarray, vectors: np.ndarray, place: np.ndarray, lower: np.ndarray, upper: np.ndarray, size: int):
        self.own, self.vectors, self.place, self.upper, self.lower = own, {vectors.dtype.type: vectors}, place, upper, lower
        self.top = _top(vectors)
        self.heaps, self.size, self.pending, self.waiting = Heaps(len(place), size), size, [], 0
        self.sizes = np.bincount(place, minlength=len(own))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.high = np.full(len(own), _LEAST)
        np.maximum.at(self.high, place, upper)
        self._settle()

    def _settle(self) -> None:
        """Scores that may enter, for each owner and for each anchor."""
        self.floor = np.maximum(self.lower, self.heaps.least)
        self.low = np.full(len(self.own), _MOST)
        np.minimum.at(self.low, self.place, np.where(self.lower > self.upper, _MOST, self.floor))
        self.ends = {}

    def meet(self, ids: np.ndarray, rows: np.ndarray, matrix: dict, top: int, others: bool) -> None:
        """Candidates of a tile; ``others``: none of them is an anchor of this tile."""
        scores = self._product(matrix, top)
        kind = scores.dtype.type
        if kind not in self.ends:  # no score of a floating type lies beyond its whole numbers
            most = {np.float32: 2**24, np.float64: 2**53}.get(kind, _MOST)
            self.ends[kind] = [np.clip(end, -most, most).astype(kind)[:, None] for end in (self.low, self.high)]
        low, high = self.ends[kind]
        many = 4 * self.size * len(self.place)
        at = np.flatnonzero(scores >= low)
        if len(at) > many:
            at = np.flatnonzero((scores >= low) & (scores <= high))
        if not len(at):
            return
        i, j = np.divmod(at, scores.shape[1])
        if int(self.sizes[i].sum()) > many:
            owner, j, score = self._best(scores, rows, others)
        else:
            score = scores.ravel()[at].astype(np.int64)
            fit = score <= self.high[i]
            if not others:
                fit &= rows[j] != self.own[i]
            i, j, score = i[fit], j[fit], score[fit]
            sizes = self.sizes[i]
            owner = np.arange(sizes.sum()) + np.repeat(self.starts[i] - (np.cumsum(sizes) - sizes), sizes)
            j, score = np.repeat(j, sizes), np.repeat(score, sizes)
        least = self.heaps.least[owner]
        fit = (score >= self.floor[owner]) & (score <= self.upper[owner]) & ((score > least) | (ids[j] <= self.heaps.last[owner]))
        owner, j, score = owner[fit], j[fit], score[fit]
        self.pending.append((owner, score, ids[j], rows[j]))
        self.waiting += len(owner)
        if self.waiting > self.size * len(self.place):
            self.settle()

    def _product(self, matrix: dict, top: int) -> np.ndarray:
        """``matrix`` and ``vectors`` hold one matrix in all types that were needed."""
        a, b = next(iter(self.vectors.values())), next(iter(matrix.values()))
        kind = _exact(len(a), max(a.shape[1], b.shape[1]), len(b), self.top, top)
        for held in (self.vectors, matrix):
            if kind not in held:
                held[kind] = next(iter(held.values())).astype(kind)
        return _product(self.vectors[kind], matrix[kind])

    def _best(self, scores: np.ndarray, rows: np.ndarray, others: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best ``size`` of the tile for each owner, with all that tie for the last place: no others can enter its heap."""
        found = []
        for at in range(0, len(self.place), 1024):
            place = self.place[at: at + 1024]
            score = scores[place].astype(np.int64)
            fit = (score >= self.floor[at: at + 1024, None]) & (score <= self.upper[at: at + 1024, None])
            if not others:
                fit &= rows != self.own[place, None]
            score[~fit] = _LEAST
            if score.shape[1] > self.size:
                fit &= score >= np.partition(score, -self.size, axis=1)[:, -self.size, None]
            i, j = np.nonzero(fit)
            found.append((i + at, j, score[i, j]))
        return tuple(np.concatenate(column) for column in zip(*found))

    def settle(self) -> None:
        if self.pending:
            self.heaps.push(*(np.concatenate(column) for column in zip(*self.pending)))
            self.pending, self.waiting = [], 0
            self._settle()


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Tiles of at most ``size`` rows of one label from ``label, id, row, vector``, sorted by label and id."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, part = 0, TaskContext.get().partitionId() << 24
        for batch in batches:
            label, ident = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            own = batch.column(2).to_numpy(zero_copy_only=False)
            lists = batch.column(3)
            widths = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(widths)
            cuts = [0, *np.flatnonzero(label[1:] != label[:-1]) + 1, len(label)]
            for start, stop in zip(cuts, cuts[1:]):
                for at in range(start, stop, size):
                    to, tile = min(at + size, stop), part + count
                    wide = max(int(widths[at:to].max()), 1)
                    matrix = np.zeros((to - at, wide), dtype=np.int64)
                    matrix[np.arange(wide) < widths[at:to, None]] = flat[ends[at] - widths[at]: ends[to - 1]]
                    kind = next(k for k in ("<i2", "<i4", "<i8") if _fits(matrix, k))
                    numbers = np.where(own[at:to] < 0, tile * TILE + np.arange(to - at), own[at:to])
                    yield pa.RecordBatch.from_arrays([
                        pa.array([int(label[at])], pa.int64()), pa.array([tile], pa.int64()), pa.array([to - at], pa.int32()),
                        pa.array([kind]), pa.array([ident[at:to].astype("<i8").tobytes()], pa.binary()),
                        pa.array([numbers.astype("<i8").tobytes()], pa.binary()), pa.array([matrix.astype(kind).tobytes()], pa.binary()),
                    ], names=["label", "tile", "n", "kind", "ids", "rows", "vectors"])
                    count += 1

    return rows.select("label", "id", "row", "vector").mapInArrow(pack, _TILES)


def _fits(matrix: np.ndarray, kind: str) -> bool:
    limits = np.iinfo(kind)
    return limits.min <= matrix.min() and matrix.max() <= limits.max


def _anchors(tiles: DataFrame, every: int) -> DataFrame:
    """Rows of tiles whose id is divisible by ``every``, as rows again."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile in batch.to_pylist():
                ids, own, matrix = _opened(tile)
                take = np.flatnonzero(ids % every == 0)
                if len(take):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(take), tile["label"])), pa.array(ids[take]), pa.array(own[take]),
                        pa.array(list(matrix[take]), pa.list_(pa.int64())),
                    ], names=["label", "id", "row", "vector"])

    return tiles.mapInArrow(rows, "label bigint, id bigint, row bigint, vector array<bigint>")


def _opened(tile: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, rows = (np.frombuffer(tile[name], "<i8") for name in ("ids", "rows"))
    return ids, rows, np.frombuffer(tile["vectors"], tile["kind"]).reshape(len(ids), -1).astype(np.int64)


def _top(matrix: np.ndarray) -> int:
    return max(int(matrix.max(initial=0)), -int(matrix.min(initial=0)))


def _product(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    wide = max(anchors.shape[1], candidates.shape[1])
    a, b = (np.pad(m, ((0, 0), (0, wide - m.shape[1]))) if m.shape[1] < wide else m for m in (anchors, candidates))
    return strassen(a, np.ascontiguousarray(b.T) if b.dtype == np.int64 else b.T)


def _dealt(share: int) -> Column:
    """In turn within each partition that packed tiles; their numbers begin with that partition's."""
    return F.pmod(F.col("tile") + F.shiftright("tile", 24), F.lit(share)).cast("int")


def _met(anchors: DataFrame, tiles: DataFrame, same: bool, size: int, window: tuple[int, int] = WINDOW) -> DataFrame:
    """Heaps, packed by anchor tile and stripe, of every anchor tile and the candidate tiles of its label, or of other labels.

    Anchors with ``places`` and ``positive_scores`` have a heap for each of these, else one each.
    """
    # tasks of the first pass hold one label at a time
    n_anchors = anchors.groupBy(*["label"] * same).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    n_tiles = tiles.count()
    bundles = max(1, -(-n_anchors // BUNDLE))
    stripes = max(1, min(STRIPES, n_tiles, int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cells = bundles * stripes
    all_of = {n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (bundles, stripes)}
    left = anchors.select("*", F.lit(False).alias("is_candidate"), _dealt(bundles).alias("bundle"), all_of[stripes].alias("stripe"))
    right = tiles.select("*", F.lit(True).alias("is_candidate"), all_of[bundles].alias("bundle"), _dealt(stripes).alias("stripe"))
    # a task of the first pass has one cell of every label
    first = F.pmod(F.xxhash64("label"), F.lit(cells)) if same else F.lit(0)
    rows = left.unionByName(right, allowMissingColumns=True).withColumn(
        "cell", F.pmod(first + F.col("stripe") * bundles + F.col("bundle"), F.lit(cells)).cast("int"))
    order = ["cell", "label", "is_candidate"] if same else ["cell", "is_candidate", "label"]
    rows = rows.repartitionById(cells, F.col("cell")).sortWithinPartitions(*order, "tile")

    def opened(tile: dict) -> tuple:
        ids, own, vectors = _opened(tile)
        if tile.get("places") is None:
            place = np.arange(len(own))
            lower, upper, about = np.full(len(own), _LEAST), np.full(len(own), _MOST), b""
        else:
            place, positive_ids, positive_scores = (np.frombuffer(tile[name], "<i8") for name in ("places", "positive_ids", "positive_scores"))
            # smallest and largest score whose tenfold lies between the bounds
            lower, upper = -(-positive_scores * window[0] // 10), positive_scores * window[1] // 10
            about = np.concatenate([ids[place], positive_ids, positive_scores]).astype("<i8").tobytes() if tile["stripe"] == 0 else b""
        return tile["label"], tile["tile"], tile["stripe"], about, _Anchors(own, vectors, place, lower, upper, size)

    def flushed(held: list) -> Iterator[pa.RecordBatch]:
        for _, tile, stripe, about, met in held:
            met.settle()
            heaps = met.heaps
            if stripe == 0 or len(heaps.owner):
                yield pa.RecordBatch.from_arrays([
                    pa.array([tile], pa.int64()), pa.array([stripe], pa.int32()), pa.array([len(met.place)], pa.int32()),
                    *[pa.array([column.astype(kind).tobytes()], pa.binary()) for column, kind in
                      ((heaps.owner, "<i4"), (heaps.score, "<i8"), (heaps.id, "<i8"))], pa.array([about], pa.binary()),
                ], names=[field.split()[0] for field in _HEAPS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            for at in range(batch.num_rows):
                tile = batch.slice(at, 1).to_pylist()[0]
                if key != (key := (tile["cell"], tile["label"] if same else None)):
                    yield from flushed(held)
                    held = []
                if not tile["is_candidate"]:
                    held.append(opened(tile))
                    continue
                ids, own, vectors = _opened(tile)
                matrix, top = {np.int64: vectors}, _top(vectors)
                for label, *_, met in held:
                    if same or label != tile["label"]:
                        met.meet(ids, own, matrix, top, not same)
        yield from flushed(held)

    return rows.mapInArrow(run, _HEAPS)


def _merged(heaps: DataFrame, size: int, out: Callable[[int, Heaps, bytes], pa.RecordBatch], schema: str) -> DataFrame:
    """``out`` of every anchor tile, its heaps over all stripes and what the first stripe's says about it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, merged, about = None, None, b""
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if row["tile"] != last:
                    if merged:
                        yield out(last, merged, about)
                    last, merged, about = row["tile"], Heaps(row["n"], size), row["about"]
                owner, score, ident = (np.frombuffer(row[name], kind).astype(np.int64) for name, kind in
                                       (("owners", "<i4"), ("scores", "<i8"), ("found", "<i8")))
                # rows of equal id and score look the same in what follows
                merged.push(owner, score, ident, np.zeros(len(owner), dtype=np.int64))
        if merged:
            yield out(last, merged, about)

    return heaps.repartition("tile").sortWithinPartitions("tile", "stripe").mapInArrow(run, schema)


def _ranked(heaps: Heaps) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owner, rank from 1, score and id."""
    order = np.lexsort((heaps.id, ~heaps.score, heaps.owner))
    owner = heaps.owner[order]
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]][: len(owner)])
    rank = np.arange(len(owner)) - np.repeat(starts, np.diff(np.r_[starts, len(owner)])) + 1
    return owner, rank, heaps.score[order], heaps.id[order]


def _slots(tile: int, heaps: Heaps, about: bytes) -> pa.RecordBatch:
    place, _, score, ident = _ranked(heaps)
    blobs = [pa.array([column.astype("<i8").tobytes()], pa.binary()) for column in (place, ident, score)]
    return pa.RecordBatch.from_arrays([pa.array([tile], pa.int64()), *blobs], names=["tile", "places", "positive_ids", "positive_scores"])


def _results(tile: int, heaps: Heaps, about: bytes) -> pa.RecordBatch:
    anchor, positive, positive_score = np.frombuffer(about, "<i8").reshape(3, -1)
    owner, rank, score, ident = _ranked(heaps)
    columns = {"anchor_id": anchor[owner], "positive_id": positive[owner], "rank": rank.astype(np.int32),
               "negative_id": ident, "positive_score": positive_score[owner], "negative_score": score}
    return pa.RecordBatch.from_pydict(columns)


def hard_negatives(
    rows: DataFrame, *, id_column: str = "vec_id", label_column: str = "label", vector_column: str = "vector", every: int = 100,
    positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vector_column`` holds integers.  Anchors are the rows whose id is divisible by ``every``.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    vector = F.col(vector_column)
    usable = rows.where(vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull())).select(
        F.col(label_column).cast("bigint").alias("label"), F.col(id_column).cast("bigint").alias("id"),
        F.lit(-1).cast("bigint").alias("row"), vector.cast("array<bigint>").alias("vector"),
    ).where("label IS NOT NULL AND id IS NOT NULL")
    ranged = usable.repartitionByRange("label", F.xxhash64("id")).sortWithinPartitions("label", "id")
    tiles = staged(_packed(ranged, TILE), "negatives-tiles", BATCH_BYTES)
    anchors = staged(_packed(
        _anchors(tiles, every).repartitionByRange("label", F.xxhash64("row")).sortWithinPartitions("label", "id"), ANCHOR_TILE
    ), "negatives-anchors", BATCH_BYTES)

    slots = _merged(_met(anchors, tiles, True, positives), positives, _slots, "tile bigint, places binary, positive_ids binary, positive_scores binary")
    aimed = staged(anchors.join(slots, "tile"), "negatives-positives", BATCH_BYTES)
    return _merged(
        _met(aimed, tiles, False, negatives, window), negatives, _results,
        "anchor_id bigint, positive_id bigint, rank int not null, negative_id bigint, positive_score bigint, negative_score bigint",
    )


def hard_negatives_sql(rows: str) -> str:
    """The same for ``rows`` with ``vec_id, label, vector`` (a list of DOUBLE that holds integers), 5 and 10 of them."""
    return f"""
    WITH v AS (SELECT vec_id, label, vector FROM {rows} WHERE label IS NOT NULL AND vector IS NOT NULL),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.vector, b.vector) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
    n AS (SELECT anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score,
        CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score)
    SELECT * FROM n WHERE rank <= 10"""
