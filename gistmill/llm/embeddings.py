"""Near-duplicate vectors by a pigeonhole join on blocks of rotated coordinates.

Unit vectors with cosine c are sqrt(2 - 2c) apart.  All vectors are turned by one random
rotation, which spreads any structure evenly, and cut into blocks of coordinates.  Each
block has a share of the squared distance in proportion to its width; a pair within the
whole budget is within the share in at least one block.  So each block is range-joined by
itself: a grid of cells over its first coordinates, as wide as twice the block's radius,
brings together what can be within it, a window over the first coordinate and the block's
distance leave few candidates, and these are verified by the cosine of the whole vectors in
double precision.  A pair within the share of several blocks counts in the first of them.

Equal vectors of a label are one row with a multiplicity.  Cells with many vectors are split
at random into parts and every pair of parts is a group of its own, so a group has a bound
and no pair is lost.  What leaves a group is one row a vector: its number of links there,
and a link that joins it to its component, never the pairs.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components,
and those without label, link with nothing; vectors of different length are never compared;
repeated rows are vectors of their own that link with each other; a null id takes part and
a component's id is the smallest that is not null; an empty table gives no rows; other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.llm.common import small_batches
from gistmill.llm.components import components, spanning
from gistmill.session import staged

THRESHOLD, BLOCKS, SEED = 0.98, 4, 7

#: Vectors in one part of a cell.
PART = 2048

#: Leeway for rounding in what only proposes candidates.
SLACK = 1e-9


def rotation(width: int, seed: int = SEED) -> np.ndarray:
    """Random orthogonal matrix, the same for every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def block_ends(width: int, blocks: int) -> list[tuple[int, int]]:
    ends = np.linspace(0, width, min(blocks, width) + 1).astype(int)
    return list(zip(ends[:-1].tolist(), ends[1:].tolist()))


def block_radius(share: float) -> float:
    """Radius of a cell's neighbourhood: no smaller than what the share and its leeway allow."""
    return float(np.sqrt(share + SLACK)) * (1 + 1e-9)


def embedding_links(
    vectors: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
    threshold: float = THRESHOLD, blocks: int = BLOCKS, part: int = PART,
) -> DataFrame:
    """``id, n_links, component_id, kept`` of every row."""
    small_batches(vectors.sparkSession)
    finite = ~F.exists("_vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("_label").isNotNull() & F.col("_vector").isNotNull() & finite & F.exists("_vector", lambda x: x != 0)
    rows = vectors.select(
        F.col(id_column).alias("_id"), F.col(label_column).alias("_label"),
        F.transform(F.col(vector_column), lambda x: x.cast("double")).alias("_vector"),
    ).withColumn("_usable", F.coalesce(usable, F.lit(False)))
    alone = rows.where(~F.col("_usable")).select(
        F.col("_id").alias(id_column), F.lit(0).cast("bigint").alias("n_links"), F.col("_id").alias("component_id"), F.lit(True).alias("kept")
    )
    # a digest of the exact components stands for the vector from here on
    print_ = F.sha2(F.to_json(F.struct("_label", "_vector")), 256)
    keyed = rows.where("_usable").withColumn("_print", print_)
    classes = staged(
        keyed.groupBy("_print").agg(
            F.first("_label").alias("label"), F.first("_vector").alias("vector"), F.count(F.lit(1)).alias("copies"), F.min("_id").alias("first")
        ).withColumn("cls", F.monotonically_increasing_id()), "vector-classes"
    )
    near = staged(near_classes(classes, threshold, blocks, part), "vector-links")
    linked = near.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = components(near.where("cls <> root").select(F.col("cls").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cls")
    thin = classes.select("_print", "cls", "copies", "first")
    rooted = staged(
        thin.join(linked, "cls", "left").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls")), "vector-rooted"
    )
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = staged(rooted.join(smallest, "root").select(
        "_print", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("bigint").alias("n_links"), "component_id"
    ), "vector-named")
    grouped = keyed.select("_id", "_print").join(named, "_print").select(
        F.col("_id").alias(id_column), "n_links", "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept")
    )
    return grouped.unionByName(alone)


def near_classes(classes: DataFrame, threshold: float, blocks: int, part: int) -> DataFrame:
    """``cls, root, links``: rows of links found, by group; links count copies."""
    budget = 2 - 2 * threshold

    def into_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for width, rows in batch.groupby(batch["vector"].map(len)):
                vectors = np.stack(rows["vector"].to_numpy()).astype(float)
                vectors /= np.abs(vectors).max(axis=1, keepdims=True)  # no overflow in squares
                vectors = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ rotation(width)
                for b, (lo, hi) in enumerate(block_ends(width, blocks)):
                    radius = block_radius(budget * (hi - lo) / width)
                    at = vectors[:, [lo, min(lo + 1, hi - 1)]] / (2 * radius)
                    cell = np.floor(at)
                    reach = radius / (2 * radius)
                    for dx, dy in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1)):
                        into = np.ones(len(rows), dtype=bool)
                        for axis, step in enumerate((dx, dy)):
                            if step:
                                edge = cell[:, axis] + (step > 0)
                                into &= np.abs(at[:, axis] - edge) <= reach
                        if into.any():
                            yield pd.DataFrame({
                                "label": rows["label"].to_numpy()[into], "width": width, "block": b,
                                "x": (cell[into, 0] + dx).astype("int64"), "y": (cell[into, 1] + dy).astype("int64"),
                                "guest": bool(dx or dy), "cls": rows["cls"].to_numpy()[into], "copies": rows["copies"].to_numpy()[into],
                                "vector": list(vectors[into]),
                            })

    kind = classes.schema["label"].dataType.simpleString()
    cell = ["label", "width", "block", "x", "y"]
    placed = staged(classes.select("label", "cls", "copies", "vector").mapInPandas(
        into_cells, f"label {kind}, width int, block int, x bigint, y bigint, guest boolean, cls bigint, copies bigint, vector array<double>"
    ), "vector-cells")
    # a cell whose vectors are all guests has nothing to compare
    sizes = placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"), F.bool_and("guest").alias("_guests")).where("_n > 1 AND NOT _guests")
    sizes = staged(sizes.select(*cell, F.ceil(F.col("_n") / part).cast("int").alias("parts")), "vector-cell-sizes")
    own = F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")
    groups = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(j, own) * F.col("parts") + F.greatest(j, own))
    dealt = placed.join(sizes, cell).select(
        *cell, "guest", "cls", "copies", "vector", own.alias("part"), "parts", F.explode(groups).alias("pair")
    )

    def join(group: pd.DataFrame) -> pd.DataFrame:
        return join_cell(group, budget, threshold, blocks)

    return dealt.groupBy(*cell, "pair").applyInPandas(join, "cls bigint, root bigint, links bigint")


def join_cell(group: pd.DataFrame, budget: float, threshold: float, blocks: int) -> pd.DataFrame:
    """Links in one cell (or a pair of its parts), found in this block and in no earlier one."""
    width, block, pair, parts = (int(group[c].iat[0]) for c in ("width", "block", "pair", "parts"))
    vectors = np.stack(group["vector"].to_numpy())
    order = np.argsort(vectors[:, block_ends(width, blocks)[block][0]], kind="stable")
    vectors, guest = vectors[order], group["guest"].to_numpy()[order]
    side, cls, copies = (group[c].to_numpy()[order] for c in ("part", "cls", "copies"))
    ends = block_ends(width, blocks)
    shares = np.array([budget * (hi - lo) / width for lo, hi in ends]) + SLACK
    lo, hi = ends[block]
    mine, first = vectors[:, lo:hi], vectors[:, lo]
    squares = (mine**2).sum(axis=1)
    across = pair // parts != pair % parts
    a_found, b_found, n = [], [], 0
    links = np.zeros(len(cls), dtype=np.int64)
    reach = block_radius(budget * (hi - lo) / width)
    for start in range(0, len(cls), 256):
        end = min(start + 256, len(cls))
        stop = int(np.searchsorted(first, first[end - 1] + reach, side="right"))
        apart = squares[start:end, None] + squares[None, start:stop] - 2 * mine[start:end] @ mine[start:stop].T
        x, y = np.nonzero(apart <= shares[block] + SLACK)
        x, y = x + start, y + start
        wanted = (x < y) & ~(guest[x] & guest[y])
        if across:
            wanted &= side[x] != side[y]
        x, y = x[wanted], y[wanted]
        for i in range(0, len(x), 20_000):
            u, v = x[i: i + 20_000], y[i: i + 20_000]
            squared = (vectors[u] - vectors[v]) ** 2
            within = np.stack([squared[:, s:e].sum(axis=1) for s, e in ends], axis=1) <= shares
            here = within[:, block] & ~within[:, :block].any(axis=1)
            u, v = u[here], v[here]
            linked = np.einsum("ij,ij->i", vectors[u], vectors[v]) >= threshold
            u, v = u[linked], v[linked]
            np.add.at(links, u, copies[v])
            np.add.at(links, v, copies[u])
            a_found.append(cls[u])
            b_found.append(cls[v])
            n += len(u)
            if n > 500_000:
                a, b = spanning(np.concatenate(a_found), np.concatenate(b_found))
                a_found, b_found, n = [a], [b], 0
    if not a_found:
        return pd.DataFrame({"cls": [], "root": [], "links": []}, dtype="int64")
    node, root = spanning(np.concatenate(a_found), np.concatenate(b_found))
    roots = dict(zip(node.tolist(), root.tolist()))
    has = links > 0
    return pd.DataFrame({"cls": cls[has], "root": [roots.get(c, c) for c in cls[has].tolist()], "links": links[has]})
