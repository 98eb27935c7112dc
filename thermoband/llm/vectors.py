"""Near-duplicate vectors by PCA-ordered, tiled comparison.

Vectors are scaled to length 1 and turned to their principal axes, largest
first, which changes no product. Two vectors with cosine c lie sqrt(2 - 2c)
apart, on each axis at most that; so cells of that width on the first axes
hold the candidates, and only neighbouring cells of one label can hold a link.
Cells are cut into tiles of at most about TILE vectors, and tiles are compared in pairs, a
pair in one task. Within a pair of tiles products are added up over the
leading axes first; the rest of a product is at most the product of the two
lengths left (suffix norms), and pairs that cannot reach the threshold any
more stop there. What remains is decided in double precision on the vectors as
given.

Equal vectors are compared once. A pair of tiles gives the number of links of
each vector and links that join its parts, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermoband.llm.components import components
from thermoband.session import durable

THRESHOLD = 0.98
TILE = 2048
#: Axes that cells are cut on, and vectors that the axes are computed from (those with the least hashes).
AXES, SAMPLE = 2, 20_000
#: Leading axes after which pairs are stopped, as shares of all.
STOPS = (0.25, 0.5)
#: Rounding allowed for before a pair is decided exactly.
SLACK = 1e-9
ROWS = 256
#: Share of pairs still going beyond which a block is decided as a whole.
DENSE = 0.02


def principal_axes(vectors: DataFrame, sample: int = SAMPLE) -> np.ndarray | None:
    """Axes (columns, largest spread first) of a bounded sample. They only steer the work: any rotation gives the same links."""
    rows = vectors.orderBy(F.xxhash64("rep"), "rep").select("embedding").limit(sample).collect()
    if not rows:
        return None
    size = len(rows[0][0])
    x = np.array([r[0] for r in rows if len(r[0]) == size], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    _, axes = np.linalg.eigh(x.T @ x)
    return np.ascontiguousarray(axes[:, ::-1])


def usable(rows: DataFrame) -> DataFrame:
    """Rows with a label and a vector of finite components that isn't zero."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists("embedding", lambda x: x != 0)
    return rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite & some)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, whatever their size."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def turned(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    return x @ axes if axes.shape[0] == x.shape[1] else x


def in_cells(width: float, axes: np.ndarray, cut: int):
    """(rep, label, embedding, n) to (rep, label, size, cell, n, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat = np.asarray(lists.flatten(), float)
            lengths = np.asarray(lists.value_lengths())
            ends = np.cumsum(lengths)
            for size in np.unique(lengths):
                at = np.flatnonzero(lengths == size)
                x = flat[(ends[at] - size)[:, None] + np.arange(size)]
                place = np.floor(turned(scaled(x), axes)[:, :cut] / width).astype(np.int32)
                place = np.pad(place, ((0, 0), (0, cut - place.shape[1])))
                rows = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0), rows.column(1), pa.array(np.full(len(at), size, np.int32)),
                        *(pa.array(place[:, k]) for k in range(cut)), rows.column(3),
                        pa.array([v.tobytes() for v in x], pa.binary()),
                    ],
                    ["rep", "label", "size", *(f"c{k}" for k in range(cut)), "n", "vector"],
                )

    return run


def linked(a: np.ndarray, b: np.ndarray, xa: np.ndarray, xb: np.ndarray, rest: list, threshold: float) -> np.ndarray:
    """Which rows of a and b (scaled vectors; xa, xb the same in axis order) reach the threshold. `rest`: (stop, suffix norms of a, of b)."""
    total = np.zeros((len(a), len(b)))
    done = 0
    for stop, left_a, left_b in rest:
        total += xa[:, done:stop] @ xb[:, done:stop].T
        done = stop
        going = total + left_a[:, None] * left_b[None, :] >= threshold - SLACK
        if going.mean() <= DENSE:
            links = np.zeros(going.shape, bool)
            i, j = np.nonzero(going)
            links[i, j] = np.einsum("ij,ij->i", a[i], b[j]) >= threshold
            return links
    return a @ b.T >= threshold


def compare_tiles(threshold: float, axes: np.ndarray):
    """A pair of tiles (side 0 and 1, or -1: one tile with itself) to (a, null, links of a) and (a, b, null) for joining links."""

    def run(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        rep, n = table["rep"].to_numpy(), table["n"].to_numpy()
        x = scaled(np.frombuffer(b"".join(table["vector"].to_pylist())).reshape(len(rep), -1))
        y = turned(x, axes)
        own = side[0] < 0
        left = np.arange(len(rep)) if own else np.flatnonzero(side == 0)
        right = left if own else np.flatnonzero(side == 1)
        stops = [max(1, int(s * x.shape[1])) for s in STOPS]
        norms = [np.sqrt(np.einsum("ij,ij->i", y[:, s:], y[:, s:])) for s in stops]
        count, part = np.zeros(len(rep), np.int64), np.arange(len(rep))
        joins: list[tuple[int, int]] = []
        for at in range(0, len(left), ROWS):
            some = left[at : at + ROWS]
            links = linked(x[some], x[right], y[some], y[right], [(s, m[some], m[right]) for s, m in zip(stops, norms, strict=True)], threshold)
            if own:
                links &= np.arange(len(rep))[None, :] > some[:, None]
            count[some] += links @ n[right]
            np.add.at(count, right, links.T @ n[some])
            for k in np.flatnonzero(links.any(axis=1)):
                others = right[links[k]]
                parts, first = np.unique(part[others], return_index=True)
                new = parts != part[some[k]]
                if new.any():
                    joins += [(some[k], others[f]) for f in first[new]]
                    part[np.isin(part, parts)] = part[some[k]]
        has = np.flatnonzero(count)
        a, b = np.array(joins, np.int64).reshape(-1, 2).T
        return pa.table({
            "a": pa.array(np.concatenate([rep[has], rep[a]])),
            "b": pa.array([None] * len(has) + rep[b].tolist(), pa.int64()),
            "links": pa.array(count[has].tolist() + [None] * len(a), pa.int64()),
        })

    return run


def tile_pairs(cells: DataFrame, tile: int, cut: int) -> DataFrame:
    """Every vector once for each pair of tiles it takes part in: the pair (label, size, cell, turn, i, j), side and the vector."""
    group = ["label", "size", *(f"c{k}" for k in range(cut))]
    tiles = durable(cells.groupBy(*group).agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")))
    # the cell itself and the neighbours that come after it: each pair of cells once
    turns = [t for t in product((-1, 0, 1), repeat=cut) if t >= (0,) * cut]
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("turn"), *[F.lit(x).alias(f"d{k}") for k, x in enumerate(t)]) for i, t in enumerate(turns)]))
    to = tiles.select(*group, "tiles", steps.alias("s")).select(
        "label", "size", *[F.col(f"c{k}").alias(f"a{k}") for k in range(cut)],
        *[(F.col(f"c{k}") + F.col(f"s.d{k}")).alias(f"c{k}") for k in range(cut)], "s.turn", F.col("tiles").alias("a_tiles"),
    )
    met = to.join(tiles.withColumnRenamed("tiles", "b_tiles"), group)
    base = ["label", "size", *[F.col(f"a{k}") for k in range(cut)], "turn"]
    first = met.select(*base, *[F.col(f"a{k}").alias(f"c{k}") for k in range(cut)], F.lit(0).alias("side"), F.col("a_tiles").alias("mine"), F.col("b_tiles").alias("theirs"))
    second = met.where("turn > 0").select(*base, *[f"c{k}" for k in range(cut)], F.lit(1).alias("side"), F.col("b_tiles").alias("mine"), F.col("a_tiles").alias("theirs"))
    roles = first.union(second)
    mine, other, side = F.col("t"), F.col("o"), F.col("side")
    rows = cells.join(roles, group).withColumn("t", F.pmod(F.xxhash64("rep"), F.col("mine")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("theirs") - 1)))
    own = F.col("turn") == 0
    return rows.select(
        *base,
        F.when(own, F.least(mine, other)).when(side == 0, mine).otherwise(other).alias("i"),
        F.when(own, F.greatest(mine, other)).when(side == 0, other).otherwise(mine).alias("j"),
        F.when(own & (mine == other), -1).when(own, (mine > other).cast("int")).otherwise(side).alias("side"),
        "rep", "n", "vector",
    )


def near_duplicate_vectors(rows: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, cut: int = AXES) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of (vec_id, embedding, label).

    Vectors of one label and one length link at a cosine of `threshold` or
    more. A null label or vector, a zero vector and one with null or
    non-finite components link with nothing: they have no links and are their
    own component. Rows with equal vectors link with each other like any other;
    repeated rows each count. A null vec_id counts as a link of others, and is
    never the least of a component unless there is no other. Other columns are not
    read; an empty table gives no rows.
    """
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", "label")
    kinds = usable(rows).groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    reps = durable(kinds.withColumn("rep", F.monotonically_increasing_id()))
    axes = principal_axes(reps)
    if axes is None:
        return rows.select(
            "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
        )
    width = float(np.sqrt(2 - 2 * threshold)) * (1 + 1e-6) + 1e-6
    label = dict(rows.dtypes)["label"]
    places = ", ".join(f"c{k} int" for k in range(cut))
    cells = durable(
        reps.select("rep", "label", "embedding", "n").mapInArrow(
            in_cells(width, axes, cut), f"rep bigint, label {label}, size int, {places}, n bigint, vector binary"
        )
    )
    pair = ["label", "size", *[f"a{k}" for k in range(cut)], "turn", "i", "j"]
    found = durable(
        tile_pairs(cells, tile, cut).groupBy(*pair).applyInArrow(compare_tiles(threshold, axes), "a bigint, b bigint, links bigint")
    )
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    reached = components(found.where("b IS NOT NULL").select("a", "b"))
    named = reps.join(reached.withColumnRenamed("node", "rep"), "rep", "left").withColumn("part", F.coalesce("component", "rep"))
    least = named.groupBy("part").agg(F.min("least").alias("component_id"))
    known = named.join(least, "part").join(counts, "rep", "left").select(
        "label", "embedding", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links")
    )
    result = rows.join(known, ["label", "embedding"], "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return result.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
