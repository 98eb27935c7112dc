"""Merkle manifest of a dataset, its upper proofs found by butterfly exchange.

Every tree (here one per language, and one over their roots) has FANOUT
children to a node, the last run fewer. Its leaves, in order, are cut into
aligned partitions of FANOUT ** LEVELS. A partition hashes its own subtree.
Then, round by round, the partitions of an aligned group swap the roots they
have reached: in round r partner blocks hold FANOUT ** r partitions each, and
partition p takes the root of every other block of its group from the
partition that stands in p's own place there. All partitions below a node hash
that node, each for itself, so after the last round each has the root and the
whole upper part of its leaves' proofs; nothing is passed down again. A block
at the end may be short; its partitions then serve several places.

A round is one shuffle of a row per partition and partner. A task never holds
more than one partition of leaves and one path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermoband.session import broadcast_if_small, durable

FANOUT = 8
#: Levels that a partition hashes by itself: 4,096 leaves.
LEVELS = 4
#: Leaves in one range of the sorted layout.
RANGE_ROWS = 500_000
STEPS = "array<struct<left: string, right: string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(value: Column) -> Column:
    """A value before hashing: `-` if null, else its UTF-8 byte count, `:` and itself."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """The digest of a record's values, in lowercase hex."""
    return F.sha2(F.concat(*map(encoded, values)), 256)


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and the steps of its proof give."""
    return F.aggregate(steps, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def siblings(steps: Column) -> Column:
    """All sibling digests of a proof, level by level, left to right."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "")


def _levels(leaves: list[str], fanout: int, levels: int, alone: bool) -> list[list[str]]:
    """The nodes of a partition's subtree from its leaves up. A partition that is the whole tree stops at one node,
    any other goes up all its levels."""
    nodes = [leaves]
    while len(nodes) <= levels and (len(nodes[-1]) > 1 or not alone):
        below = nodes[-1]
        nodes.append([digest("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return nodes


def _positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` with `position` (from 0, in `order` inside each `tree`) and the tree's number of rows, `n`.

    Sorted ranges are numbered as they lie, and each is shifted by the sizes of the ranges before it, so a tree that
    holds most rows is cut by position.
    """
    ranges = max(1, -(-rows.count() // RANGE_ROWS))
    cols = ["tree", *order, "_tie"]
    laid = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(ranges, *cols).sortWithinPartitions(*cols)
    laid = durable(laid.drop("_tie").withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    parts = laid.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    within = "PARTITION BY tree ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND"
    parts = parts.select(
        "tree",
        "_part",
        (F.expr(f"coalesce(sum(_n) OVER ({within} 1 PRECEDING), 0)") - F.col("_first")).alias("_shift"),
        F.expr("sum(_n) OVER (PARTITION BY tree)").alias("n"),
    )
    return laid.join(broadcast_if_small(durable(parts)), ["tree", "_part"]).withColumn("position", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def _tops(rows: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(tree, tile, n_tiles, top): the root of each partition's subtree."""

    def run(table: pa.Table) -> pa.Table:
        some = table.sort_by("position")
        alone = some["n_tiles"][0].as_py() == 1
        top = _levels(some["leaf"].to_pylist(), fanout, levels, alone)[-1][0]
        return table.select(["tree", "tile", "n_tiles"]).slice(0, 1).append_column("top", pa.array([top]))

    slim = rows.select("tree", "tile", "n_tiles", "position", "leaf")
    return slim.groupBy("tree", "tile").applyInArrow(run, "tree string, tile bigint, n_tiles bigint, top string")


def _exchanged(tiles: DataFrame, fanout: int) -> DataFrame:
    """(tree, tile, n_tiles, top, steps): each partition with its tree's root and its path to it."""
    state = durable(tiles.withColumn("steps", F.array().cast(STEPS)))
    most, span = state.agg(F.max("n_tiles")).first()[0] or 0, 1
    while span < most:
        block, place = F.expr(f"tile div {span}"), F.col("tile") % span
        first = block - block % fanout

        def size(of: Column) -> Column:
            return F.least(F.lit(span), F.col("n_tiles") - of * span)

        # What a partition has reached goes to itself and to its own place in every other block of its group; the
        # partitions of a short block serve all places that are theirs modulo its size.
        others = F.sequence(first, F.least(first + fanout - 1, F.expr(f"(n_tiles - 1) div {span}")))
        places = (
            F.when(F.col("other") == block, F.array(place))
            .when(place < size(F.col("other")), F.sequence(place, size(F.col("other")) - 1, size(block)))
            .otherwise(F.array().cast("array<bigint>"))
        )
        sent = state.withColumn("other", F.explode(others)).select(
            "tree",
            "n_tiles",
            F.explode(places).alias("place"),
            "other",
            F.struct(block.alias("block"), "top").alias("root"),
            F.when(F.col("other") == block, F.col("steps")).alias("steps"),
        )
        got = (
            sent.groupBy("tree", "n_tiles", (F.col("other") * span + F.col("place")).alias("tile"))
            .agg(F.array_sort(F.collect_list("root")).alias("run"), F.max("steps").alias("steps"))
        )

        def joined(keep) -> Column:
            return F.array_join(F.transform(F.filter("run", keep), lambda x: x["top"]), "")

        step = F.struct(joined(lambda x: x["block"] < block).alias("left"), joined(lambda x: x["block"] > block).alias("right"))
        open_ = F.col("n_tiles") > span
        state = got.select(
            "tree",
            "tile",
            "n_tiles",
            F.when(open_, F.sha2(joined(lambda x: F.lit(True)), 256)).otherwise(F.col("run")[0]["top"]).alias("top"),
            F.when(open_, F.concat("steps", F.array(step))).otherwise(F.col("steps")).alias("steps"),
        )
        span *= fanout
    return durable(state)


def _proved(rows: DataFrame, tiles: DataFrame, kept: list[str], told: list[str], fanout: int, levels: int) -> DataFrame:
    """The columns `kept` of `rows` and `told` of their partition, and the whole path of each leaf, `steps`."""

    def pairs(left: list[str], right: list[str]) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"])

    def run(table: pa.Table, tile: pa.Table) -> pa.Table:
        some = table.sort_by("position")
        leaves, upper = some["leaf"].to_pylist(), tile["steps"][0].as_py()
        below = _levels(leaves, fanout, levels, tile["n_tiles"][0].as_py() == 1)[:-1]
        left, right = [], []
        for i in range(len(leaves)):
            for nodes in below:
                i, at = i // fanout, i
                run, at = nodes[i * fanout : (i + 1) * fanout], at % fanout
                left.append("".join(run[:at]))
                right.append("".join(run[at + 1 :]))
            left += [s["left"] for s in upper]
            right += [s["right"] for s in upper]
        ends = pa.array(range(0, len(left) + 1, len(below) + len(upper)) if left else [0] * (len(leaves) + 1), pa.int32())
        steps = pa.ListArray.from_arrays(ends, pairs(left, right))
        columns = [some[c] for c in kept] + [pa.array(tile[c].to_pylist() * len(leaves), pa.string()) for c in told]
        return pa.Table.from_arrays([*columns, steps], [*kept, *told, "steps"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in kept), *(f"`{c}` string" for c in told), f"steps {STEPS}"])
    slim = rows.select("tree", "tile", "position", "leaf", *[c for c in kept if c != "leaf"])
    tiles = tiles.select("tree", "tile", "n_tiles", "steps", *told)
    return slim.groupBy("tree", "tile").cogroup(tiles.groupBy("tree", "tile")).applyInArrow(run, schema)


def _tiled(rows: DataFrame, order: list[str], fanout: int, levels: int) -> DataFrame:
    size = fanout**levels
    placed = _positions(rows, order)
    return placed.withColumns({"tile": F.expr(f"position div {size}"), "n_tiles": F.expr(f"(n - 1) div {size} + 1")})


def manifest(rows: DataFrame, group: str, order: str, leaf: str, *kept: str, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """The columns `order`, `leaf` and `kept` of each row, with `subroot`, `root` and its proof `steps`.

    There is a tree for each value of `group`, in the order of `order` (nulls first, ties by leaf), and a tree over
    their roots in the order of the group's value (null first, by UTF-8 bytes). A tree of one leaf is that leaf. `steps`
    goes from the leaf to the root; a step holds the digests left and right of the node, joined, and both are empty
    where a run has one node. Rows equal in all three columns have the same leaf and take neighbouring places. Other
    columns are not read; an empty table gives no rows.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    order_, leaf_ = F.col(order).alias("_order"), F.col(leaf).alias("leaf")
    leaves = durable(rows.select(tree.alias("tree"), order_, leaf_, *[F.col(c).alias(f"_kept{i}") for i, c in enumerate(kept)]))
    tiled = _tiled(leaves, ["_order", "leaf"], fanout, levels)
    tiles = _exchanged(_tops(tiled, fanout, levels), fanout)
    roots = tiles.where("tile = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("top").alias("leaf"))
    upper = _tiled(durable(roots), ["name"], fanout, levels)
    over = _proved(upper, _exchanged(_tops(upper, fanout, levels), fanout), ["name", "leaf"], ["top"], fanout, levels)
    over = durable(over.toDF("tree", "subroot", "root", "over"))
    whole = tiles.join(broadcast_if_small(over), "tree").withColumn("steps", F.concat("steps", "over"))
    names = ["_order", "leaf", *[f"_kept{i}" for i in range(len(kept))]]
    found = _proved(tiled, whole, names, ["subroot", "root"], fanout, levels)
    return found.toDF(order, leaf, *kept, "subroot", "root", "steps")


def document_leaf(text: Column | None = None) -> Column:
    """The leaf of a document: its id, source, language, length and text (or another `text`)."""
    fields = [F.col("doc_id").cast("bigint"), F.col("source"), F.col("lang"), F.col("n_chars").cast("bigint")]
    return leaf(*fields, F.col("text") if text is None else text)
