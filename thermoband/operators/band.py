"""Exact quantiles of large groups and the reference band of each group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thermoband.functions.categories import STATE_TO_LOCATION, STATE_TO_TYPE, recode
from thermoband.functions.strict import mean
from thermoband.operators.keys import earlier_parts, join_parts, laid_out

BAND = {"tb_med": 0.5, "tb_q1": 0.25, "tb_q3": 0.75}


def group_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float],
    count_name: str = "n_obs",
) -> DataFrame:
    """Exact quantiles (linear between order statistics) of each group.

    Readings are first counted by distinct value. The counts are laid out in
    ranges of group and value, and ranked in two steps: over the ranges of a
    group, and inside the few ranges that hold a wanted rank. So a group that
    holds much of the data never meets in one task, whatever its values. A
    missing value makes the quantiles of its group NULL.
    """
    keys = list(keys)
    cell = [*keys, "_part"]
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    counts = laid_out(
        df.select(*keys, v.alias("_v")).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n")), [*keys, "_v"]
    )

    # 0-based position of each quantile among the sorted values, and the ranks around it.
    position = {name: f"((_total - 1) * {float(p)!r}D)" for name, p in probs.items()}
    below = {name: f"floor({x})" for name, x in position.items()}
    above = {name: f"ceil({x})" for name, x in position.items()}

    # A missing value comes first in its group; such a group has no quantiles, so its ranks don't matter.
    by_group = Window.partitionBy(*keys)
    parts = (
        counts.groupBy(*cell)
        .agg(F.sum("_n").alias("_part_n"), F.sum(F.when(F.col("_v").isNotNull(), F.col("_n")).otherwise(0)).alias("_part_known"))
        .select(
            *cell, "_part_n",
            F.coalesce(F.sum("_part_n").over(earlier_parts(keys)), F.lit(0)).alias("_before"),
            F.sum("_part_n").over(by_group).alias("_total"),
            F.sum("_part_known").over(by_group).alias("_known"),
        )
    )
    holds_rank = " OR ".join(
        f"({rank} >= _before AND {rank} < _before + _part_n)" for rank in [*below.values(), *above.values()]
    )
    picked = parts.filter(holds_rank).drop("_part_n")
    inside = Window.partitionBy(*cell).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = join_parts(counts, picked, cell).withColumn(
        "_start", F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    )

    def order_stat(rank: str) -> str:
        return f"max(CASE WHEN {rank} >= _start AND {rank} < _start + _n THEN _v END)"

    found = [F.expr("first(_total) AS _total"), F.expr("first(_known) AS _known")]
    for name in probs:
        found.append(F.expr(f"{order_stat(below[name])} AS _lo_{name}"))
        found.append(F.expr(f"{order_stat(above[name])} AS _hi_{name}"))
    quantiles = [
        f"CASE WHEN _known = _total THEN _lo_{n} + (_hi_{n} - _lo_{n}) * ({x} - {below[n]}) END AS {n}"
        for n, x in position.items()
    ]
    return ranked.groupBy(*keys).agg(*found).selectExpr(*keys, *quantiles, f"_total AS {count_name}")


def lab_summary(raw: DataFrame) -> DataFrame:
    """Median, quartiles and count per animal and state."""
    return group_quantiles(raw, ["snakeid", "repro"], "tb", BAND)


def reference_band(lab: DataFrame) -> DataFrame:
    """Unweighted mean of the animals' quartiles per state, keyed for both tables."""
    prefixed = [c for c in lab.columns if c.startswith("tb_")]
    return (
        lab.groupBy("repro")
        .agg(*[mean(c).alias(c) for c in prefixed])
        .select(
            recode("repro", STATE_TO_TYPE).alias("type"),
            recode("repro", STATE_TO_LOCATION).alias("location"),
            *prefixed,
        )
    )


def attach_band(df: DataFrame, band: DataFrame, key: str) -> DataFrame:
    """Left join to the band by `type` or `location`.

    Only the band's known levels are kept, one row each, so at most two rows
    are broadcast whatever the size of the data. The other key stays out.
    """
    sides = band.filter(F.col(key).isNotNull()).select(key, "tb_med", "tb_q1", "tb_q3")
    return df.join(F.broadcast(sides), key, "left")
