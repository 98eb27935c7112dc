"""Grouped means, day-part series and summaries, contrast tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermoband.functions import clock, strict
from thermoband.functions.categories import TRANSITION, daypart3


def hourly_mean(
    df: DataFrame, keys: Sequence[str], value: str, carry: Sequence[str] = (), ts: str = "datetime"
) -> DataFrame:
    """Mean by group, date and hour. `carry` columns are constant in a group and kept."""
    return (
        df.withColumn("date", clock.calendar_date(ts))
        .groupBy(*keys, "date", "hour", *carry)
        .agg(strict.mean(value).alias(value))
    )


def daily_parts(df: DataFrame, keys: Sequence[str], value: str, ts: str = "datetime") -> DataFrame:
    """Mean by group, ecological date and day-part, without the transitions.

    The day-part comes from the clock hour itself, only the date is shifted.
    """
    return (
        df.withColumns({"daytime": daypart3("hour"), "date": clock.ecological_date(ts)})
        .filter(F.col("daytime") != TRANSITION)
        .groupBy(*keys, "date", "daytime")
        .agg(strict.mean(value).alias(value))
    )


def part_summary(
    df: DataFrame, keys: Sequence[str], value: str, k: float, ts: str = "datetime"
) -> DataFrame:
    """Mean and standard error over dates of the day-part means, with `k`-fold error bars."""
    return (
        daily_parts(df, keys, value, ts)
        .groupBy(*keys, "daytime")
        .agg(
            strict.mean(value).alias("avg"),
            strict.se(value).alias("se"),
            F.count(F.lit(1)).alias("n"),
        )
        .withColumns(
            {"lo": F.col("avg") - F.lit(float(k)) * F.col("se"), "hi": F.col("avg") + F.lit(float(k)) * F.col("se")}
        )
    )


def cell_mean(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Pooled mean over all rows of a cell."""
    return df.groupBy(*keys).agg(strict.mean(value).alias(value))


def widen(df: DataFrame, ids: Sequence[str], column: str, levels: Sequence[str], value: str) -> DataFrame:
    """One column per level. The levels are named, so no job has to find them."""
    return df.groupBy(*ids).pivot(column, list(levels)).agg(F.first(value))


def contrast(
    df: DataFrame, keys: Sequence[str], column: str, levels: tuple[str, str], value: str,
    within: Sequence[str] = (), ts: str = "datetime",
) -> DataFrame:
    """Day/night table: two levels of `column` side by side, and first minus second.

    `keys` are the cells of the daily means, `within` the rows of the table.
    """
    daily = daily_parts(df, keys, value, ts)
    cells = cell_mean(daily, [*within, column, "daytime"], value)
    wide = widen(cells, [*within, "daytime"], column, levels, value)
    first, second = levels
    return wide.withColumn("diff", F.col(f"`{first}`") - F.col(f"`{second}`"))
