"""Operators on the time order of a series.

A series may hold much of the data, so no window runs over a whole series of
readings: rows are laid out in ranges of series and time, windows run inside a
range, and then over the ranges of a series, one row each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thermoband.functions import clock
from thermoband.operators.keys import join_parts, laid_out, number_keys


def run_metadata(raw: DataFrame, keys: Sequence[str] = ("snakeid", "repro", "run"), ts: str = "datetime") -> DataFrame:
    """Count, start, end, largest and smallest sampling gap and length of each run.

    Gaps and length are in seconds; a run of one reading has no gaps, and a run
    with an unreadable time has neither times nor gaps.
    """
    keys = list(keys)
    chunk = [*keys, "_part"]
    ordered = Window.partitionBy(*chunk).orderBy(ts)
    inside = (
        laid_out(raw.select(*keys, ts), [*keys, ts])
        .withColumn("_gap", clock.seconds_between(F.lag(ts).over(ordered), F.col(ts)))
        .groupBy(*chunk)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.count(ts).alias("_timed"),
            F.min(ts).alias("_first"),
            F.max(ts).alias("_last"),
            F.max("_gap").alias("_gap_max"),
            F.min("_gap").alias("_gap_min"),
        )
    )
    along = Window.partitionBy(*keys).orderBy("_part")
    edge = clock.seconds_between(F.lag("_last").over(along), F.col("_first"))
    runs = (
        inside.withColumn("_edge", edge)
        .groupBy(*keys)
        .agg(
            F.sum("_n").alias("n_obs"),
            (F.sum("_n") == F.sum("_timed")).alias("_known"),
            F.min("_first").alias("start"),
            F.max("_last").alias("end"),
            F.greatest(F.max("_gap_max"), F.max("_edge")).alias("gap_max_s"),
            F.least(F.min("_gap_min"), F.min("_edge")).alias("gap_min_s"),
        )
    )
    timed = ["start", "end", "gap_max_s", "gap_min_s"]
    out = runs.withColumns({c: F.when(F.col("_known"), F.col(c)) for c in timed}).drop("_known")
    out = out.withColumn("duration_s", clock.seconds_between("start", "end"))
    return out.withColumns(clock.period_parts("duration_s"))


def panel_index(df: DataFrame, key: str = "id", group: str = "type", rows: str | None = None) -> DataFrame:
    """Index of each series inside its group, right-joined to the series' row counts.

    `df` holds readings, or already one row per series with its count in `rows`.
    """
    if rows is None:
        counts = df.groupBy(key, group).agg(F.count(F.lit(1)).alias("n_rows"))
    else:
        counts = df.select(key, group, F.col(rows).alias("n_rows"))
    index = number_keys(counts.select(key, group), [key], within=[group], name="newid")
    return index.join(counts, [key, group], "right").select(key, group, "newid", "n_rows")


def consecutive(
    df: DataFrame, series: str, ts: str, order: Sequence[str], payload: Sequence[str]
) -> DataFrame:
    """Each row with the payload of the row before it and whether it is the last one.

    Result: `series`, the payload, `prev` (a struct, NULL for the first row of a
    series) and `is_last`. Rows are ordered by `order`, which must start with `ts`.
    """
    own = F.struct(*[F.col(c) for c in payload])
    place = F.struct(*[F.col(c) for c in order])
    chunk = [series, "_part"]
    placed = laid_out(df.select(series, *dict.fromkeys([ts, *order, *payload])), [series, *order]).withColumn("_own", own)
    along = Window.partitionBy(series).orderBy("_part")
    parts = (
        placed.groupBy(*chunk)
        .agg(F.max_by("_own", place).alias("_end"))
        .select(
            *chunk, F.lag("_end").over(along).alias("_before"),
            F.lead(F.lit(True)).over(along).isNull().alias("_final"),
        )
    )
    inside = Window.partitionBy(*chunk).orderBy(*order)
    rows = placed.withColumns({"prev": F.lag("_own").over(inside), "_more": F.lead(F.lit(True)).over(inside)})
    return join_parts(rows, parts, chunk).select(
        series, *payload, F.coalesce("prev", "_before").alias("prev"), (F.col("_more").isNull() & F.col("_final")).alias("is_last")
    )
