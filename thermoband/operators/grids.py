"""Prediction grids built from the ranges and levels of a table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermoband.session import durable

#: Grid rows that a task makes, about; more of them, up to MOST_ROWS, if there were more than MANY_TASKS otherwise.
TASK_ROWS, MOST_ROWS = 200_000, 2_000_000
MANY_TASKS = 256
#: Columns that follow from a value of an axis, by name.
Terms = Callable[[Column], dict[str, Column]]


def evenly_spaced(lo: Column, hi: Column, n: int) -> Column:
    """Array of `n` points from `lo` to `hi`, both included."""
    step = (hi - lo) / F.lit(float(n - 1))
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == n - 1, hi).otherwise(lo + i * step)
    )


def _known(value: Column, known: Column, message: str) -> Column:
    """The value; one that isn't known stops the job instead of going missing. NULL stays NULL."""
    text = F.concat(F.lit(f"{message}: "), value.cast("string"))
    return F.when(value.isNull() | known, value).otherwise(F.raise_error(text))


def _axis(column: str, n: int | None) -> Column:
    """All days of year that occur, or `n` points over the range of the column."""
    if n is not None:
        x = F.col(column).cast("double")
        return evenly_spaced(F.min(x), F.max(x), n)
    day = _known(F.col(column), F.col(column).between(1, 366), f"{column} outside 1..366")
    return F.transform(F.array_sort(F.collect_set(day)), lambda d: d.cast("double"))


def group_grid(
    df: DataFrame, levels: Mapping[str, Sequence[str]], hours: int, days: int | None
) -> DataFrame:
    """Grid over the occurring factor levels, days and hours.

    One aggregate finds the axes: at most 366 days and the declared levels. The
    grid unfolds from that one row.
    """
    axes = [
        F.array_sort(F.collect_set(_known(F.col(name), F.col(name).isin(list(known)), f"unknown level of {name}"))).alias(name)
        for name, known in levels.items()
    ]
    one = df.agg(*axes, _axis("day", days).alias("day"), _axis("hour", hours).alias("hour"))
    for name in [*levels, "day", "hour"]:
        one = one.withColumn(name, F.explode(name))
    return one


def grid_tasks(rows: int) -> int:
    """Tasks that make a grid of so many rows."""
    return max(1, -(-rows // MOST_ROWS), min(-(-rows // TASK_ROWS), MANY_TASKS))


def series_grid(
    df: DataFrame, dims: DataFrame, hours: int, days: int | None,
    day_terms: Terms | None = None, hour_terms: Terms | None = None, per_day: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Days and hours of the table for every row of `dims` (one row per series).

    The rows of `dims` are few and the grid is large, so they are written, dealt
    over as many tasks as the grid needs, and unfolded there (days first, and
    dealt then, where a single series makes more rows than a task).
    `day_terms` and `hour_terms` give further columns, computed once per day and
    hour of the axes; `per_day` is applied to the rows before hours unfold.
    """
    terms = {"day": day_terms or (lambda x: {}), "hour": hour_terms or (lambda x: {})}

    def points(name: str, n: int | None) -> Column:
        row = lambda x: F.struct(x.alias(name), *[c.alias(k) for k, c in terms[name](x).items()])
        return F.transform(_axis(name, n), row).alias(name)

    axes = df.agg(points("day", days), points("hour", hours)).first()
    if not axes["day"]:
        axes = {"day": [], "hour": []}
    dims = durable(dims)
    per_series = len(axes["day"]) * len(axes["hour"])
    tasks = grid_tasks(dims.count() * per_series)

    def values(name: str) -> Column:
        names = [name, *terms[name](F.lit(0.0))]
        rows = [F.struct(*[F.lit(float(x[k])).alias(k) for k in names]) for x in axes[name]]
        return F.inline(F.array(*rows).cast(f"array<struct<{', '.join(f'{k}: double' for k in names)}>>"))

    if tasks > 1 and per_series <= TASK_ROWS:
        dims = dims.repartition(tasks)
    days_of = dims.select("*", values("day"))
    if tasks > 1 and per_series > TASK_ROWS:
        days_of = days_of.repartition(tasks)
    if per_day is not None:
        days_of = per_day(days_of)
    return days_of.select("*", values("hour"))
