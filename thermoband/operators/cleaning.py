"""From raw readings to tidy tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermoband.functions import clock
from thermoband.operators.keys import code_series

EXCLUDED_SITE = "Entrance"


#: More ranges than this are replaced by one from the first to the last.
MOST_RANGES = 20


def season_ranges(
    years: Iterable[int], first_day: int, last_day: int, known: tuple[datetime, datetime] | None = None,
    slack: timedelta = timedelta(0),
) -> list[tuple[datetime, datetime]]:
    """The seasons of some years, end excluded, `slack` wider on either side, without those outside `known` (first and last time of
    the data). More than MOST_RANGES are one range."""
    found = []
    for year in years:
        new_year = datetime(year, 1, 1)
        start, stop = new_year + timedelta(days=first_day - 1) - slack, new_year + timedelta(days=last_day) + slack
        if known is None or (start <= known[1] and stop > known[0]):
            found.append((start, stop))
    return found if len(found) <= MOST_RANGES else [(found[0][0], found[-1][1])]


def cut_season(
    df: DataFrame, first_day: int, last_day: int, ts: str = "datetime",
    years: Iterable[int] | None = None, read_at: str | None = None, known: tuple[datetime, datetime] | None = None,
) -> DataFrame:
    """Keep days of year from `first_day` to `last_day`, both included.

    A day of year cannot be pushed into a file scan. If the caller knows which
    years the data cover (`years`, or the first and last time, `known`), ranges
    of the plain time of reading are added beside it, which can. Rounding moves
    a time by half an hour at most, so a range of `read_at` (the column that
    `ts` was rounded from) is that much wider, and a time may be rounded up into
    the next year.
    """
    plain, slack = (read_at, timedelta(minutes=30)) if read_at else (ts, timedelta(0))
    kept = df.filter(clock.day_of_year(ts).between(first_day, last_day))
    if years is None and known:
        years = range(known[0].year, (known[1] + slack).year + 1)
    if years:
        ranges = F.lit(False)
        for start, stop in season_ranges(years, first_day, last_day, known, slack):
            inside = (F.col(plain) >= F.lit(start.isoformat(" ")).cast(clock.NTZ)) & (
                F.col(plain) < F.lit(stop.isoformat(" ")).cast(clock.NTZ)
            )
            ranges = ranges | inside
        kept = kept.filter(ranges)
    return kept


def exclude_series(df: DataFrame, names: Sequence[str], key: str = "original_id") -> DataFrame:
    return df.filter(~F.col(key).isin(list(names)))


def season_rows(
    raw: DataFrame, first_day: int, last_day: int, exclude: Sequence[str] = (),
    years: Iterable[int] | None = None, known: tuple[datetime, datetime] | None = None,
) -> DataFrame:
    """Body readings of the season with `day` and `hour`, still under their own names."""
    read_at = "read_at" if "read_at" in raw.columns else None
    kept = cut_season(raw, first_day, last_day, years=years, read_at=read_at, known=known)
    if exclude:
        kept = exclude_series(kept, exclude)
    return kept.withColumns(
        {"day": clock.day_of_year("datetime"), "hour": clock.hour_of_day("datetime")}
    )


def clean_body(
    raw: DataFrame, first_day: int, last_day: int, exclude: Sequence[str] = (),
    codes: DataFrame | None = None, years: Iterable[int] | None = None, known: tuple[datetime, datetime] | None = None,
) -> DataFrame:
    """The tidy body table. Codes are given before series are excluded, so gaps stay."""
    codes = code_series(raw, "original_id") if codes is None else codes
    rows = season_rows(raw, first_day, last_day, exclude, years, known)
    rows = rows.select("original_id", "type", "datetime", "day", "hour", "temp")
    return rows.join(codes, ["original_id"]).select(
        "id", "type", "datetime", "day", "hour", "temp"
    )


def clean_env(raw: DataFrame, excluded_site: str = EXCLUDED_SITE) -> DataFrame:
    """The tidy environment table; its times are not rounded."""
    return raw.filter(F.col("site") != excluded_site).withColumns(
        {"day": clock.day_of_year("datetime"), "hour": clock.hour_of_day("datetime")}
    )


def env_dimension(raw: DataFrame) -> DataFrame:
    """One row per model, all sites included."""
    return raw.select("id", "site", "location", "treatment").distinct()


def completeness(raw: DataFrame, key: str = "id", value: str = "temp") -> DataFrame:
    """Rows and missing values per series."""
    return raw.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        (F.count(F.lit(1)) - F.count(value)).alias("n_missing"),
    )


def season_bounds(raw: DataFrame, key: str = "original_id", ts: str = "datetime") -> DataFrame:
    """Latest reading of each series and its day of year."""
    return (
        raw.groupBy(key)
        .agg(F.max(ts).alias("last_datetime"))
        .withColumn("last_day", clock.day_of_year("last_datetime"))
    )


def within_dates_of(df: DataFrame, other: DataFrame, ts: str = "datetime") -> DataFrame:
    """Rows whose date lies in the date range of `other`, both ends included.

    The range stays in the plan as two scalar sub-queries on the time column.
    """
    first = other.agg(F.to_date(F.min(ts)).cast(clock.NTZ).alias("d")).scalar()
    after = other.agg(F.date_add(F.to_date(F.max(ts)), 1).cast(clock.NTZ).alias("d")).scalar()
    return df.filter((F.col(ts) >= first) & (F.col(ts) < after))
