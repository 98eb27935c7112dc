"""Date and time expressions on zone-less timestamps.

Nothing here passes through the session time zone: parsing, rounding and
differences are all done on TIMESTAMP_NTZ.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NTZ = "timestamp_ntz"
# Two-digit years up to this one are read as 20xx, later ones as 19xx.
YEAR_PIVOT = 68
# English names of the months; three letters stand for them too.
MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)
# Month (number or name), day and year stand in this order between slashes, hyphens, points, commas or blanks.
_MDY = r"(?i)^\s*(\d{1,2}|[a-z]{3,9})[/. ,\-]+(\d{1,2})[/. ,\-]+(\d{4}|\d{2})\s+(\d{1,2}):(\d{1,2})"
# Hours from 1 to 12 may be followed by AM or PM.
_HALF = r"\s*([ap]m)?\s*$"


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _parse(text: Column | str, pattern: str, with_seconds: bool) -> Column:
    text = _column(text)

    def found(i: int) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))

    def part(i: int) -> Column:
        return found(i).cast("int")

    names = F.create_map(*[F.lit(x) for i, name in enumerate(MONTHS, 1) for key in dict.fromkeys((name, name[:3])) for x in (key, i)])
    month = F.coalesce(found(1).try_cast("int"), F.try_element_at(names, F.lower(found(1))))
    year = part(3)
    full_year = (
        F.when(F.length(found(3)) == 4, year)
        .when(year <= YEAR_PIVOT, year + 2000)
        .otherwise(year + 1900)
    )
    second = part(6) if with_seconds else F.lit(0)
    hour, half = part(4), F.lower(found(7 if with_seconds else 6))
    of_half = F.when(hour.between(1, 12), hour % 12 + F.when(half == "pm", 12).otherwise(0))
    return F.try_make_timestamp_ntz(full_year, month, part(2), F.when(half.isNull(), hour).otherwise(of_half), part(5), second)


def parse_mdy_hms(text: Column | str) -> Column:
    """`7/1/2020 13:05:09`, `07-01-20 13:05:09`, `7.1.2020 1:05:09 PM`, `July 1, 2020 13:05:09`, `Jul 1 2020 1:05:09 pm`; anything
    else is NULL."""
    return _parse(text, _MDY + r":(\d{1,2})" + _HALF, with_seconds=True)


def parse_mdy_hm(text: Column | str) -> Column:
    """The same without seconds."""
    return _parse(text, _MDY + _HALF, with_seconds=False)


def floor_hour(ts: Column | str) -> Column:
    ts = _column(ts)
    return ts - F.make_dt_interval(
        F.lit(0), F.lit(0), F.minute(ts), F.date_part(F.lit("SECOND"), ts)
    )


def round_hour(ts: Column | str) -> Column:
    """Nearest hour, half an hour going up."""
    return floor_hour(_column(ts) + F.expr("INTERVAL 30 MINUTES"))


def day_of_year(ts: Column | str) -> Column:
    return F.dayofyear(_column(ts))


def hour_of_day(ts: Column | str) -> Column:
    return F.hour(_column(ts))


def calendar_date(ts: Column | str) -> Column:
    return F.to_date(_column(ts))


def ecological_date(ts: Column | str, shift_hours: int = 9) -> Column:
    """Date after moving the clock back, so that a night belongs to the day before it."""
    return F.to_date(_column(ts) - F.make_dt_interval(hours=F.lit(shift_hours)))


def date_of_day(day: Column | str, year: int = 2020) -> Column:
    """Calendar date of a 1-based day of year."""
    return F.date_add(F.lit(f"{year - 1}-12-31").cast("date"), _column(day).cast("int"))


def hour_minute(hour: Column | str) -> tuple[Column, Column]:
    """Whole hour and whole minute of a fractional hour."""
    hour = _column(hour)
    return F.floor(hour).cast("int"), F.floor((hour % 1) * 60).cast("int")


def timestamp_of(day: Column | str, hour: Column | str, year: int = 2020) -> Column:
    """Timestamp of a day of year and a fractional hour, to the minute."""
    h, m = hour_minute(hour)
    return date_of_day(day, year).cast(NTZ) + F.make_dt_interval(F.lit(0), h, m)


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Exact seconds, to the microsecond, as a double."""
    gap = _column(end) - _column(start)
    return gap.cast("interval second").cast("decimal(20,6)").cast("double")


def period_parts(seconds: Column | str) -> dict[str, Column]:
    """Days, hours, minutes and remaining seconds of a duration."""
    s = _column(seconds)
    whole = F.floor(s)
    return {
        "d": F.floor(whole / 86400).cast("int"),
        "h": F.floor(F.pmod(whole, F.lit(86400)) / 3600).cast("int"),
        "m": F.floor(F.pmod(whole, F.lit(3600)) / 60).cast("int"),
        "s": F.pmod(s, F.lit(60.0)),
    }
