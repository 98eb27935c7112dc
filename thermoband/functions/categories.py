"""Day-parts, recodes, display order and interval text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hour breaks of the day-parts, half open on the right.
THREE_PARTS = ((0, 5, "Night"), (5, 9, "transition"), (9, 17, "Day"), (17, 21, "transition"), (21, 24, "Night"))
TWO_PARTS = ((0, 9, "night"), (9, 17, "day"), (17, 24, "night"))
TRANSITION = "transition"

# Group codes, their display names, and the state names of the lab data.
TYPE_LABELS = {"G": "Pregnant", "N": "Non-pregnant"}
STATE_TO_TYPE = {"Pregnant": "G", "Non-Pregnant": "N"}
STATE_TO_LOCATION = {"Pregnant": "Rookery", "Non-Pregnant": "Prairie"}
LOCATIONS = ("Prairie", "Rookery")
TREATMENTS = ("Exposed", "Shaded")


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bin_hours(hour: Column | str, parts: Sequence[tuple[float, float, str]]) -> Column:
    """Label of the half-open interval that holds `hour`; NULL outside all of them."""
    hour = _column(hour)
    out = None
    for lo, hi, label in parts:
        inside = (hour >= lo) & (hour < hi)
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def daypart3(hour: Column | str) -> Column:
    return bin_hours(hour, THREE_PARTS)


def daypart2(hour: Column | str) -> Column:
    return bin_hours(hour, TWO_PARTS)


def recode(value: Column | str, mapping: Mapping[str, str]) -> Column:
    """Replace each known level by its label; other values become NULL."""
    value = _column(value)
    out = None
    for level, label in mapping.items():
        out = F.when(value == level, label) if out is None else out.when(value == level, label)
    return out


def display_order(value: Column | str, levels: Sequence[str]) -> Column:
    """1-based position of a value in a chosen level order; NULL if it is not a level."""
    value = _column(value)
    out = None
    for i, level in enumerate(levels, start=1):
        out = F.when(value == level, i) if out is None else out.when(value == level, i)
    return out


def composite(*keys: Column | str) -> Column:
    """Text form of a several-column group key."""
    return F.concat_ws(".", *[_column(k).cast("string") for k in keys])


def unite(sep: str, *cols: Column | str) -> Column:
    """Join columns to one text; a missing part is written as NA."""
    return F.concat_ws(sep, *[F.coalesce(_column(c).cast("string"), F.lit("NA")) for c in cols])


def short_number(x: Column | str, digits: int = 2) -> Column:
    """Half-even rounded number without trailing zeros."""
    rounded = F.bround(_column(x), digits)
    rounded = F.when(rounded == 0, F.lit(0.0)).otherwise(rounded)  # no minus zero
    text = F.format_string(f"%.{digits}f", rounded)
    if digits:
        text = F.regexp_replace(text, r"\.?0+$", "")
    return F.when(rounded.isNotNull(), text)


def interval_text(lo: Column | str, hi: Column | str, digits: int = 2) -> Column:
    """Confidence limits as text, in the spacing `( lo ,  hi )`."""
    lo, hi = (F.coalesce(short_number(x, digits), F.lit("NA")) for x in (lo, hi))
    return F.concat_ws(" ", F.lit("("), lo, F.lit(", "), hi, F.lit(")"))
