"""Aggregates that are NULL as soon as one value of the group is missing.

Spark's own aggregates skip NULL; in the analyses here a missing reading makes
the summary of its group unknown. `strict=False` gives Spark's behaviour.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _guard(x: Column, agg: Column, strict: bool) -> Column:
    return F.when(F.count(F.lit(1)) == F.count(x), agg) if strict else agg


def mean(x: Column | str, strict: bool = True) -> Column:
    x = _column(x)
    return _guard(x, F.avg(x), strict)


def sd(x: Column | str, strict: bool = True) -> Column:
    """Sample standard deviation; NULL for a single row."""
    x = _column(x)
    return _guard(x, F.stddev_samp(x), strict)


def se(x: Column | str, strict: bool = True) -> Column:
    """Standard error of the mean over all rows of the group."""
    x = _column(x)
    return _guard(x, F.stddev_samp(x) / F.sqrt(F.count(F.lit(1))), strict)
