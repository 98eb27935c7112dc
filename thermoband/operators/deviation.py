"""Signed distance of a value from a band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermoband.operators.band import attach_band


def deviation(x: Column | str, q1: Column | str, q3: Column | str, boundary: str = "reference") -> Column:
    """0 inside the band, below it `x - q1`, above it `x - q3`; NULL if anything is missing.

    With `boundary="reference"` a value exactly on the lower edge counts as not
    inside and takes the distance to the upper edge; `"closed"` gives 0 there.
    """
    x, q1, q3 = (F.col(c) if isinstance(c, str) else c for c in (x, q1, q3))
    if boundary == "closed":
        inside = (x >= q1) & (x <= q3)
    elif boundary == "reference":
        inside = F.signum(x - q1) * F.signum(x - q3) == -1
    else:
        raise ValueError(f"unknown boundary rule {boundary!r}")
    known = x.isNotNull() & q1.isNotNull() & q3.isNotNull()
    return F.when(~known, F.lit(None).cast("double")).when(inside, F.lit(0.0)).when(
        x < q1, x - q1
    ).otherwise(x - q3)


def with_deviation(
    df: DataFrame, band: DataFrame, key: str, value: str, name: str, boundary: str = "reference"
) -> DataFrame:
    """Add the deviation of `value` from the band of its group as column `name`."""
    joined = attach_band(df, band, key)
    return joined.withColumn(name, deviation(value, "tb_q1", "tb_q3", boundary)).drop(
        "tb_med", "tb_q1", "tb_q3"
    )
