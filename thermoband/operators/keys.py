"""Range layouts, and numbering of keys without a single hot task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thermoband.session import durable


def laid_out(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """`df` in ranges of `cols`, each with its number in `_part`.

    An ordinary group lies in one or two ranges and one that holds much of the
    data is cut by position, whatever its values are. The layout is written
    out, so that everything said about the ranges refers to the same ones.
    """
    return durable(df.repartitionByRange(*cols).withColumn("_part", F.spark_partition_id()))


def earlier_parts(within: Sequence[str]):
    """Window over the ranges of a group that come before the current one."""
    return Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def join_parts(rows: DataFrame, parts: DataFrame, chunk: Sequence[str]) -> DataFrame:
    """Rows with what `parts` says about their range; keys may be NULL."""
    named = parts.withColumnsRenamed({c: f"_of_{c}" for c in chunk})
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in chunk]
    return rows.join(named, same).drop(*[f"_of_{c}" for c in chunk])


def number_keys(
    keys: DataFrame, order: Sequence[str], within: Sequence[str] = (), name: str = "id"
) -> DataFrame:
    """1-based position of each row of `keys` in `order`, inside each `within` group.

    Each range is numbered on its own, and the ranges before it are added from
    their sizes. No task sees more than one range, however many keys a group has.
    """
    cols = [*within, *order]
    placed = laid_out(keys.select(*cols), cols)
    chunk = [*within, "_part"]
    sizes = (
        placed.groupBy(*chunk)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*chunk, F.coalesce(F.sum("_n").over(earlier_parts(within)), F.lit(0)).alias("_before"))
    )
    numbered = placed.withColumn(
        "_row", F.row_number().over(Window.partitionBy(*chunk).orderBy(*order))
    )
    return join_parts(numbered, sizes, chunk).select(
        *cols, (F.col("_row") + F.col("_before")).cast("int").alias(name)
    )


def code_series(df: DataFrame, key: str, name: str = "id") -> DataFrame:
    """Dictionary of the distinct values of `key`, numbered in text order."""
    found = df.select(key).filter(F.col(key).isNotNull()).distinct()
    return number_keys(found, [key], name=name)
