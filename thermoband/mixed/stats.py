"""From readings to one sufficient statistic per series.

For a series with augmented rows a = [basis, y] in time order, everything the
model needs is S0 = sum a a', T1 = sum (a b' + b a') over neighbours a, b, and
S2 = sum a a' without the first and the last row. The basis depends on hour and
day only, so readings are first counted per (hour, day, hour before, day
before) in plain aggregates; matrices are formed from those cells, whose number
the calendar bounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thermoband.mixed.spec import PeriodicModel
from thermoband.operators.series import consecutive


def upper(size: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(size)


def unpack(packed: np.ndarray, size: int) -> np.ndarray:
    """Symmetric matrices from packed upper triangles (last axis)."""
    i, j = upper(size)
    out = np.empty((*packed.shape[:-1], size, size))
    out[..., i, j] = packed
    out[..., j, i] = packed
    return out


# Series whose matrices a task holds unpacked at a time.
SERIES = 500


def class_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    """(class, rows) of at most SERIES series."""
    for pdf in batches:
        for cls, block in pdf.groupby("cls"):
            for at in range(0, len(block), SERIES):
                yield int(cls), block.iloc[at : at + SERIES]


def _required(column: str, dtype: str):
    return F.coalesce(
        F.col(column).cast(dtype), F.raise_error(F.lit(f"missing {column} in model input")).cast(dtype)
    )


def neighbour_cells(
    df: DataFrame, model: PeriodicModel, series: str, response: str, ts: str, order: Sequence[str]
) -> DataFrame:
    """Counts and sums of neighbouring readings per series and pair of cells."""
    keep = df.select(
        series, *dict.fromkeys([ts, *order]),
        model.class_column().alias("cls"),
        _required("hour", "double").alias("hour"),
        _required("day", "double").alias("day"),
        _required(response, "double").alias("y"),
    )
    pairs = consecutive(keep, series, ts, order, ["cls", "hour", "day", "y"])
    y, p = F.col("y"), F.col("prev.y")
    return pairs.groupBy(
        series, "cls", "hour", "day",
        F.col("prev.hour").alias("prev_hour"), F.col("prev.day").alias("prev_day"), "is_last",
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(y).alias("sy"),
        F.sum(y * y).alias("syy"),
        F.sum(p).alias("sp"),
        F.sum(y * p).alias("syp"),
    )


def _fold(model: PeriodicModel, series: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    q = model.basis_size
    i, j = upper(q + 1)

    def outer_sums(pdf: pd.DataFrame, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Readings and packed S0, T1, S2 of each run of cells that begins at `starts`: one matrix product per run."""
        n, sy, syy = (pdf[c].to_numpy(float) for c in ("n", "sy", "syy"))
        sp, syp = (pdf[c].fillna(0.0).to_numpy(float) for c in ("sp", "syp"))
        first = pdf["prev_hour"].isna().to_numpy()
        inside = np.where(first | pdf["is_last"].to_numpy(bool), 0.0, 1.0)
        u = model.basis_rows(pdf["hour"].to_numpy(), pdf["day"].to_numpy())
        v = model.basis_rows(pdf["prev_hour"].fillna(0.0).to_numpy(), pdf["prev_day"].fillna(0.0).to_numpy())
        v[first] = 0.0  # nothing before the first reading
        right = np.concatenate(
            [u * n[:, None], sy[:, None], v * n[:, None], sp[:, None], u * (n * inside)[:, None], (sy * inside)[:, None]], axis=1
        )
        ends = np.r_[starts[1:], len(pdf)]
        own, both, inner = np.split(np.stack([u[a:b].T @ right[a:b] for a, b in zip(starts, ends)]), 3, axis=2)
        both[:, :, :q] += both[:, :, :q].transpose(0, 2, 1)
        both[:, :, q] += np.add.reduceat(v * sy[:, None], starts, axis=0)

        def packed(part: np.ndarray, last: np.ndarray) -> np.ndarray:
            out = np.empty((len(starts), len(i)))
            out[:, i < q] = part[:, i[i < q], j[i < q]]
            out[:, i == q] = np.add.reduceat(last, starts)[:, None]
            return out

        return np.add.reduceat(n, starts), packed(own, syy), packed(both, 2.0 * syp), packed(inner, syy * inside)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_key, open_cls, open_sums = None, None, None

        def closed(keys, classes, sums) -> pd.DataFrame:
            n, s0, t1, s2 = sums
            return pd.DataFrame(
                {
                    series: keys, "cls": classes, "n": n.astype("int64"),
                    "s0": list(s0), "t1": list(t1), "s2": list(s2),
                }
            )

        for pdf in batches:
            if not len(pdf):
                continue
            keys, classes = pdf[series].to_numpy(), pdf["cls"].to_numpy()
            same = keys[1:] == keys[:-1]
            if (classes[1:][same] != classes[:-1][same]).any() or (
                open_key is not None and keys[0] == open_key and classes[0] != open_cls
            ):
                raise ValueError("a factor changes inside a series")
            starts = np.flatnonzero(np.r_[True, ~same])
            sums = outer_sums(pdf, starts)
            keys, classes = keys[starts], classes[starts]
            if open_key is not None:
                if keys[0] == open_key:
                    for total, head in zip(sums, open_sums):
                        total[0] += head[0]
                else:
                    yield closed([open_key], [open_cls], open_sums)
            if len(keys) > 1:
                yield closed(keys[:-1], classes[:-1], [s[:-1] for s in sums])
            open_key, open_cls, open_sums = keys[-1], classes[-1], [s[-1:].copy() for s in sums]
        if open_key is not None:
            yield closed([open_key], [open_cls], open_sums)

    return fold


def series_statistics(
    df: DataFrame, model: PeriodicModel, series: str, response: str, ts: str, order: Sequence[str]
) -> DataFrame:
    """One row per series: class, number of readings, packed S0, T1, S2."""
    cells = neighbour_cells(df, model, series, response, ts, order)
    schema = T.StructType(
        [
            T.StructField(series, df.schema[series].dataType),
            T.StructField("cls", T.IntegerType()),
            T.StructField("n", T.LongType()),
            *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("s0", "t1", "s2")],
        ]
    )
    # Without a number, adaptive execution sizes the partitions by the data. Every later
    # pass runs one Python task per partition, so many near-empty ones would cost most.
    return (
        cells.repartition(series).sortWithinPartitions(series).mapInPandas(_fold(model, series), schema)
    )


def long_statistics(stats: DataFrame, model: PeriodicModel, series: str) -> DataFrame:
    """The statistics as rows (series, i, j, s0, s1, s2), 1-based, upper triangle."""
    i, j = upper(model.basis_size + 1)
    at = F.array(*[F.struct(F.lit(int(a) + 1).alias("i"), F.lit(int(b) + 1).alias("j")) for a, b in zip(i, j)])
    zipped = F.arrays_zip(at.alias("at"), F.col("s0"), F.col("t1"), F.col("s2"))
    return stats.select(series, F.explode(zipped).alias("e")).select(
        series,
        F.col("e.at.i").alias("i"), F.col("e.at.j").alias("j"),
        F.col("e.s0").alias("s0"), F.col("e.t1").alias("s1"), F.col("e.s2").alias("s2"),
    )
