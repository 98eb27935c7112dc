"""Series effects and predictions, computed row by row as expressions."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thermoband.functions.fourier import dot
from thermoband.functions.special import upper_normal
from thermoband.mixed.fit import FittedModel, _stack, marginal, whitened
from thermoband.mixed.spec import PeriodicModel
from thermoband.mixed.stats import class_blocks, unpack
from thermoband.operators.grids import series_grid


def simultaneous_quantile(m: int, alpha: float = 0.05) -> float:
    """Normal quantile for `m` two-sided limits at joint level `alpha`."""
    return NormalDist().inv_cdf(1 - (alpha / m) / 2)


def joint_quantile(spark: SparkSession, m: int, alpha: float = 0.05) -> Column:
    """The same as part of a plan, computed once in it."""
    return spark.range(1).select(upper_normal(F.lit((alpha / m) / 2)).alias("z")).scalar()


def series_effects(fitted: FittedModel) -> DataFrame:
    """Predicted slopes of every series, one row per series: `series`, `b` array."""
    model, key = fitted.model, fitted.series
    q, size, slopes = model.basis_size, model.basis_size + 1, model.slope_basis
    k = len(slopes)
    levels = model.class_levels()
    means = [model.class_vector(lv) @ fitted.class_major_beta() for lv in levels]
    sds = [fitted.relative_sd[model.slope_block(lv) * k:][:k] for lv in levels]
    phi = fitted.phi

    def effects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cls, block in class_blocks(batches):
            s0, t1, s2 = (unpack(_stack(block[c]), size) for c in ("s0", "t1", "s2"))
            m, _ = whitened(s0, t1, s2, block["n"].to_numpy(), phi)
            g, *_ = marginal(m, sds[cls], slopes)
            score = g[:, slopes, q] - g[:, slopes, :q] @ means[cls]
            yield pd.DataFrame({key: block[key].to_numpy(), "cls": cls, "b": list(score * sds[cls] ** 2)})

    schema = T.StructType(
        [
            T.StructField(key, fitted.stats.schema[key].dataType),
            T.StructField("cls", T.IntegerType()),
            T.StructField("b", T.ArrayType(T.DoubleType())),
        ]
    )
    return fitted.stats.mapInPandas(effects, schema)


def long_effects(fitted: FittedModel) -> DataFrame:
    """(series, term, value): the slopes each series has of its own."""
    model = fitted.model
    k = model.slopes_per_series
    names = model.slope_names()
    per_class = F.array(
        *[
            F.array(*[F.lit(n) for n in names[model.slope_block(lv) * k:][:k]])
            for lv in model.class_levels()
        ]
    )
    zipped = F.arrays_zip(F.get(per_class, F.col("cls")).alias("term"), F.col("b").alias("value"))
    return series_effects(fitted).select(fitted.series, F.explode(zipped).alias("e")).select(
        fitted.series, F.col("e.term").alias("term"), F.col("e.value").alias("value")
    )


def _class_coefficients(fitted: FittedModel) -> list[np.ndarray]:
    """Coefficients on the basis part for each class: its factor codes folded in."""
    beta = fitted.class_major_beta()
    return [fitted.model.class_vector(lv) @ beta for lv in fitted.model.class_levels()]


def _class_roots(fitted: FittedModel) -> list[np.ndarray]:
    """For each class a matrix W with W'W the covariance of its basis coefficients."""
    model = fitted.model
    back = np.argsort(model.positions())
    shape = (model.class_size, model.basis_size) * 2
    cov = fitted.cov[np.ix_(back, back)].reshape(shape)
    roots = []
    for levels in model.class_levels():
        codes = model.class_vector(levels)
        values, vectors = np.linalg.eigh(np.einsum("i,iajb,j->ab", codes, cov, codes))
        roots.append((vectors * np.sqrt(np.maximum(values, 0.0))).T)
    return roots


def _with_basis(df: DataFrame, model: PeriodicModel) -> tuple[DataFrame, list[str], list[str]]:
    """Hour and day terms as columns of their own, so each is computed once per row."""
    hour = {f"_h{i}": c for i, c in enumerate(model.hour_columns())}
    day = {f"_d{i}": c for i, c in enumerate(model.day_columns())}
    return df.withColumns({**hour, **day}), list(hour), list(day)


def _value(coef: Column, hour: list[str], day: list[str]) -> Column:
    """Sum over hour terms of hour term times (sum over day terms), coefficients in basis order."""
    return _weighted(hour, [_of_day(coef, h, day) for h in range(len(hour))])


def _of_day(coef: Column, h: int, day: list[str]) -> Column:
    """What a day makes of the coefficients of hour term `h`."""
    total = F.lit(0.0)
    for d, day_term in enumerate(day):
        total = total + F.get(coef, F.lit(h * len(day) + d)) * F.col(day_term)
    return total


def _weighted(hour: list[str], weights: list[Column]) -> Column:
    total = F.lit(0.0)
    for hour_term, weight in zip(hour, weights, strict=True):
        total = total + F.col(hour_term) * weight
    return total


def predict_population(grid: DataFrame, fitted: FittedModel, m: int, alpha: float = 0.05) -> DataFrame:
    """Fixed-effect prediction, its standard error and a simultaneous band.

    The factors of a row only pick its class, so the row needs the basis part
    and the coefficients and covariance factor of that class; no product over
    pairs of rows is ever formed.
    """
    crit = joint_quantile(grid.sparkSession, m, alpha)
    coefs = F.lit([c.tolist() for c in _class_coefficients(fitted)])
    roots = F.lit([r.tolist() for r in _class_roots(fitted)])
    based, hour, day = _with_basis(grid.withColumn("_cls", fitted.model.class_column()), fitted.model)
    basis = F.array(*[F.col(h) * F.col(d) for h in hour for d in day])
    rows = based.withColumns({"_u": basis, "_coef": F.get(coefs, "_cls"), "_root": F.get(roots, "_cls")})
    variance = F.aggregate("_root", F.lit(0.0), lambda s, r: s + F.pow(dot(F.col("_u"), r), F.lit(2)))
    return (
        rows.withColumns({"pred": _value(F.col("_coef"), hour, day), "se": F.sqrt(variance)})
        .drop("_cls", "_u", "_coef", "_root", *hour, *day)
        .withColumns(
            {"lo": F.col("pred") - crit * F.col("se"), "hi": F.col("pred") + crit * F.col("se")}
        )
    )


def with_effects(dims: DataFrame, fitted: FittedModel) -> DataFrame:
    """Attach to each series (one row) its own coefficients on the basis part, as `coef`.

    These are the coefficients of its class plus its predicted slopes.
    """
    model = fitted.model
    effects = series_effects(fitted)
    slopes = {b: i for i, b in enumerate(model.slope_basis)}
    of_class = F.get(F.lit([c.tolist() for c in _class_coefficients(fitted)]), F.col("cls"))
    coef = F.array(
        *[
            F.get(of_class, F.lit(b)) + (F.get("b", F.lit(slopes[b])) if b in slopes else F.lit(0.0))
            for b in range(model.basis_size)
        ]
    )
    return dims.join(effects.select(fitted.series, coef.alias("coef")), fitted.series, "left")


def predict_series(grid: DataFrame, fitted: FittedModel | PeriodicModel) -> DataFrame:
    """Prediction for single series; `grid` holds their coefficients in column `coef`."""
    model = fitted.model if isinstance(fitted, FittedModel) else fitted
    based, hour, day = _with_basis(grid, model)
    return based.withColumn("pred", _value(F.col("coef"), hour, day)).drop("coef", *hour, *day)


def predict_on_grid(
    df: DataFrame, dims: DataFrame, fitted: FittedModel | PeriodicModel, hours: int, days: int | None
) -> DataFrame:
    """`predict_series` on the `series_grid` of `dims`, whose column `coef` has the series' coefficients.

    The grid is far larger than its axes, so waves are computed once per day and
    hour of the axes, and sums over day terms once per series and day.
    """
    model = fitted.model if isinstance(fitted, FittedModel) else fitted
    of = lambda name, columns: lambda x: {f"_{name}{i}": c for i, c in enumerate(columns(x))}
    day_terms, hour_terms = of("d", model.day_columns), of("h", model.hour_columns)
    day, hour = list(day_terms(F.lit(0.0))), list(hour_terms(F.lit(0.0)))
    weights = [f"_w{h}" for h in range(len(hour))]

    def per_day(rows: DataFrame) -> DataFrame:
        return rows.withColumns({w: _of_day(F.col("coef"), h, day) for h, w in enumerate(weights)}).drop("coef", *day)

    grid = series_grid(df, dims, hours, days, day_terms, hour_terms, per_day)
    return grid.withColumn("pred", _weighted(hour, [F.col(w) for w in weights])).drop(*weights, *hour)
