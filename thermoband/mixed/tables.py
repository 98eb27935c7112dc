"""Marginal means, contrasts and sequential tests of a fitted model.

Each table has a fixed number of rows set by the model, so it is made from the
fitted coefficients directly; only the basis means need a pass over the data.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import product
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermoband.functions.categories import interval_text
from thermoband.mixed.fit import FittedModel
from thermoband.mixed.special import f_tail, t_quantile

# Term labels of the two published tests, in term order.
ENV_TERMS = (
    "Location", "Exposure", "Hour", "Day", "Location:Exposure", "Location:Hour", "Exposure:Hour",
    "Location:Day", "Exposure:Day", "Hour:Day", "Location:Exposure:Hour", "Location:Exposure:Day",
    "Location:Hour:Day", "Exposure:Hour:Day", "Location:Exposure:Hour:Day",
)
BODY_TERMS = ("Group", "Hour", "Day", "Group:Hour", "Group:Day", "Hour:Day", "Group:Hour:Day")


def basis_means(df: DataFrame, fitted: FittedModel) -> np.ndarray:
    """Basis part of the reference point: every hour and day column at its data mean."""
    model = fitted.model
    hour, day = model.hour_columns(), model.day_columns()
    row = df.agg(
        *[F.avg(c).alias(f"h{i}") for i, c in enumerate(hour)],
        *[F.avg(c).alias(f"d{i}") for i, c in enumerate(day)],
    ).first()
    h = np.array([row[f"h{i}"] for i in range(len(hour))])
    d = np.array([row[f"d{i}"] for i in range(len(day))])
    return np.outer(h, d).ravel()


def mean_weights(fitted: FittedModel, basis: np.ndarray, at: Mapping[str, str]) -> np.ndarray:
    """Weights on the coefficients for the mean at some factor levels, others averaged evenly."""
    model = fitted.model
    free = [levels if name not in at else (at[name],) for name, levels in model.factors]
    codes = np.mean([model.class_vector(lv) for lv in product(*free)], axis=0)
    return np.kron(codes, basis)[model.positions()]


def denominator_df(fitted: FittedModel) -> dict[str, int]:
    """Inner-outer degrees of freedom of each term (constant or varying inside a series)."""
    terms = fitted.model.terms()
    outer = sum(len(t.columns) for t in terms if not t.varies_within_series and t.name != "(Intercept)")
    inner = sum(len(t.columns) for t in terms if t.varies_within_series)
    between = fitted.n_series - 1 - outer
    within = fitted.n_rows - fitted.n_series - inner
    return {
        t.name: within if t.varies_within_series or t.name == "(Intercept)" else between for t in terms
    }


def _critical(fitted: FittedModel, weights: np.ndarray, df: str, level: float) -> float:
    p = 1 - (1 - level) / 2
    if df == "normal":
        return NormalDist().inv_cdf(p)
    if df != "containment":
        raise ValueError(f"unknown df rule {df!r}")
    known = denominator_df(fitted)
    owners = [known[t.name] for t in fitted.model.terms() for _ in t.columns]
    return t_quantile(p, min(d for d, w in zip(owners, weights) if abs(w) > 1e-8))


def estimate_rows(
    fitted: FittedModel, wanted: Sequence[tuple[str, np.ndarray]], df: str = "containment", level: float = 0.95
) -> list[tuple[str, float, float, float, float]]:
    """(label, estimate, se, lower, upper) of linear functions of the coefficients."""
    rows = []
    for label, weights in wanted:
        est = float(weights @ fitted.beta)
        se = math.sqrt(max(float(weights @ fitted.cov @ weights), 0.0))
        half = _critical(fitted, weights, df, level) * se
        rows.append((label, est, se, est - half, est + half))
    return rows


def means_and_contrasts(
    fitted: FittedModel, df: DataFrame, cells: Sequence[str], contrasts: Sequence[str], rule: str = "containment"
) -> list[tuple[str, float, float, float, float]]:
    """Marginal means over the `cells` factors, then first-minus-second of each contrast factor."""
    basis = basis_means(df, fitted)
    levels = dict(fitted.model.factors)
    wanted = []
    # The first factor changes fastest, as in an expanded grid of levels.
    for combo in product(*[levels[c] for c in reversed(cells)]):
        at = dict(zip(reversed(cells), combo))
        wanted.append((", ".join(at[c] for c in cells), mean_weights(fitted, basis, at)))
    for name in contrasts:
        first, second = levels[name]
        diff = mean_weights(fitted, basis, {name: first}) - mean_weights(fitted, basis, {name: second})
        wanted.append((f"{first} - {second}", diff))
    return estimate_rows(fitted, wanted, rule)


def means_table(spark: SparkSession, rows: Sequence[tuple[str, float, float, float, float]]) -> DataFrame:
    """Marginal means as a table, with the limits also as text."""
    out = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows, start=1)],
        "ord int, group string, estimate double, se double, lower double, upper double",
    )
    return out.withColumn("ci", interval_text("lower", "upper"))


def sequential_tests(fitted: FittedModel, labels: Sequence[str]) -> list[tuple[int, str, int, int, float, float]]:
    """Wald F of each term after the terms before it; the intercept is left out."""
    inv = np.linalg.inv(_scaled(fitted.cov)[0])
    chol = np.linalg.cholesky(0.5 * (inv + inv.T))
    z = chol.T @ (fitted.beta / _scaled(fitted.cov)[1])
    den = denominator_df(fitted)
    rows, start = [], 0
    names = iter(labels)
    for term in fitted.model.terms():
        size = len(term.columns)
        block, start = z[start:start + size], start + size
        if term.name == "(Intercept)":
            continue
        f = float(block @ block) / size
        rows.append((len(rows) + 1, next(names), size, den[term.name], f, f_tail(f, size, den[term.name])))
    return rows


def _scaled(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.sqrt(np.diag(cov))
    return cov / d[:, None] / d[None, :], d


def tests_table(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame(rows, "ord int, term string, num_df int, den_df int, f double, p double")
