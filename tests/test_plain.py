"""Sweeps as array columns, and the mixed model in columns against NumPy and dense matrices."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_mixed import ORDER, dense, frame, simulate
from thermoband.functions import linear
from thermoband.mixed import plain, predict, tables
from thermoband.mixed.fit import at_parameters, evaluate
from thermoband.mixed.spec import BODY_MODEL, ENV_MODEL, PeriodicModel
from thermoband.mixed.stats import series_statistics

SMALL = PeriodicModel(factors=BODY_MODEL.factors, hour_harmonics=1, day_harmonics=0)
SMALL_ENV = PeriodicModel(factors=ENV_MODEL.factors, hour_harmonics=1, day_harmonics=1, slopes_by="treatment")


def spd(n, seed):
    x = np.random.default_rng(seed).normal(size=(4 * n, n))
    return x.T @ x


@pytest.mark.parametrize("n,k", [(1, 1), (4, 2), (7, 7), (30, 29)])
def test_sweep(spark, n, k):
    """Swept on the first k, a matrix holds the inverse, the solutions and the Schur complement."""
    a = spd(n, n)
    rows = spark.createDataFrame([(a.tolist(),)], "a array<array<double>>").select(linear.swept(F.col("a"), range(k)).alias("s"))
    got = rows.first().s
    m = np.array(got.matrix)
    inv = np.linalg.inv(a[:k, :k])
    assert m[:k, :k] == pytest.approx(-inv, rel=1e-9)
    assert m[:k, k:] == pytest.approx(inv @ a[:k, k:], rel=1e-8, abs=1e-12)
    assert m[k:, k:] == pytest.approx(a[k:, k:] - a[k:, :k] @ inv @ a[:k, k:], rel=1e-8, abs=1e-9)
    assert got.log_det == pytest.approx(np.linalg.slogdet(a[:k, :k])[1], rel=1e-10)


def test_no_pivots_and_packed_matrices(spark):
    a = spd(3, 5)
    packed = a[np.triu_indices(3)].tolist()
    row = spark.createDataFrame([(packed,)], "p array<double>").select(linear.packed_to_matrix(F.col("p"), 3).alias("m"))
    got = row.select("m", linear.swept(F.col("m"), []).alias("s")).first()
    assert np.array(got.m) == pytest.approx(a) and np.array(got.s.matrix) == pytest.approx(a) and got.s.log_det == 0


def test_nested_residuals(spark):
    a = spd(6, 2)
    row = spark.createDataFrame([(a.tolist(),)], "a array<array<double>>")
    got = row.select(linear.nested_residuals(F.col("a"), [[0], [1, 2], [3, 4]], 5).alias("r")).first().r
    want = [a[5, 5]] + [a[5, 5] - a[5, :k] @ np.linalg.solve(a[:k, :k], a[:k, 5]) for k in (1, 3, 5)]
    assert got == pytest.approx(want, rel=1e-10)


@pytest.mark.parametrize("which", ["body", "env", "wide"])
def test_everything_at_stated_parameters(spark, which):
    """Criterion, coefficients, slopes and series coefficients equal dense matrices, one-row series included."""
    model = {"body": SMALL, "env": SMALL_ENV, "wide": BODY_MODEL}[which]
    n_sd = model.slopes_per_series * len(model.slope_levels)
    sizes = [40, 25, 30, 1, 2, 33, 50, 28, 60, 45] + ([90] * 6 if which == "wide" else [])
    rows, _, _ = simulate(model, sizes, 0.6, np.linspace(0.4, 0.9, n_sd), 1.5, 3)
    df = frame(spark, model, rows)
    for phi, sd in ((0.5, np.linspace(0.3, 1.1, n_sd)), (0.0, np.zeros(n_sd)), (0.8, np.full(n_sd, 0.7))):
        stats = series_statistics(df, model, "id", "temp", "datetime", ORDER)
        marginal = plain.marginal_matrices(stats, model, phi, sd)
        fits = plain.class_fits(marginal, model)
        got = plain.criterion(fits, model).first()
        want = evaluate(stats, model, [np.r_[math.atanh(phi), sd]])[0]
        assert (got.n_rows, got.n_series) == (want.n_rows, want.n_series) == (len(rows), len(sizes))
        assert got.reml == pytest.approx(want.criterion, rel=1e-9)
        assert got.sigma == pytest.approx(math.sqrt(want.sigma2), rel=1e-8)
        full = dense(model, rows, np.r_[math.atanh(phi), sd])
        assert got.reml == pytest.approx(full[0], rel=1e-7)
        fitted = at_parameters(df, model, "id", phi, sd, order=ORDER)
        told = {(r.id, r.term): r.value for r in plain.series_slopes(marginal, fits, model, sd, "id").collect()}
        known = {(r.id, r.term): r.value for r in predict.long_effects(fitted).collect()}
        assert told.keys() == known.keys()
        for key, value in known.items():
            assert told[key] == pytest.approx(value, rel=1e-6, abs=1e-9), key
        if which != "wide":
            dims = df.select("id", *[n for n, _ in model.factors]).distinct()
            one = {r.id: r.coef for r in plain.series_coefficients(marginal, fits, model, sd, "id").collect()}
            two = {r.id: r.coef for r in predict.with_effects(dims, fitted).collect()}
            assert one.keys() == two.keys() and all(one[s] == pytest.approx(two[s], rel=1e-6, abs=1e-9) for s in two)


@pytest.mark.parametrize("model,labels", [(SMALL, tables.BODY_TERMS), (SMALL_ENV, tables.ENV_TERMS)], ids=["body", "env"])
def test_sequential_tests(spark, model, labels):
    n_sd = model.slopes_per_series * len(model.slope_levels)
    sd = np.linspace(0.2, 0.6, n_sd)
    rows, _, _ = simulate(model, [40, 35, 30, 45, 20, 33, 50, 28], 0.5, sd, 1.0, 9)
    df = frame(spark, model, rows)
    fitted = at_parameters(df, model, "id", 0.5, sd, order=ORDER)
    named = [t for t in labels if "Day" not in t] if model is SMALL else list(labels)
    stats = series_statistics(df, model, "id", "temp", "datetime", ORDER)
    fits = plain.class_fits(plain.marginal_matrices(stats, model, 0.5, sd), model)
    got = sorted(tuple(r) for r in plain.sequential_tests(fits, model, named).collect())
    want = tables.sequential_tests(fitted, named)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[4:] == pytest.approx(w[4:], rel=1e-6, abs=1e-12)


def test_a_class_without_series_is_refused(spark):
    rows, _, _ = simulate(SMALL, [30, 30], 0.5, [0.3, 0.3], 1.0, 1)
    df = frame(spark, SMALL, [r for r in rows if r[0] == 0])
    stats = series_statistics(df, SMALL, "id", "temp", "datetime", ORDER)
    fits = plain.class_fits(plain.marginal_matrices(stats, SMALL, 0.5, [0.3, 0.3]), SMALL)
    with pytest.raises(Exception, match="cannot be told apart"):
        plain.criterion(fits, SMALL).collect()
