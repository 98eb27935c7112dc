"""The mixed model against dense NumPy computations on few series."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from thermoband.mixed import fit as fitting
from thermoband.mixed import predict, tables
from thermoband.mixed.fit import evaluate, fit
from thermoband.mixed.spec import BODY_MODEL, ENV_MODEL, PeriodicModel
from thermoband.mixed.special import beta_inc, f_tail, t_quantile
from thermoband.mixed.stats import series_statistics, unpack
from thermoband.operators import grids

ORDER = ["datetime", "obs_id"]


def simulate(model: PeriodicModel, sizes, phi, sd, sigma, seed):
    """Readings of series with known parameters: [(id, levels, hour, day, y)] per series."""
    rng = np.random.default_rng(seed)
    beta = rng.normal(0, 1, model.fixed_size)
    beta[0] = 25.0
    rows, effects = [], {}
    levels = model.class_levels()
    k = model.slopes_per_series
    t0 = datetime(2020, 1, 1)
    obs = 0
    for s, n in enumerate(sizes):
        lv = levels[s % len(levels)]
        steps = np.sort(rng.choice(24 * 350, size=n, replace=False))
        hour, day = steps % 24, 1 + steps // 24
        u = model.basis_rows(hour, day)
        b = rng.normal(0, 1, k) * sd[model.slope_block(lv) * k:][:k]
        e = np.empty(n)
        e[0] = rng.normal()
        for i in range(1, n):
            e[i] = phi * e[i - 1] + math.sqrt(1 - phi**2) * rng.normal()
        mean = u @ (model.class_vector(lv) @ beta.reshape(model.class_size, -1))
        y = mean + u[:, model.slope_basis] @ b + sigma * e
        effects[s] = b
        for i in range(n):
            rows.append((s, *lv, t0 + timedelta(hours=int(steps[i])), obs, int(hour[i]), int(day[i]), float(y[i])))
            obs += 1
    return rows, beta, effects


def frame(spark, model, rows):
    names = ", ".join(f"{n} string" for n, _ in model.factors)
    df = spark.createDataFrame(
        rows, f"id int, {names}, datetime timestamp_ntz, obs_id long, hour int, day int, temp double"
    )
    return df.repartition(7)


def dense(model, rows, theta):
    """Criterion, beta, covariance, sigma2 and slopes from full matrices."""
    phi, sd = math.tanh(theta[0]), np.asarray(theta[1:])
    k = model.slopes_per_series
    nf = len(model.factors)
    xx = xy = yy = logdet = 0.0
    per_series = {}
    for s in sorted({r[0] for r in rows}):
        mine = [r for r in rows if r[0] == s]
        lv = tuple(mine[0][1:1 + nf])
        u = model.basis_rows([r[3 + nf] for r in mine], [r[4 + nf] for r in mine])
        y = np.array([r[5 + nf] for r in mine])
        x = np.kron(model.class_vector(lv)[None, :], u)[:, model.positions()]
        z = u[:, model.slope_basis]
        n = len(y)
        lag = np.abs(np.subtract.outer(np.arange(n), np.arange(n)))
        d = np.diag(sd[model.slope_block(lv) * k:][:k] ** 2)
        v = phi**lag + z @ d @ z.T if phi else np.eye(n) + z @ d @ z.T
        inv = np.linalg.inv(v)
        xx, xy, yy = xx + x.T @ inv @ x, xy + x.T @ inv @ y, yy + y @ inv @ y
        logdet += np.linalg.slogdet(v)[1]
        per_series[s] = (x, y, z, d, inv)
    beta = np.linalg.solve(xx, xy)
    df = len(rows) - len(beta)
    rss = yy - beta @ xy
    crit = -0.5 * (df * math.log(rss) + logdet + np.linalg.slogdet(xx)[1])
    slopes = {s: d @ z.T @ inv @ (y - x @ beta) for s, (x, y, z, d, inv) in per_series.items()}
    return crit, beta, rss / df * np.linalg.inv(xx), rss / df, slopes


SMALL = {
    "body": (BODY_MODEL, [60, 45, 1, 70, 2, 55, 40, 90]),
    "env": (ENV_MODEL, [50, 45, 61, 70, 3, 55, 40, 80, 1, 66, 48, 52]),
}


@pytest.mark.parametrize("which", SMALL)
def test_criterion_and_gradient_equal_dense(spark, which):
    model, sizes = SMALL[which]
    n_sd = model.slopes_per_series * len(model.slope_levels)
    rows, _, _ = simulate(model, sizes, 0.5, np.full(n_sd, 1.0), 2.0, seed=7)
    stats = series_statistics(frame(spark, model, rows), model, "id", "temp", "datetime", ORDER).cache()
    assert stats.count() == len(sizes)
    rng = np.random.default_rng(2)
    thetas = [np.r_[0.0, np.zeros(n_sd)], np.r_[0.6, rng.uniform(0, 2, n_sd)], np.r_[-0.3, rng.uniform(0, 1, n_sd)]]
    for theta, got in zip(thetas, evaluate(stats, model, thetas, gradient=True)):
        crit, beta, cov, sigma2, _ = dense(model, rows, theta)
        at = model.positions()
        assert got.criterion == pytest.approx(crit, abs=1e-6)
        assert got.beta[at] == pytest.approx(beta, rel=1e-6, abs=1e-6)
        assert got.sigma2 == pytest.approx(sigma2, rel=1e-8)
        assert got.sigma2 * got.unscaled_cov[np.ix_(at, at)] == pytest.approx(cov, rel=1e-5, abs=1e-8)
        for j in range(len(theta)):
            h = 1e-5 * np.eye(len(theta))[j]
            slope = (dense(model, rows, theta + h)[0] - dense(model, rows, theta - h)[0]) / 2e-5
            assert got.gradient[j] == pytest.approx(slope, abs=2e-4)
    stats.unpersist()


def test_statistics_equal_direct_sums_for_a_hot_series(spark):
    model = BODY_MODEL
    rows, _, _ = simulate(model, [900, 1, 2, 40, 30], 0.3, np.ones(6), 1.0, seed=11)
    got = series_statistics(frame(spark, model, rows), model, "id", "temp", "datetime", ORDER).collect()
    assert sorted(r["id"] for r in got) == [0, 1, 2, 3, 4]
    for r in got:
        mine = [x for x in rows if x[0] == r["id"]]
        a = np.c_[model.basis_rows([x[4] for x in mine], [x[5] for x in mine]), [x[6] for x in mine]]
        cross = a[1:].T @ a[:-1]
        assert r["n"] == len(mine)
        size = model.basis_size + 1
        assert unpack(np.array(r["s0"]), size) == pytest.approx(a.T @ a, rel=1e-10, abs=1e-8)
        assert unpack(np.array(r["t1"]), size) == pytest.approx(cross + cross.T, rel=1e-10, abs=1e-8)
        assert unpack(np.array(r["s2"]), size) == pytest.approx(a[1:-1].T @ a[1:-1], rel=1e-10, abs=1e-8)


def test_statistics_do_not_depend_on_batches(spark):
    rows, _, _ = simulate(BODY_MODEL, [80, 70, 60], 0.3, np.ones(6), 1.0, seed=12)
    df = frame(spark, BODY_MODEL, rows)
    whole = {r["id"]: r["s0"] for r in series_statistics(df, BODY_MODEL, "id", "temp", "datetime", ORDER).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        cut = {r["id"]: r["s0"] for r in series_statistics(df, BODY_MODEL, "id", "temp", "datetime", ORDER).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {k: pytest.approx(v, rel=1e-12) for k, v in whole.items()} == cut


def test_bad_input_is_refused(spark):
    rows, _, _ = simulate(BODY_MODEL, [20, 20], 0.3, np.ones(6), 1.0, seed=12)
    for at, value, message in ((6, None, "missing temp"), (1, "Q", "unknown level"), (1, "N", "inside a series")):
        broken = [tuple(r) for r in rows]
        broken[3] = tuple(value if i == at else v for i, v in enumerate(broken[3]))
        with pytest.raises(Exception, match=message):
            series_statistics(frame(spark, BODY_MODEL, broken), BODY_MODEL, "id", "temp", "datetime", ORDER).collect()


@pytest.fixture(scope="module")
def fitted(spark):
    model = ENV_MODEL
    sd = np.array([4.0, 3.0, 2.0, 5.0, 1.5, 2.5, 3.5, 4.5])
    rows, beta, effects = simulate(model, [120] * 120, 0.6, sd, 1.5, seed=21)
    df = frame(spark, model, rows)
    return rows, beta, effects, sd, df, fit(df, model, "id", order=ORDER)


def test_fit_recovers_the_parameters(fitted):
    _, beta, _, sd, _, got = fitted
    assert got.phi == pytest.approx(0.6, abs=0.03)
    assert got.sigma == pytest.approx(1.5, rel=0.05)
    assert got.slope_sd == pytest.approx(sd, rel=0.4)
    error = (got.beta - beta[got.model.positions()]) / np.sqrt(np.diag(got.cov))
    assert np.abs(error).max() < 4.5 and 0.6 < error.std() < 1.5


def test_fit_is_at_the_optimum(fitted):
    rows, _, _, _, _, got = fitted
    theta = np.r_[math.atanh(got.phi), got.relative_sd]
    (point,) = evaluate(got.stats, got.model, [theta], gradient=True)
    assert np.abs(point.gradient).max() < 0.01
    crit, beta, cov, sigma2, _ = dense(got.model, rows, theta)
    assert got.criterion == pytest.approx(crit, abs=1e-5)
    assert got.beta == pytest.approx(beta, rel=1e-5, abs=1e-5)
    assert got.cov == pytest.approx(cov, rel=1e-4, abs=1e-8)


def test_effects_and_predictions_equal_dense(spark, fitted):
    rows, _, _, _, df, got = fitted
    *_, slopes = dense(got.model, rows, np.r_[math.atanh(got.phi), got.relative_sd])
    effects = {r["id"]: r["b"] for r in predict.series_effects(got).collect()}
    assert len(effects) == len(slopes)
    for s, b in slopes.items():
        assert effects[s] == pytest.approx(b, rel=1e-5, abs=1e-6)
    long = predict.long_effects(got).filter("id = 1").collect()
    levels = got.model.class_levels()[1]
    assert [r["term"] for r in long] == [n for n in got.model.slope_names() if n.endswith(levels[1])]

    grid = df.filter("id < 4").select("id", "location", "treatment", "day", "hour").distinct()
    pred = predict.predict_population(grid, got, m=8064).toPandas()
    crit = predict.simultaneous_quantile(8064)
    for _, r in pred.sample(40, random_state=0).iterrows():
        u = got.model.basis_rows([r["hour"]], [r["day"]])
        x = np.kron(got.model.class_vector((r["location"], r["treatment"])), u[0])[got.model.positions()]
        se = math.sqrt(x @ got.cov @ x)
        assert (r["pred"], r["se"]) == (pytest.approx(x @ got.beta, rel=1e-8), pytest.approx(se, rel=1e-6))
        assert (r["lo"], r["hi"]) == (pytest.approx(r["pred"] - crit * se), pytest.approx(r["pred"] + crit * se))
    own = predict.predict_series(predict.with_effects(grid, got), got).toPandas()
    both = own.merge(pred[["id", "day", "hour", "pred"]], on=["id", "day", "hour"], suffixes=("", "_fixed"))
    for _, r in both.sample(40, random_state=1).iterrows():
        z = got.model.basis_rows([r["hour"]], [r["day"]])[0, got.model.slope_basis]
        assert r["pred"] == pytest.approx(r["pred_fixed"] + z @ effects[r["id"]], rel=1e-8)


def test_waves_of_a_grid_are_computed_once(spark):
    """The same values as row by row; no wave is left in the plan of the rows."""
    df = spark.createDataFrame([(3, 0), (25, 23)], "day int, hour int")
    dims = spark.range(7).withColumn("coef", F.array(*[F.rand(i) for i in range(ENV_MODEL.basis_size)])).localCheckpoint()
    dims = dims.withColumn("coef", F.when(F.col("id") > 0, F.col("coef")))
    got = predict.predict_on_grid(df, dims, ENV_MODEL, hours=10, days=4)
    want = predict.predict_series(grids.series_grid(df, dims, hours=10, days=4), ENV_MODEL)
    assert got.columns == want.columns == ["id", "day", "hour", "pred"]
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "SIN(" in want._jdf.queryExecution().optimizedPlan().toString()
    assert "SIN(" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_a_class_is_evaluated_for_its_own_parameters_only(monkeypatch):
    """Shifts of another level's slopes don't change a class, so they cost nothing."""
    size = ENV_MODEL.basis_size + 1
    rng = np.random.default_rng(4)
    a = rng.normal(size=(3, 20, size))
    packed = list((a.transpose(0, 2, 1) @ a)[:, *np.triu_indices(size)])
    block = pd.DataFrame({"cls": 1, "n": 20, "s0": packed, "t1": packed, "s2": packed})
    theta = np.r_[0.3, rng.uniform(0.5, 1.0, 8)]
    thetas = np.array([theta, *(theta + 1e-2 * np.eye(9))])
    asked = []
    real = fitting.marginal
    monkeypatch.setattr(fitting, "marginal", lambda *args: asked.append(1) or real(*args))
    (got,) = fitting._evaluator(ENV_MODEL, thetas, True)(iter([block]))
    assert len(asked) == 1 + 1 + ENV_MODEL.slopes_per_series
    values = got.set_index("t")["v"]
    for t in range(10):
        (one,) = fitting._evaluator(ENV_MODEL, thetas[t : t + 1], True)(iter([block]))
        assert np.array_equal(values[t], one["v"][0])


def test_design_row_equals_basis_product(spark):
    for model in (BODY_MODEL, ENV_MODEL):
        rows, _, _ = simulate(model, [5] * 4, 0.1, np.ones(8), 1.0, seed=3)
        names = [n for n, _ in model.factors]
        for r in frame(spark, model, rows).select(*names, "hour", "day", model.design_row().alias("x")).collect():
            u = model.basis_rows([r["hour"]], [r["day"]])[0]
            want = np.kron(model.class_vector([r[n] for n in names]), u)[model.positions()]
            assert r["x"] == pytest.approx(want, abs=1e-12)


def test_model_sizes():
    assert (BODY_MODEL.fixed_size, ENV_MODEL.fixed_size) == (42, 60)
    assert (len(BODY_MODEL.slope_names()), len(ENV_MODEL.slope_names())) == (6, 8)
    assert sorted(ENV_MODEL.positions()) == list(range(60))
    assert ENV_MODEL.column_names()[:4] == ["(Intercept)", "location1", "treatment1", "hour_sin1"]
    assert len(set(ENV_MODEL.column_names())) == 60
    words = {"location": "Location", "treatment": "Exposure", "hour": "Hour", "day": "Day", "type": "Group"}
    for model, labels in ((ENV_MODEL, tables.ENV_TERMS), (BODY_MODEL, tables.BODY_TERMS)):
        spelled = [":".join(words[w] for w in t.name.split(":")) for t in model.terms()[1:]]
        assert tuple(spelled) == labels


def test_sequential_tests_and_means(spark, fitted):
    rows, *_, df, got = fitted
    tests = tables.sequential_tests(got, tables.ENV_TERMS)
    assert [t[2] for t in tests] == [1, 1, 4, 2, 1, 4, 4, 2, 2, 8, 4, 2, 8, 8, 8]
    assert {t[3] for t in tests} == {120 - 1 - 3, 120 * 120 - 120 - 56}
    # The last term's test is the plain Wald test of its coefficients.
    b, c = got.beta[-8:], got.cov[-8:, -8:]
    assert tests[-1][4] == pytest.approx(b @ np.linalg.solve(c, b) / 8, rel=1e-6)
    assert all(0 <= t[5] <= 1 for t in tests)

    means = tables.means_and_contrasts(got, df, ["location", "treatment"], ["location", "treatment"], rule="normal")
    assert [m[0] for m in means] == [
        "Prairie, Exposed", "Rookery, Exposed", "Prairie, Shaded", "Rookery, Shaded",
        "Prairie - Rookery", "Exposed - Shaded",
    ]
    est = {m[0]: m[1] for m in means}
    assert est["Prairie - Rookery"] == pytest.approx(
        (est["Prairie, Exposed"] + est["Prairie, Shaded"] - est["Rookery, Exposed"] - est["Rookery, Shaded"]) / 2
    )
    label, e, se, lo, hi = means[0]
    assert (e - lo, hi - e) == (pytest.approx(1.959964 * se, rel=1e-6), pytest.approx(1.959964 * se, rel=1e-6))
    wide = tables.means_and_contrasts(got, df, ["location"], [])[0]
    assert wide[4] - wide[1] == pytest.approx(t_quantile(0.975, 116) * wide[2])


def test_tail_areas():
    assert t_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-8)
    assert t_quantile(0.975, 1e7) == pytest.approx(1.959964, abs=1e-5)
    assert f_tail(4.9646, 1, 10) == pytest.approx(0.05, abs=1e-5)
    assert f_tail(3.0, 8, 14224) == pytest.approx(0.0022, abs=2e-4)
    assert beta_inc(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-10)
    assert predict.simultaneous_quantile(1) == pytest.approx(1.959964, abs=1e-6)
