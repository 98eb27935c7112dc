"""Tail areas and quantiles as columns, against the same in plain Python."""

from __future__ import annotations

import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from thermoband.functions import special
from thermoband.mixed import special as plain


def values(spark, rows, schema, **cols):
    return spark.createDataFrame(rows, schema).select("*", *[c.alias(k) for k, c in cols.items()]).collect()


def test_log_gamma(spark):
    rows = [(x,) for x in (1e-3, 0.1, 0.5, 1.0, 1.5, 2.0, 7.25, 40.0, 1234.5, 6e5)]
    for r in values(spark, rows, "x double", y=special.log_gamma(F.col("x"))):
        assert r.y == pytest.approx(math.lgamma(r.x), rel=1e-13, abs=1e-13)


def test_beta_and_f(spark):
    rows = [(x, a, b) for x in (-1.0, 0.0, 1e-6, 0.2, 0.5, 0.93, 1.0) for a, b in ((0.5, 0.5), (2.0, 3.0), (40.0, 1.5), (900.0, 4000.0), (1e5, 2e4))]
    for r in values(spark, rows, "x double, a double, b double", y=special.beta_cdf(F.col("x"), F.col("a"), F.col("b"))):
        assert r.y == pytest.approx(plain.beta_inc(r.a, r.b, r.x), rel=1e-9, abs=1e-14), r
    rows = [(f, d1, d2) for f in (-1.0, 0.0, 0.3, 1.0, 4.5, 60.0) for d1, d2 in ((1.0, 5.0), (6.0, 40.0), (20.0, 50_000.0))]
    for r in values(spark, rows, "f double, a double, b double", y=special.f_tail(F.col("f"), F.col("a"), F.col("b"))):
        assert r.y == pytest.approx(plain.f_tail(r.f, r.a, r.b), rel=1e-8, abs=1e-14), r


def test_normal(spark):
    rows = [(p,) for p in (1e-12, 1e-6, 1e-3, 0.025, 0.3, 0.5, 0.5000001, 0.7, 0.975, 0.99, 1 - 1e-4, 1 - 1e-9)]
    for r in values(spark, rows, "p double", z=special.normal_quantile(F.col("p"))):
        assert r.z == pytest.approx(NormalDist().inv_cdf(r.p), rel=1e-12, abs=1e-12), r


def test_t(spark):
    rows = [(q, df) for q in (0.4, 0.05, 0.025, 0.0005) for df in (1.0, 2.0, 3.0, 17.0, 250.0, 80_000.0)]
    for r in values(spark, rows, "q double, df double", t=special.upper_t(F.col("q"), F.col("df"))):
        assert r.t == pytest.approx(plain.t_quantile(1 - r.q, r.df), rel=1e-9), r


def test_null_and_integer_arguments(spark):
    rows = values(spark, [(None, 3), (2, None), (2, 3)], "f int, d int", y=special.f_tail(F.col("f"), F.col("d"), F.lit(4)))
    assert [r.y for r in rows][:2] == [None, None]
    assert rows[2].y == pytest.approx(plain.f_tail(2, 3, 4))
