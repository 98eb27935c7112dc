"""Tail areas and quantiles of the beta, t, F and normal distributions as column expressions.

Continued fractions and series are evaluated from their last term inwards, a
fold with one number as its state, so a value never leaves the JVM. Lambda
variables keep a repeated argument from being written out again.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of Stirling's series (1/z, 1/z^3, ...).
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)
# The rational start of the normal quantile (numerator, denominator), right to 4.5e-4.
NORMAL_START = ((2.515517, 0.802853, 0.010328), (1.0, 1.432788, 0.189269, 0.001308))
#: Arguments of the log gamma function are raised by so much before the series is used.
RAISE = 8
#: Terms of the normal series and fraction, and steps of the two quantiles.
NORMAL_TERMS, NORMAL_STEPS, T_STEPS = 200, 6, 60
#: From here on the normal tail is a continued fraction, below one minus a series.
NORMAL_TAIL = 2.5


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _double(value: Column | float) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("double")


def _inwards(terms: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Fold from term `terms` down to 1."""
    return F.aggregate(F.sequence(terms.cast("int"), F.lit(1), F.lit(-1)), start, step)


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function of x > 0."""

    def of(x: Column) -> Column:
        product = x
        for k in range(1, RAISE):
            product = product * (x + k)

        def series(z: Column) -> Column:
            tail = sum((F.lit(c) / F.pow(z, 2 * k + 1) for k, c in enumerate(STIRLING)), F.lit(0.0))
            return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + tail

        return _let(x + RAISE, series) - F.log(product)

    return _let(_double(x), of)


def _beta_fraction(x: Column, a: Column, b: Column) -> Column:
    """Incomplete beta function where its continued fraction converges fast, x < (a + 1) / (a + b + 2)."""
    front = F.exp(
        log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x)
    ) / a

    def step(rest: Column, k: Column) -> Column:
        m = F.floor(k / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.when(k % 2 == 0, even).otherwise(odd) / (1 + rest)

    terms = 100 + 10 * F.sqrt(F.greatest(a, b))
    return front / (1 + _inwards(terms, F.lit(0.0), step))


def beta_cdf(x: Column, a: Column, b: Column) -> Column:
    """Regularised incomplete beta function of x for a, b > 0: 0 up to 0, 1 from 1 on, NULL if anything is."""

    def of(v: Column) -> Column:
        x, a, b = v["x"], v["a"], v["b"]
        return (
            F.when(x <= 0, 0.0)
            .when(x >= 1, 1.0)
            .when(x < (a + 1) / (a + b + 2), _beta_fraction(x, a, b))
            .otherwise(1 - _beta_fraction(1 - x, b, a))
        )

    return _let(F.struct(_double(x).alias("x"), _double(a).alias("a"), _double(b).alias("b")), of)


def f_tail(f: Column, df1: Column, df2: Column) -> Column:
    """P(F > f)."""
    f, df1, df2 = _double(f), _double(df1), _double(df2)
    return F.when(f <= 0, 1.0).otherwise(beta_cdf(df2 / (df2 + df1 * f), df2 / 2, df1 / 2))


def t_tail(t: Column, df: Column) -> Column:
    """P(T > t) for t >= 0."""
    t, df = _double(t), _double(df)
    return 0.5 * beta_cdf(df / (df + t * t), df / 2, F.lit(0.5))


def normal_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0."""

    def of(z: Column) -> Column:
        density = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        terms = F.lit(NORMAL_TERMS)
        fraction = _inwards(terms, z, lambda rest, k: z + k / rest)
        series = _inwards(terms, F.lit(1.0), lambda rest, k: 1 + z * z / (2 * k + 1) * rest)
        return F.when(z >= NORMAL_TAIL, density / fraction).otherwise(0.5 - density * z * series)

    return _let(_double(z), of)


def upper_normal(q: Column) -> Column:
    """The z with P(Z > z) = q, for 0 < q <= 1/2: a rational start and Newton steps."""

    def of(q: Column) -> Column:
        def rational(w: Column) -> Column:
            up, down = (sum((c * F.pow(w, k) for k, c in enumerate(cs)), F.lit(0.0)) for cs in NORMAL_START)
            return F.greatest(w - up / down, F.lit(0.0))

        def newton(z: Column, _: Column) -> Column:
            return z + (normal_tail(z) - q) * math.sqrt(2 * math.pi) * F.exp(z * z / 2)

        return _inwards(F.lit(NORMAL_STEPS), _let(F.sqrt(-2 * F.log(q)), rational), newton)

    return _let(_double(q), of)


def normal_quantile(p: Column) -> Column:
    """The z with P(Z <= z) = p, for 0 < p < 1."""
    p = _double(p)
    return F.when(p > 0.5, upper_normal(1 - p)).otherwise(-upper_normal(p))


def upper_t(q: Column, df: Column) -> Column:
    """The t with P(T > t) = q, for 0 < q <= 1/2. Newton steps from the normal
    value, which is below: the tail is convex, so they rise to t."""

    def of(v: Column) -> Column:
        q, df = v["q"], v["df"]

        def newton(t: Column, _: Column) -> Column:
            density = v["scale"] * F.exp(-(df + 1) / 2 * F.log1p(t * t / df))
            return t + (t_tail(t, df) - q) / density

        return _inwards(F.lit(T_STEPS), upper_normal(q), newton)

    q, df = _double(q), _double(df)
    scale = F.exp(log_gamma((df + 1) / 2) - log_gamma(df / 2)) / F.sqrt(df * math.pi)
    return _let(F.struct(q.alias("q"), df.alias("df"), scale.alias("scale")), of)
