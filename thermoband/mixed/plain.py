"""The mixed model at stated variance parameters, in columns only.

From the statistics per series everything follows by sweeps: a series' slopes
are swept out of its own matrix, the classes' sums are swept on the basis, and
the whole design, in the order of its terms, is swept one term after another.
Factors change nothing inside a series and all their interactions are in the
model, so each class has coefficients of its own and the log determinant of the
whole design is that of its classes and a constant.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermoband.functions import special
from thermoband.functions.linear import entry, nested_residuals, packed_to_matrix, swept
from thermoband.mixed.spec import PeriodicModel


def _class_sds(model: PeriodicModel, relative_sd: Sequence[float]) -> Column:
    """The relative standard deviations of the slopes of a row's class."""
    k = model.slopes_per_series
    blocks = [[float(x) for x in relative_sd[model.slope_block(lv) * k :][:k]] for lv in model.class_levels()]
    return F.get(F.lit(blocks), F.col("cls"))


def marginal_matrices(stats: DataFrame, model: PeriodicModel, phi: float, relative_sd: Sequence[float]) -> DataFrame:
    """`stats` with `g`, the products of basis and response weighted by the inverse covariance of the series, and
    `log_det`, the log determinant of that covariance (in units of the error variance)."""
    size, slopes = model.basis_size + 1, model.slope_basis
    k = len(slopes)
    scale = F.when(F.col("n") == 1, 1.0).otherwise(1.0 / (1.0 - phi**2))
    parts = F.arrays_zip("s0", "t1", "s2")
    white = F.transform(parts, lambda x: F.col("_scale") * (x["s0"] - phi * x["t1"] + phi**2 * x["s2"]))
    rows = stats.withColumn("_scale", scale).withColumn("_m", white).withColumn("_m", packed_to_matrix(F.col("_m"), size))
    # Rows and columns of the slopes, scaled by their deviations and with a unit matrix added, stand before the others.
    source = F.lit([*slopes, *range(size)])
    factor = F.concat(_class_sds(model, relative_sd), F.lit([1.0] * size)) if k else F.lit([1.0] * size)
    rows = rows.withColumn("_f", factor)

    def cell(i: Column, j: Column) -> Column:
        own = F.get("_f", i) * F.get("_f", j) * entry(F.col("_m"), F.get(source, i), F.get(source, j))
        return own + F.when((i == j) & (i < k), 1.0).otherwise(0.0)

    places = F.lit(list(range(k + size)))
    bordered = F.transform(places, lambda i: F.transform(places, lambda j: cell(i, j)))
    rows = rows.withColumn("_s", swept(bordered, range(k)))
    g = F.transform(F.slice(F.col("_s.matrix"), k + 1, size), lambda row: F.slice(row, k + 1, size))
    free = (F.col("n") - 1) * math.log1p(-(phi**2))
    return rows.withColumns({"g": g, "log_det": F.col("_s.log_det") + free}).drop("_scale", "_m", "_f", "_s")


def class_fits(marginal: DataFrame, model: PeriodicModel) -> DataFrame:
    """A row per class: cls, n_rows, n_series, log_det (of its series), g (their sum), beta, inverse (of X'V^-1X), rss
    and log_det_x. Matrices are summed cell by cell, with partial sums before the shuffle."""
    q = model.basis_size
    cells = F.transform(F.flatten("g"), lambda x: x)
    summed = marginal.select("cls", F.posexplode(cells).alias("pos", "x")).groupBy("cls", "pos").agg(F.sum("x").alias("x"))
    rows = summed.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("c"))
    matrix = F.transform(F.sequence(F.lit(0), F.lit(q)), lambda i: F.transform(F.slice("c", i * (q + 1) + 1, q + 1), lambda c: c["x"]))
    counts = marginal.groupBy("cls").agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_series"), F.sum("log_det").alias("log_det")
    )
    fits = rows.select("cls", matrix.alias("g")).withColumn("s", swept(F.col("g"), range(q)))
    last = F.get("s.matrix", F.lit(q))
    inverse = F.transform(F.slice("s.matrix", 1, q), lambda row: F.transform(F.slice(row, 1, q), lambda x: -x))
    fits = fits.select(
        "cls", "g", F.slice(last, 1, q).alias("beta"), inverse.alias("inverse"), F.get(last, F.lit(q)).alias("rss"),
        F.col("s.log_det").alias("log_det_x"),
    )
    return counts.join(fits, "cls")


def criterion(fits: DataFrame, model: PeriodicModel) -> DataFrame:
    """One row: n_rows, n_series, sigma and the restricted log likelihood `reml`, up to a constant."""
    p, classes = model.fixed_size, model.class_size
    sums = [F.sum(c).alias(c) for c in ("n_rows", "n_series", "rss", "log_det", "log_det_x")]
    totals = fits.agg(*sums, F.count(F.lit(1)).alias("k"))
    # Classes without series leave coefficients that nothing tells apart.
    whole = F.when(F.col("k") == classes, F.col("n_rows") - p).otherwise(
        F.raise_error(F.lit("the fixed effects cannot be told apart on these data")).cast("bigint")
    )
    totals = totals.withColumn("df", whole.cast("double"))
    log_dets = F.col("log_det") + F.col("log_det_x") + p * math.log(classes)
    return totals.select(
        "n_rows", "n_series", F.sqrt(F.col("rss") / F.col("df")).alias("sigma"),
        (-0.5 * (F.col("df") * F.log("rss") + log_dets)).alias("reml"),
    )


def _of_series(marginal: DataFrame, fits: DataFrame, model: PeriodicModel, relative_sd: Sequence[float], series: str) -> DataFrame:
    """series, cls, the class's `beta`, and `b`, the predicted slopes."""
    q = model.basis_size
    slopes = F.arrays_zip(F.lit(model.slope_basis).alias("at"), _class_sds(model, relative_sd).alias("sd"))

    def slope(x: Column) -> Column:
        row = F.get("g", x["at"])
        explained = F.aggregate(F.zip_with(F.slice(row, 1, q), F.col("beta"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return x["sd"] * x["sd"] * (F.get(row, F.lit(q)) - explained)

    known = marginal.join(F.broadcast(fits.select("cls", "beta")), "cls")  # one row per class
    return known.select(series, "cls", "beta", F.transform(slopes, slope).alias("b"))


def series_slopes(marginal: DataFrame, fits: DataFrame, model: PeriodicModel, relative_sd: Sequence[float], series: str) -> DataFrame:
    """(series, term, value): the slopes that each series has of its own."""
    k, names = model.slopes_per_series, model.slope_names()
    of_class = F.lit([names[model.slope_block(lv) * k :][:k] for lv in model.class_levels()])
    told = _of_series(marginal, fits, model, relative_sd, series)
    zipped = F.arrays_zip(F.get(of_class, F.col("cls")).alias("term"), F.col("b").alias("value"))
    return told.select(series, F.explode(zipped).alias("e")).select(series, "e.term", "e.value")


def series_coefficients(marginal: DataFrame, fits: DataFrame, model: PeriodicModel, relative_sd: Sequence[float], series: str) -> DataFrame:
    """(series, coef): the coefficients of each series on the basis, those of its class and its own slopes."""
    at = F.lit([model.slope_basis.index(j) if j in model.slope_basis else -1 for j in range(model.basis_size)])
    own = F.zip_with("beta", at, lambda x, i: x + F.when(i >= 0, F.get("b", i)).otherwise(0.0))
    return _of_series(marginal, fits, model, relative_sd, series).select(series, own.alias("coef"))


def sequential_tests(fits: DataFrame, model: PeriodicModel, labels: Sequence[str]) -> DataFrame:
    """Wald F of each term after the terms before it: ord, term, num_df, den_df, f, p. The intercept is left out.

    The whole design is put together from the classes' matrices, with the response last, and swept one term after
    another; what a term takes from the residual sum is its sum of squares.
    """
    terms, p = model.terms(), model.fixed_size
    columns = [column for term in terms for column in term.columns]
    codes = [model.class_vector(lv).tolist() for lv in model.class_levels()]
    # Factor and basis part of each column; the response is a column of its own, with factor 1.
    signs = F.lit([[code[c] for c, _ in columns] + [1.0] for code in codes])
    basis = F.lit([b for _, b in columns] + [model.basis_size])
    held = fits.agg(
        F.collect_list(F.struct("cls", "g")).alias("classes"), F.sum("rss").alias("rss"), F.sum("n_rows").alias("n_rows"),
        F.sum("n_series").alias("n_series"),
    )

    def cell(i: Column, j: Column) -> Column:
        def add(total: Column, x: Column) -> Column:
            sign = F.get(signs, x["cls"])
            return total + F.get(sign, i) * F.get(sign, j) * entry(x["g"], F.get(basis, i), F.get(basis, j))

        return F.aggregate("classes", F.lit(0.0), add)

    places = F.lit(list(range(p + 1)))
    held = held.withColumn("design", F.transform(places, lambda i: F.transform(places, lambda j: cell(i, j))))
    blocks, at = [], 0
    for term in terms:
        blocks.append(list(range(at, at + len(term.columns))))
        at += len(term.columns)
    held = held.withColumn("left", nested_residuals(F.col("design"), blocks, p))
    tested = [t for t in terms if t.name != "(Intercept)"]
    outer = sum(len(t.columns) for t in tested if not t.varies_within_series)
    between, within = F.col("n_series") - 1 - outer, F.col("n_rows") - F.col("n_series") - (p - 1 - outer)
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("ord"), F.lit(label).alias("term"), F.lit(len(t.columns)).alias("num_df"),
                (within if t.varies_within_series else between).cast("int").alias("den_df"),
                (F.get("left", F.lit(i)) - F.get("left", F.lit(i + 1))).alias("ss"),
            )
            for i, (t, label) in enumerate(zip(tested, labels, strict=True), 1)
        ]
    )
    one = held.select(F.explode(rows).alias("r"), (F.col("rss") / (F.col("n_rows") - p)).alias("s2")).select("r.*", "s2")
    one = one.withColumn("f", F.col("ss") / F.col("num_df") / F.col("s2"))
    return one.select("ord", "term", "num_df", "den_df", "f", special.f_tail(F.col("f"), F.col("num_df"), F.col("den_df")).alias("p"))

