"""Local quadratic regression on the hour of day."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def censor(df: DataFrame, value: str, lo: float, hi: float) -> DataFrame:
    """Drop rows outside the limits of a value axis, as done before smoothing."""
    return df.filter(F.col(value).between(lo, hi))


#: Of the interpolating surface: share of a neighbourhood that a cell holds at most, and margin around all values.
CELL, MARGIN = 0.2, 0.005
#: Distinct values that the cells are made for, which bounds the depth of their tree.
HOURS = 24


def loess_by_hour(
    df: DataFrame, keys: Sequence[str], value: str, span: float = 0.3, points: int = 200, surface: str = "direct"
) -> DataFrame:
    """Local quadratic fit of `value` on `hour` at evenly spaced points of each group.

    Rows of one hour share their distance to any point, so the fit needs only
    the count and sum of each hour: at most 24 cells per group, whatever the
    number of rows. The neighbourhood reaches to the `floor(span*n)`-th nearest
    row, weights are tricube, and the normal equations around the point are
    solved in closed form; singular ones fall back to a line, then to a mean. If
    all neighbours lie on the edge of the neighbourhood, their mean is taken.

    With `surface="interpolate"` the fit and its slope are computed at the
    vertices of a tree of cells only (see `vertices`), and cubic polynomials
    with those values and slopes are laid between them.
    """
    if surface not in ("direct", "interpolate"):
        raise ValueError(f"unknown surface {surface!r}")
    keys = list(keys)
    groups = _hour_counts(df, keys, value, span)
    spread = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")
    x0 = F.expr(f"lo + i * (hi - lo) / {points - 1}D")
    if surface == "direct":
        at = groups.select(*keys, "c", "q", spread, "lo", "hi").withColumn("x0", x0)
        return _local_fits(at).select(*keys, "i", "x0", "fit")
    at = groups.select(*keys, "c", "q", F.explode(vertices(span)).alias("x0"))
    fitted = _local_fits(at).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("x0").alias("x"), "fit", "slope"))).alias("v"))
    same = [F.col(f"_of_{k}").eqNullSafe(F.col(k)) for k in keys]
    between = groups.select(*[F.col(k).alias(f"_of_{k}") for k in keys], "lo", "hi").join(fitted, same)
    placed = between.select(*keys, "v", spread, "lo", "hi").withColumn("x0", x0)
    return placed.select(*keys, "i", "x0", _blended(F.col("v"), F.col("x0")).alias("fit"))


def _hour_counts(df: DataFrame, keys: list[str], value: str, span: float) -> DataFrame:
    """Per group its hours in order, `c` (x, w: rows, sy: sum), the rows of a neighbourhood `q`, all rows `n`, and the ends `lo`, `hi`."""
    hour = F.when(
        F.col("hour").between(0, HOURS - 1) & (F.col("hour") == F.floor("hour")), F.col("hour").cast("double")
    ).otherwise(F.raise_error(F.lit("smoothing expects whole hours 0 to 23")).cast("double"))
    cells = (
        df.filter(F.col(value).isNotNull() & F.col("hour").isNotNull())
        .groupBy(*keys, hour.alias("x"))
        .agg(F.count(F.lit(1)).cast("double").alias("w"), F.sum(value).alias("sy"))
    )
    return cells.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("x", "w", "sy"))).alias("c"),
        F.floor(F.sum("w") * F.lit(float(span)) + F.lit(1e-5)).cast("double").alias("q"),
        F.sum("w").cast("bigint").alias("n"),
        F.min("x").alias("lo"),
        F.max("x").alias("hi"),
    )


def vertices(span: float, cell: float = CELL) -> Column:
    """The vertices, in order, of the cells of a group (`c`, `n`, `lo`, `hi`).

    The first cell reaches from end to end and MARGIN of that further. A cell of more than `floor(n * span * cell)` rows
    is cut half way between two rows next to each other in order, the middle ones; if those are equal, between the
    nearest two around them that differ (looked for one row up, one down, two up, and so on, until one of the ends is
    reached); if there are none, at their value, unless that is an end of the cell.
    """
    counted = F.expr(
        "transform(c, (k, i) -> struct(k.x AS x, CAST(aggregate(slice(c, 1, i + 1), 0D, (s, y) -> s + y.w) AS BIGINT) AS upto))"
    )
    margin = MARGIN * F.greatest(F.col("hi") - F.col("lo"), 1e-3 * F.greatest(F.abs("lo"), F.abs("hi")) + 1e-30)
    most = F.greatest(F.floor(F.col("n") * F.lit(span * cell)), F.lit(1))

    def row(x: Column, place: Column) -> Column:
        """The value of the row at a place (from 1), null beyond the last."""
        return F.get(F.filter(x, lambda k: k["upto"] >= place), F.lit(0))["x"]

    def cut(x: Column, box: Column) -> Column:
        """Struct (place, at): the row after which a cell is cut, and where; null for a cell that stays."""
        first, last = box["first"], box["last"]
        middle = F.floor((first + last) / 2)

        def found(middle: Column) -> Column:
            ends = F.transform(F.filter(x, lambda k: (k["upto"] >= first) & (k["upto"] < last)), lambda k: k["upto"])
            up = F.array_min(F.filter(ends, lambda e: e >= middle))
            down = F.array_max(F.filter(ends, lambda e: e < middle))
            up = F.when(up - middle - 1 <= middle - first, up)
            down = F.when(middle - down < last - middle, down)
            return F.when(up.isNull() & down.isNull(), middle).when(down.isNull(), up).when(up.isNull(), down).otherwise(
                F.when(up - middle <= middle - down, up).otherwise(down)
            )

        place = F.transform(F.transform(F.array(middle), found), lambda p: F.struct(p.alias("place"), ((row(x, p) + row(x, p + 1)) / 2).alias("at")))[0]
        return F.transform(
            F.array(place), lambda p: F.when((last - first + 1 > most) & (p["at"] != box["lo"]) & (p["at"] != box["hi"]), p)
        )[0]

    def box(first: Column, last: Column, lo: Column, hi: Column) -> Column:
        return F.struct(first.cast("bigint").alias("first"), last.cast("bigint").alias("last"), lo.alias("lo"), hi.alias("hi"))

    def level(x: Column) -> Callable[[Column, Column], Column]:
        def step(state: Column, _: Column) -> Column:
            tried = F.transform(state["open"], lambda b: F.struct(b.alias("box"), cut(x, b).alias("cut")))

            def halves(tried: Column) -> Column:
                split = F.filter(tried, lambda t: t["cut"].isNotNull())
                parts = F.transform(
                    split,
                    lambda t: F.array(
                        box(t["box"]["first"], t["cut"]["place"], t["box"]["lo"], t["cut"]["at"]),
                        box(t["cut"]["place"] + 1, t["box"]["last"], t["cut"]["at"], t["box"]["hi"]),
                    ),
                )
                found = F.concat(state["found"], F.transform(split, lambda t: t["cut"]["at"]))
                return F.struct(F.flatten(parts).alias("open"), found.alias("found"))

            return F.transform(F.array(tried), halves)[0]

        return step

    def tree(x: Column) -> Column:
        lo, hi = F.col("lo") - margin, F.col("hi") + margin
        start = F.struct(F.array(box(F.lit(1), F.col("n"), lo, hi)).alias("open"), F.array(lo, hi).alias("found"))
        # Each cut separates hours, or cuts a single hour once, so this many levels are enough.
        return F.aggregate(F.sequence(F.lit(1), F.lit(HOURS + 2)), start, level(x), lambda s: F.array_sort(F.array_distinct(s["found"])))

    return F.transform(F.array(counted), tree)[0]


def _blended(v: Column, x: Column) -> Column:
    """The cubic between the two vertices (x, fit, slope) around `x` that has their values and slopes."""
    low = F.array_max(F.filter(v, lambda k: k["x"] <= x))
    high = F.array_min(F.filter(v, lambda k: k["x"] > low["x"]))

    def cubic(p: Column) -> Column:
        a, b = p["a"], p["b"]
        h = b["x"] - a["x"]
        t = (x - a["x"]) / h
        value = (1 - t) * (1 - t) * (1 + 2 * t) * a["fit"] + t * t * (3 - 2 * t) * b["fit"]
        return value + (t * (1 - t) * (1 - t) * a["slope"] - t * t * (1 - t) * b["slope"]) * h

    return F.transform(F.array(F.struct(low.alias("a"), high.alias("b"))), cubic)[0]


def _local_fits(at: DataFrame) -> DataFrame:
    """`fit` and `slope` of the local quadratic at `x0` of each row (`c`, `q`, `x0`)."""
    reach = (
        "array_min(filter(transform(c, k -> abs(k.x - x0)), "
        "d -> aggregate(c, 0D, (s, k) -> s + if(abs(k.x - x0) <= d, k.w, 0D)) >= q))"
    )
    weight = (
        "if(h = 0, if(k.x = x0, 1D, 0D), "
        "if(abs(k.x - x0) < h, pow(1 - pow(abs(k.x - x0) / h, 3), 3), 0D))"
    )
    at = at.withColumn("h", F.expr(reach)).withColumn(
        "t", F.expr(f"transform(c, k -> struct(k.x - x0 AS u, k.w * {weight} AS w, k.sy * {weight} AS sy))")
    )
    moments = {f"m{p}": F.expr(f"aggregate(t, 0D, (s, k) -> s + k.w * pow(k.u, {p}))") for p in range(5)}
    moments |= {f"b{p}": F.expr(f"aggregate(t, 0D, (s, k) -> s + k.sy * pow(k.u, {p}))") for p in range(3)}
    moments["edge"] = F.expr(
        "aggregate(c, named_struct('w', 0D, 'sy', 0D), (s, k) -> if(abs(k.x - x0) <= h, "
        "named_struct('w', s.w + k.w, 'sy', s.sy + k.sy), s), s -> s.sy / s.w)"
    )
    fitted = at.withColumns(moments).withColumns(
        {
            "det3": F.expr("m0*(m2*m4 - m3*m3) - m1*(m1*m4 - m2*m3) + m2*(m1*m3 - m2*m2)"),
            "num3": F.expr("b0*(m2*m4 - m3*m3) - m1*(b1*m4 - b2*m3) + m2*(b1*m3 - b2*m2)"),
            "tilt3": F.expr("m0*(b1*m4 - b2*m3) - b0*(m1*m4 - m2*m3) + m2*(m1*b2 - m2*b1)"),
            "det2": F.expr("m0*m2 - m1*m1"),
            "num2": F.expr("b0*m2 - b1*m1"),
            "tilt2": F.expr("m0*b1 - m1*b0"),
        }
    )
    which = "CASE WHEN abs(det3) > 1e-10 * m0*m2*m4 THEN {} WHEN abs(det2) > 1e-10 * m0*m2 THEN {} WHEN m0 > 0 THEN {} ELSE {} END"
    return fitted.withColumns(
        {
            "fit": F.expr(which.format("num3/det3", "num2/det2", "b0/m0", "edge")),
            "slope": F.expr(which.format("tilt3/det3", "tilt2/det2", "0D", "0D")),
        }
    )
