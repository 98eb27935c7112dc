"""Boundary and missing-value cases of the column expressions."""

from __future__ import annotations

from datetime import date, datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from thermoband.functions import categories as cat
from thermoband.functions import clock, strict
from thermoband.operators.deviation import deviation


def values(spark, rows, schema, expr):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_deviation_edges(spark):
    rows = [(x,) for x in (1.0, 2.0, 3.0, 5.0, 6.0, None)]
    band = F.lit(2.0), F.lit(5.0)
    assert values(spark, rows, "x double", deviation("x", *band)) == [-1, -3, 0, 0, 1, None]
    assert values(spark, rows, "x double", deviation("x", *band, boundary="closed")) == [-1, 0, 0, 0, 1, None]
    missing = deviation("x", F.lit(None).cast("double"), F.lit(5.0))
    assert values(spark, [(3.0,)], "x double", missing) == [None]


def test_dayparts(spark):
    hours = [0, 4, 5, 8, 9, 16, 17, 20, 21, 23, 24, None]
    want = ["Night"] * 2 + ["transition"] * 2 + ["Day"] * 2 + ["transition"] * 2 + ["Night"] * 2 + [None] * 2
    assert values(spark, [(h,) for h in hours], "h int", cat.daypart3("h")) == want
    two = values(spark, [(h,) for h in (8, 9, 16, 17, 24)], "h int", cat.daypart2("h"))
    assert two == ["night", "day", "day", "night", None]


def test_rounding_and_ecological_date(spark):
    times = [datetime(2020, 7, 1, 10, 29, 59), datetime(2020, 7, 1, 10, 30), datetime(2020, 7, 1, 23, 45)]
    got = values(spark, [(t,) for t in times], "t timestamp_ntz", clock.round_hour("t"))
    assert got == [datetime(2020, 7, 1, 10), datetime(2020, 7, 1, 11), datetime(2020, 7, 2)]
    times = [datetime(2020, 7, 2, 8, 59), datetime(2020, 7, 2, 9, 0)]
    got = values(spark, [(t,) for t in times], "t timestamp_ntz", clock.ecological_date("t"))
    assert got == [date(2020, 7, 1), date(2020, 7, 2)]


def test_clock_does_not_depend_on_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Denver")
    try:  # 02:40 does not exist there on this day
        t = [(datetime(2024, 3, 10, 2, 40),)]
        assert values(spark, t, "t timestamp_ntz", clock.round_hour("t")) == [datetime(2024, 3, 10, 3)]
        parsed = values(spark, [("3/10/2024 02:40:00",)], "s string", clock.parse_mdy_hms("s"))
        assert parsed == [datetime(2024, 3, 10, 2, 40)]
        gap = clock.seconds_between(F.lit("2024-03-10 01:00:00").cast("timestamp_ntz"), "t")
        assert values(spark, t, "t timestamp_ntz", gap) == [6000.0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_parse(spark):
    texts = ["7/1/2020 13:05:09", "07/01/20 13:05:09", "junk", "13/1/2020 1:00:00", "1/2/75 0:00:00", None]
    want = [datetime(2020, 7, 1, 13, 5, 9)] * 2 + [None, None, datetime(1975, 1, 2), None]
    assert values(spark, [(s,) for s in texts], "s string", clock.parse_mdy_hms("s")) == want
    got = values(spark, [("7/1/2020 13:05",), ("7/1/2020",)], "s string", clock.parse_mdy_hm("s"))
    assert got == [datetime(2020, 7, 1, 13, 5), None]


def test_parse_names_and_halves_of_the_day(spark):
    """English month names, whole or three letters, and AM or PM after hours from 1 to 12."""
    right = {
        "July 1, 2020 13:05:09": datetime(2020, 7, 1, 13, 5, 9), "jul 1 20 1:05:09 pm": datetime(2020, 7, 1, 13, 5, 9), "MAY-31-2020 12:00:00 AM": datetime(2020, 5, 31),
        "sep/9/1999 12:00:00PM": datetime(1999, 9, 9, 12), "7/1/2020 11:59:59 am": datetime(2020, 7, 1, 11, 59, 59), "  February 29, 2024   0:00:00 ": datetime(2024, 2, 29),
    }
    wrong = [
        "Juli 1, 2020 13:05:09", "Ju 1, 2020 13:05:09", "7/1/2020 13:05:09 PM", "7/1/2020 0:05:09 AM", "February 30, 2024 1:00:00", "7/1/2020 1:05:09 xm",
        "1 July 2020 13:05:09", "7/1/2020 1:05:09 PM later", "", " ", "July 2020 13:05:09",
    ]
    texts = [*right, *wrong]
    assert values(spark, [(s,) for s in texts], "s string", clock.parse_mdy_hms("s")) == [right.get(s) for s in texts]
    got = values(spark, [("December 31, 2020 11:59 PM",), ("Dec 31 20 0:10",), ("7/1/2020 1:05:09 PM",)], "s string", clock.parse_mdy_hm("s"))
    assert got == [datetime(2020, 12, 31, 23, 59), datetime(2020, 12, 31, 0, 10), None]


def test_day_to_date(spark):
    got = values(spark, [(182,), (237,)], "d int", clock.date_of_day("d"))
    assert got == [date(2020, 6, 30), date(2020, 8, 24)]
    got = values(spark, [(182, 13.75)], "d int, h double", clock.timestamp_of("d", "h"))
    assert got == [datetime(2020, 6, 30, 13, 45)]


def test_period_parts(spark):
    parts = clock.period_parts("s")
    row = spark.createDataFrame([(93784.5,)], "s double").select(*[c.alias(n) for n, c in parts.items()]).first()
    assert tuple(row) == (1, 2, 3, 4.5)


def test_strict_aggregates(spark):
    df = spark.createDataFrame([(1.0,), (None,), (4.0,)], "x double")
    row = df.agg(strict.mean("x"), strict.mean("x", strict=False), strict.sd("x"), strict.se("x")).first()
    assert tuple(row) == (None, 2.5, None, None)
    one = spark.createDataFrame([(1.0,)], "x double").agg(strict.mean("x"), strict.sd("x")).first()
    assert tuple(one) == (1.0, None)


def test_texts(spark):
    got = values(
        spark, [(17.396, 69.88), (0.125, -0.001), (100.0, None)], "a double, b double", cat.interval_text("a", "b")
    )
    assert got == ["( 17.4 ,  69.88 )", "( 0.12 ,  0 )", "( 100 ,  NA )"]
    assert values(spark, [("1/2/20", None)], "a string, b string", cat.unite(" ", "a", "b")) == ["1/2/20 NA"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(xs=st.lists(st.floats(-50, 120, allow_nan=False), min_size=1, max_size=30))
def test_deviation_has_the_sign_of_the_excess(spark, xs):
    got = values(spark, [(x,) for x in xs], "x double", deviation("x", F.lit(20.0), F.lit(30.0)))
    for x, d in zip(xs, got):
        if 20 < x < 30:
            assert d == 0
        elif x < 20:
            assert d == x - 20
        elif x > 30:
            assert d == x - 30
