"""Operators on small frames with known results."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermoband.functions import clock
from thermoband.operators import cleaning, grids, series, smooth, summary
from thermoband.operators.band import BAND, group_quantiles, reference_band
from thermoband.operators.keys import code_series, number_keys
from thermoband.schemas import BODY_RAW
from thermoband.sources import logs, tables


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    groups = {"hot": 3000, "pair": 2, "one": 1, "mid": 101}
    rows = [(g, float(v)) for g, n in groups.items() for v in rng.normal(25, 8, n)]
    rows += [("ties", float(v)) for v in rng.integers(-2, 3, 500)]
    got = group_quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", BAND)
    for r in got.collect():
        x = [v for g, v in rows if g == r["g"]]
        assert r["n_obs"] == len(x)
        assert (r["tb_med"], r["tb_q1"], r["tb_q3"]) == pytest.approx(tuple(np.quantile(x, [0.5, 0.25, 0.75])), abs=1e-12)


def test_quantiles_of_a_group_with_a_missing_value(spark):
    rows = [("a", 1.0), ("a", None), ("a", 3.0), ("b", 1.0), ("b", float("nan")), (None, 2.0), (None, 4.0), ("c", None)]
    got = group_quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", {"m": 0.5})
    assert {r["g"]: (r["m"], r["n_obs"]) for r in got.collect()} == {
        "a": (None, 3), "b": (None, 2), None: (3.0, 2), "c": (None, 1)
    }


def test_reference_band_is_an_unweighted_mean(spark):
    lab = spark.createDataFrame(
        [("G1", "Pregnant", 10.0, 8.0, 12.0, 900), ("G2", "Pregnant", 20.0, 18.0, 22.0, 1), ("N1", "Other", 1.0, 1.0, 1.0, 1)],
        "snakeid string, repro string, tb_med double, tb_q1 double, tb_q3 double, n_obs long",
    )
    got = {r["type"]: r for r in reference_band(lab).collect()}
    assert (got["G"]["location"], got["G"]["tb_med"], got["G"]["tb_q1"], got["G"]["tb_q3"]) == ("Rookery", 15, 13, 17)
    assert got[None]["location"] is None


def test_carried_column_with_two_values_gives_two_rows(spark):
    t = datetime(2020, 7, 1, 5)
    df = spark.createDataFrame([("a", t, 5, 1.0, 2.0), ("a", t, 5, 3.0, 9.0)], "g string, datetime timestamp_ntz, hour int, x double, q double")
    assert summary.hourly_mean(df, ["g"], "x", carry=["q"]).count() == 2


def test_widen_fills_missing_cells_with_null(spark):
    df = spark.createDataFrame([("Day", "Prairie", 1.0)], "daytime string, location string, v double")
    assert tuple(summary.widen(df, ["daytime"], "location", ["Prairie", "Rookery"], "v").first()) == ("Day", 1.0, None)


def test_run_metadata(spark):
    t0 = datetime(2020, 7, 1, 10, 0, 30)
    steps = [0, 10, 20, 95, 95.5, 4000, 100_000]
    rows = [("G1", "Pregnant", 1, t0 + timedelta(seconds=s), 1.0) for s in reversed(steps)]
    rows += [("G2", "Pregnant", 1, t0, 1.0), ("G3", "Pregnant", 1, t0, 1.0), ("G3", "Pregnant", 1, None, 1.0)]
    df = spark.createDataFrame(rows, "snakeid string, repro string, run int, datetime timestamp_ntz, tb double")
    got = {r["snakeid"]: r for r in series.run_metadata(df).collect()}
    gaps = np.diff(steps)
    g1 = got["G1"]
    assert (g1["n_obs"], g1["gap_max_s"], g1["gap_min_s"], g1["duration_s"]) == (7, gaps.max(), gaps.min(), 100_000)
    assert (g1["d"], g1["h"], g1["m"], g1["s"]) == (1, 3, 46, 40.0)
    assert (got["G2"]["n_obs"], got["G2"]["gap_max_s"], got["G2"]["duration_s"]) == (1, None, 0)
    assert (got["G3"]["n_obs"], got["G3"]["start"], got["G3"]["duration_s"]) == (2, None, None)


@pytest.mark.parametrize("per_minute", [1, 7])
def test_neighbours_follow_the_time_order(spark, per_minute):
    rng = np.random.default_rng(3)
    t0 = datetime(2020, 7, 1)
    rows = []
    for s, n in (("hot", 400), ("two", 2), ("one", 1)):
        for i in range(n):
            rows.append((s, t0 + timedelta(seconds=60 / per_minute * i), i, float(i)))
    rng.shuffle(rows)
    df = spark.createDataFrame([tuple(r) for r in rows], "s string, t timestamp_ntz, o int, y double")
    got = series.consecutive(df, "s", "t", ["t", "o"], ["y"]).collect()
    assert len(got) == 403
    last = {"hot": 399, "two": 1, "one": 0}
    for r in got:
        assert (r["prev"]["y"] if r["prev"] else None) == (r["y"] - 1 if r["y"] > 0 else None)
        assert r["is_last"] == (r["y"] == last[r["s"]])


def test_numbering_spans_ranges_and_groups(spark):
    keys = spark.range(5000).select(
        F.format_string("k%05d", F.col("id")).alias("k"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("g")
    ).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = number_keys(keys, ["k"]).orderBy("k").collect()
        assert [r["id"] for r in got] == list(range(1, 5001))
        got = number_keys(keys, ["k"], within=["g"], name="n").orderBy("g", "k").collect()
        n_x = sum(r["g"] == "x" for r in got)
        assert [r["n"] for r in got] == [*range(1, n_x + 1), *range(1, 5001 - n_x)]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_dictionary_keeps_text_order(spark):
    df = spark.createDataFrame([("G2",), ("G10",), ("NG1",), ("G2",), (None,)], "k string")
    assert {r["k"]: r["id"] for r in code_series(df, "k").collect()} == {"G10": 1, "G2": 2, "NG1": 3}


def test_season_and_dates(spark):
    rows = [(datetime(2020, 6, 29, 23, 59),), (datetime(2020, 6, 30),), (datetime(2020, 8, 24, 23),), (datetime(2020, 8, 25),)]
    df = spark.createDataFrame(rows, "datetime timestamp_ntz")
    for years in (None, (2020,), (2019, 2020)):
        assert sorted(r[0] for r in cleaning.cut_season(df, 182, 237, years=years).collect()) == [rows[1][0], rows[2][0]]
    other = spark.createDataFrame([(datetime(2020, 6, 30, 12),), (datetime(2020, 8, 24, 1),)], "datetime timestamp_ntz")
    assert cleaning.within_dates_of(df, other).count() == 2


def test_grid_axes(spark):
    df = spark.createDataFrame([(3, 0, "a"), (5, 23, "b")], "day int, hour int, f string")
    got = grids.group_grid(df, {"f": ("a", "b", "c")}, hours=3, days=None).collect()
    assert {(r["f"], r["day"], r["hour"]) for r in got} == {(f, d, h) for f in "ab" for d in (3.0, 5.0) for h in (0.0, 11.5, 23.0)}
    dims = spark.createDataFrame([(1,), (2,)], "id int")
    got = grids.series_grid(df, dims, hours=2, days=3).collect()
    assert {(r["id"], r["day"], r["hour"]) for r in got} == {(i, d, h) for i in (1, 2) for d in (3.0, 4.0, 5.0) for h in (0.0, 23.0)}


def test_a_large_grid_has_no_more_tasks_than_it_needs(spark):
    """Tasks grow with the grid once there are many, and series are dealt before they unfold."""
    assert [grids.grid_tasks(n) for n in (0, 200_000, 200_001, 10**7, 36 * 10**7, 216 * 10**7)] == [1, 1, 2, 50, 256, 1080]
    df = spark.createDataFrame([(3, 0), (5, 23)], "day int, hour int")
    dims = spark.range(100).select(F.col("id").cast("int"))
    grid = grids.series_grid(df, dims, hours=100, days=40)
    plan = grid._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Repartition")
    assert (grid.count(), grid.distinct().count(), grid.rdd.getNumPartitions()) == (400_000, 400_000, 2)


def test_a_series_of_many_rows_is_dealt_by_days(spark, monkeypatch):
    monkeypatch.setattr(grids, "TASK_ROWS", 10)
    df = spark.createDataFrame([(3, 0), (5, 23)], "day int, hour int")
    grid = grids.series_grid(df, spark.range(2), hours=5, days=4)
    assert (grid.count(), grid.distinct().count(), grid.rdd.getNumPartitions()) == (40, 40, 4)


def test_grids_refuse_what_they_do_not_know(spark):
    df = spark.createDataFrame([(3, 0, "a"), (5, 23, None), (None, 1, "b")], "day int, hour int, f string")
    assert grids.group_grid(df, {"f": ("a", "b")}, hours=2, days=None).count() == 8
    with pytest.raises(Exception, match="unknown level of f: b"):
        grids.group_grid(df, {"f": ("a",)}, hours=2, days=None).collect()
    with pytest.raises(Exception, match="outside 1..366: 400"):
        grids.group_grid(df.withColumn("day", F.lit(400)), {}, hours=2, days=None).collect()


def test_smoother_reproduces_a_quadratic(spark):
    rng = np.random.default_rng(5)
    rows = [("a", int(h), float(2 - 0.3 * h + 0.05 * h * h)) for h in rng.integers(0, 24, 600)]
    got = smooth.loess_by_hour(spark.createDataFrame(rows, "g string, hour int, y double"), ["g"], "y").collect()
    assert len(got) == 200
    for r in got:
        assert r["fit"] == pytest.approx(2 - 0.3 * r["x0"] + 0.05 * r["x0"] ** 2, abs=1e-8)


def test_smoother_falls_back_and_rejects_fractions(spark):
    line = spark.createDataFrame([("a", 3, 1.0), ("a", 9, 4.0)] * 5, "g string, hour int, y double")
    fit = smooth.loess_by_hour(line, ["g"], "y").collect()
    assert all(np.isfinite(r["fit"]) for r in fit)
    point = spark.createDataFrame([("a", 3, 1.0), ("a", 3, 4.0)] * 5, "g string, hour int, y double")
    assert {r["fit"] for r in smooth.loess_by_hour(point, ["g"], "y").collect()} == {2.5}
    odd = spark.createDataFrame([("a", 3.5, 1.0)], "g string, hour double, y double")
    with pytest.raises(Exception, match="whole hours"):
        smooth.loess_by_hour(odd, ["g"], "y").collect()


def test_log_folder_with_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Time,SnakeID,Location,Temp\n7/1/2020,13:05:09,G1,field,20.5\n7/1/2020,bad,G1,field,NA\n")
    (tmp_path / "b.csv").write_text("Temp,SnakeID,Location,Date,Time\n30.5,N2,lab,07/01/20,13:45:00\n")
    (tmp_path / "c.TXT").write_text("\ufeffdate,time,snakeid,temp,note\r\n7-2-20,0:00:00,N3,1.5,\"x, y\"\r\n\r\n")
    (tmp_path / "empty.csv").write_text("")
    rows = {(r["original_id"], r["read_at"]): r for r in logs.body_logs(spark, str(tmp_path)).collect()}
    assert len(rows) == 4
    assert rows["G1", datetime(2020, 7, 1, 13, 5, 9)]["temp"] == 20.5
    assert rows["G1", None]["temp"] is None
    n2 = rows["N2", datetime(2020, 7, 1, 13, 45)]
    assert (n2["temp"], n2["datetime"], n2["type"], n2["location"]) == (30.5, datetime(2020, 7, 1, 14), "N", "lab")
    assert rows["N3", datetime(2020, 7, 2)]["location"] is None
    raw = logs.read_log_dir(spark, str(tmp_path), BODY_RAW)
    assert [r["note"] for r in raw.collect() if r["note"]] == ["x, y"]
    text = F.concat_ws(" ", "date", "time")
    bad = {r["file"][-5:]: (r["n"], r["n_unreadable"]) for r in logs.unreadable_times(raw, text, clock.parse_mdy_hms(text)).collect()}
    assert bad == {"a.csv": (2, 1), "b.csv": (1, 0), "c.TXT": (1, 0)}


def test_more_headers_than_a_person_would_write(spark, tmp_path):
    for k in range(230):
        (tmp_path / f"f{k}.csv").write_text(f"x{k},temp\n{k},{k}.5\n")
    rows = logs.read_log_dir(spark, str(tmp_path), BODY_RAW).collect()
    assert sorted(r["temp"] for r in rows) == [k + 0.5 for k in range(230)]
    assert sum(r["x7"] == "7" for r in rows) == 1


def test_tables_roundtrip_and_day_folders(spark, tmp_path):
    df = spark.createDataFrame([(1, 182, None), (2, 183, 2.5)], "id int, day int, x double")
    tables.save_tables({"t": df}, str(tmp_path), by={"t": ["day"]})
    back = tables.load_tables(spark, str(tmp_path), ["t"])["t"]
    assert sorted(map(tuple, back.select("id", "day", "x").collect())) == [(1, 182, None), (2, 183, 2.5)]
    plan = back.filter("day = 183")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    tables.write_csv(df, str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    assert "1,182,NA" in text


def test_union_fills_missing_columns(spark):
    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([(2,)], "i int")
    assert sorted(map(tuple, logs.union_by_name(a, b).collect())) == [(1, "x"), (2, None)]


def test_season_covers_every_year(spark, tmp_path):
    """Readings of the season count in whatever year they lie."""
    from thermoband.plans.inputs import Inputs

    times = ["2019-01-10 05:10:00", "2022-12-31 23:50:00", "2023-01-05 00:10:00", "2023-01-25 23:20:00", "2023-03-01 00:00:00", "2024-01-15 08:00:00"]
    for name, some, years in (("more", times, tuple(range(2019, 2025))), ("none", [], None), ("far", [*times, "2300-01-10 00:00:00"], None)):
        rows = [(k, t, 10 + k, "view", 20.0) for k, t in enumerate(some)]
        df = spark.createDataFrame(rows, "event_id bigint, t string, user_id bigint, event_type string, value double")
        df.selectExpr("event_id", "CAST(t AS TIMESTAMP_NTZ) AS ts", "user_id", "event_type", "value").write.parquet(f"{tmp_path}/{name}/events.parquet")
        inputs = Inputs(spark, f"{tmp_path}/{name}")
        assert inputs.years == years
        assert inputs.tb_rows.count() == inputs.tb.count() == len([t for t in some if "-01-" in t])


def season_plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_season_ranges_are_clipped_and_joined():
    known = (datetime(2021, 6, 1), datetime(2023, 2, 1))
    ranges = cleaning.season_ranges(range(2021, 2024), 182, 237, known)
    assert [(a.year, b.year) for a, b in ranges] == [(2021, 2021), (2022, 2022)]  # the third starts after the last time
    many = cleaning.season_ranges(range(1990, 2024), 182, 237, slack=timedelta(minutes=30))
    assert many == [(datetime(1990, 6, 30, 23, 30), datetime(2023, 8, 26, 0, 30))]
    assert cleaning.season_ranges(range(2021, 2022), 182, 237, (datetime(2021, 1, 1), datetime(2021, 1, 2))) == []


@pytest.mark.parametrize("first_day,last_day", [(1, 1), (1, 366), (365, 366), (366, 366)])
def test_season_at_the_turn_of_the_year(spark, first_day, last_day):
    """Times rounded up into the next year, or lying in a leap day, are kept whatever is pushed into the scan."""
    times = ["2019-12-31 23:20:00", "2019-12-31 23:40:00", "2020-01-01 00:10:00", "2020-12-30 23:50:00", "2020-12-31 23:29:59", "2020-12-31 23:30:00"]
    rows = spark.createDataFrame([(t,) for t in times], "t string").selectExpr("CAST(t AS TIMESTAMP_NTZ) AS read_at")
    rows = rows.withColumn("datetime", clock.round_hour("read_at"))
    read = [datetime.fromisoformat(t) for t in times]
    whole = cleaning.cut_season(rows, first_day, last_day)
    known = cleaning.cut_season(rows, first_day, last_day, read_at="read_at", known=(read[0], read[-1]))
    assert sorted(whole.collect()) == sorted(known.collect())
    assert whole.count() > 0 and "read_at" in season_plan(known)


def test_many_years_are_one_range(spark):
    rows = spark.range(60).selectExpr("make_timestamp_ntz(1960 + CAST(id AS INT), 1, 10, 12, 0, 0) AS datetime")
    kept = cleaning.cut_season(rows, 5, 25, known=(datetime(1960, 1, 10), datetime(2019, 1, 10)))
    assert kept.count() == 60
    text = season_plan(kept)
    assert "1960-01-05" in text and "2019-01-26" in text and "1961" not in text
