"""What the plans must and must not contain, and hot keys on whole queries."""

from __future__ import annotations

import os
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import difference
from thermoband.operators import grids, series
from thermoband.operators.band import group_quantiles
from thermoband.operators.keys import laid_out
from thermoband.plans.inputs import Inputs
from thermoband.plans.queries import QUERIES

FITTED = re.compile("lmm|predict|pred_|emm|anova")
LAZY = sorted(n for n in QUERIES if not FITTED.search(n))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_joins_and_no_whole_table_windows(spark, sf_dir, name):
    text = plan(entry.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    # A window without a partition key runs in one task; only range sizes may do that.
    for single in re.findall(r"Exchange SinglePartition.*\n(.*)", text):
        assert "HashAggregate" in single or "_part" in single, single


def test_columns_are_pruned_and_filters_pushed(spark, sf_dir):
    text = plan(Inputs(spark, sf_dir).lab_raw.select("snakeid", "tb"))
    assert "EqualTo(event_type,view)" in text
    assert "ReadSchema: struct<user_id:bigint,event_type:string,value:double>" in text
    text = plan(entry.queries()["q_daypart3"](spark, sf_dir))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in text


def test_flagship_aggregates_before_each_shuffle(spark, sf_dir):
    text = plan(entry.entry(spark))
    assert text.count("partial_avg(de") >= 1
    assert "BroadcastHashJoin" in text


@pytest.fixture(scope="module")
def hot_dir(spark, sf_dir, tmp_path_factory):
    """The events with a third of all rows under one user."""
    root = tmp_path_factory.mktemp("hot")
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    hot = ev.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(2).cast("long")).otherwise(F.col("user_id")))
    hot.coalesce(1).write.parquet(f"{root}/events.parquet")
    return str(root)


@pytest.mark.parametrize(
    "name",
    ["q_gradient", "q_run_metadata", "q_ar1_stats", "q_tb_clean", "q_panel_index", "q_contrast_db_group", "q_loess_te"],
)
def test_hot_series(spark, hot_dir, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{hot_dir}/events.parquet/*.parquet'")
    got = entry.queries()[name](spark, hot_dir).toPandas()
    assert difference(got, con.execute(entry.oracle_sql()[name]).df()) is None


def test_season_reaches_the_scan(spark, sf_dir):
    text = plan(entry.queries()["q_part_series_tb"](spark, sf_dir))
    assert "GreaterThanOrEqual(ts,2024-01-04T23:30" in text and "LessThan(ts,2024-01-26T00:30" in text


@pytest.mark.parametrize("name", ["q_grid_level1_tb", "q_grid_level1_te"])
def test_grid_rows_are_spread(spark, sf_dir, name, monkeypatch):
    monkeypatch.setattr(grids, "TASK_ROWS", 5000)
    sizes = entry.queries()[name](spark, sf_dir).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 4 and max(r["count"] for r in sizes) <= 7500


@pytest.mark.parametrize("shape", ["hourly", "one minute", "wide", "narrow"])
def test_no_window_over_much_of_a_series(spark, shape):
    """Every range of the layout is a small part of the hot series, whatever its rate or its values."""
    n = 4000
    step = {"hourly": 3600.0, "one minute": 0.01}.get(shape, 60.0)
    scale = {"wide": 1e9, "narrow": 1e-6}.get(shape, 30.0)
    i = F.col("id")
    rows = spark.range(n).select(
        F.lit("s").alias("k"), F.timestamp_seconds(F.lit(1_600_000_000) + i * step).cast("timestamp_ntz").alias("t"),
        (F.pmod(F.xxhash64(i), F.lit(1 << 40)) / float(1 << 40) * scale).alias("v"),
    ).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for cols in (["k", "t"], ["k", "v"]):
            sizes = laid_out(rows, cols).groupBy("k", "_part").count().collect()
            assert max(r["count"] for r in sizes) < n / 3
        got = group_quantiles(rows, ["k"], "v", {"q": 0.25}).first()
        assert got["q"] == pytest.approx(rows.agg(F.percentile("v", 0.25)).first()[0], rel=1e-12)
        assert series.consecutive(rows, "k", "t", ["t"], ["v"]).filter("prev IS NULL OR is_last").count() == 2
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_rounds_leave_nothing(spark, tmp_path, monkeypatch):
    """Of an iteration only the last result is on disk, and nothing after it, also when it fails."""
    from thermoband import session

    monkeypatch.setattr(session, "shared_dir", lambda _: f"file://{tmp_path}")
    with pytest.raises(ValueError, match="stop"), session.Scratch(spark) as scratch:
        df = scratch.replaced(spark.range(10).selectExpr("id AS x"))
        for k in range(4):
            df = scratch.replaced(df.selectExpr("x + 1 AS x"))
            (root,) = tmp_path.iterdir()
            assert len(list(root.iterdir())) == 1
        assert sorted(r.x for r in df.collect()) == list(range(4, 14))
        raise ValueError("stop")
    assert list(tmp_path.iterdir()) == []


def test_workers_find_the_package_from_any_folder(sf_dir, tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "import __spark_entry__ as e\nfrom pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        f"print('rows', e.queries()['q_ar1_stats'](s, {sf_dir!r}).count())"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300, check=False)
    assert re.search(r"rows [1-9]", done.stdout), done.stderr[-2000:]
