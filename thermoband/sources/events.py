"""The `events` test table, seen as the three sensor inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermoband.functions import clock

# The lab run of a reading changes at this moment.
RUN_CHANGE = "TIMESTAMP_NTZ '2024-01-16 00:00:00'"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _animal():
    user = F.col("user_id").cast("string")
    return F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("G"), user)).otherwise(
        F.concat(F.lit("NG"), user)
    )


def body_raw(ev: DataFrame) -> DataFrame:
    """Body-temperature readings, rounded to the hour; `read_at`, `obs_id` keep the order."""
    return ev.select(
        F.col("event_id").alias("obs_id"),
        F.col("ts").alias("read_at"),
        _animal().alias("original_id"),
        F.substring(_animal(), 1, 1).alias("type"),
        F.when(F.col("event_type") == "view", "lab").otherwise("field").alias("location"),
        clock.round_hour("ts").alias("datetime"),
        F.col("value").alias("temp"),
    )


def env_raw(ev: DataFrame) -> DataFrame:
    """Readings of the fixed models at their sites."""
    user = F.col("user_id")
    return ev.select(
        F.col("event_id").alias("obs_id"),
        user.alias("id"),
        F.when(user % 10 == 9, "Entrance")
        .otherwise(F.concat(F.lit("S"), (user % 10).cast("string")))
        .alias("site"),
        F.when(user % 2 == 0, "Rookery").otherwise("Prairie").alias("location"),
        F.when(user % 4 < 2, "Exposed").otherwise("Shaded").alias("treatment"),
        F.col("ts").alias("datetime"),
        F.col("value").alias("temp"),
    )


def lab_raw(ev: DataFrame) -> DataFrame:
    """Readings of the lab experiment that gives the reference bands."""
    return ev.filter(F.col("event_type") == "view").select(
        _animal().alias("snakeid"),
        F.when(F.col("user_id") % 2 == 0, "Pregnant").otherwise("Non-Pregnant").alias("repro"),
        F.when(F.col("ts") < F.expr(RUN_CHANGE), 1).otherwise(2).alias("run"),
        F.col("ts").alias("datetime"),
        F.col("value").alias("tb"),
    )
