"""Spark session defaults, and durable cut points for long lineages."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def build_session(app: str = "thermoband", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings every query here is written for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # what `durable` has written goes when nothing refers to it any more
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Python workers then import it whatever folder the driver was started in.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="thermoband-"), "thermoband-package.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, str(Path(package.name) / source.relative_to(package)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it.

    Only a local session without the setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="thermoband-")


def durable(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and go on from what was written.

    The result does not depend on any executor staying alive, and values that
    Spark may recompute differently (such as partition ids) are fixed by it.
    Spark removes the files when the result is no longer referred to, if the
    session has `spark.cleaner.referenceTracking.cleanCheckpoints` set. Rounds
    of an iteration belong into a `Scratch`, which needs no setting.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """`df`, which is written already, with a hint to broadcast it if it has at most `rows` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate files, in whatever store it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """The last result of an iteration, written to the shared folder in place of the one before; nothing is left at the end of the block."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.round = spark, f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        remove_folder(self.spark, self.folder)

    def replaced(self, df: DataFrame) -> DataFrame:
        """Write `df` and go on from what was written; the result before it, which `df` may have read, is removed."""
        self.round += 1
        df.write.parquet(f"{self.folder}/{self.round}")
        remove_folder(self.spark, f"{self.folder}/{self.round - 1}")
        return self.spark.read.parquet(f"{self.folder}/{self.round}")
