"""Tidy tables on shared storage."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession


# Times in CSV files keep their microseconds.
CSV_TIME = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"


def write_csv(df: DataFrame, path: str, extension: str = "csv", append: bool = False) -> None:
    """CSV folder with header; missing values are written as NA, quotes in a value doubled. `extension` (three letters) ends the file names.
    `append` adds files to those that are there."""
    writer = df.write.mode("append" if append else "overwrite").option("header", True).option("nullValue", "NA").option("extension", extension).option("escape", '"')
    writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.option("timestampNTZFormat", CSV_TIME).csv(path)


def save_tables(tables: Mapping[str, DataFrame], root: str, by: Mapping[str, Sequence[str]] | None = None) -> None:
    """One Parquet table per name. `by` names the folder columns of a table.

    A season table stored by `day` lets a later day filter skip whole folders.
    """
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        keys = (by or {}).get(name)
        if keys:
            writer = writer.partitionBy(*keys)
        writer.parquet(f"{root}/{name}")


def load_tables(spark: SparkSession, root: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{root}/{name}") for name in names}


def move_files(spark: SparkSession, source: str, target: str, prefix: str = "") -> None:
    """Move the files of one folder to another one, with `prefix` before their names. Marker files stay."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    for found in store.listStatus(path(source)):
        name = found.getPath().getName()
        if found.isFile() and not name.startswith(("_", ".")):
            store.rename(found.getPath(), path(target, f"{prefix}{name}"))


def folder_bytes(spark: SparkSession, folder: str) -> int:
    """Bytes of the files of a folder, without those of folders in it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sum(found.getLen() for found in store.listStatus(path) if found.isFile())


# --- bundles: several tables saved as one -----------------------------------------

#: The file of a bundle that names its current version and the tables in it.
POINTER = "CURRENT"


def _store(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


def _pointer(spark: SparkSession, root: str) -> list[str] | None:
    """The current version of a bundle and the names of its tables; None if there is no bundle."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root, POINTER)
    store = _store(spark, root)
    if not store.exists(path):
        return None
    stream = store.open(path)
    try:
        return bytes(stream.readAllBytes()).decode().split("\n")
    finally:
        stream.close()


def save_bundle(tables: Mapping[str, DataFrame], root: str, by: Mapping[str, Sequence[str]] | None = None) -> str:
    """Save tables as one: all of them or none. Returns the name of the version.

    They are written below a folder of their own; only when all are there, the pointer file is replaced, in one move. A
    save that stops on the way leaves the bundle as it was. The version before the new one is kept for readers that
    have loaded it, older ones and what stopped saves have left are removed.
    """
    if not tables:
        raise ValueError("a bundle needs tables")
    spark = next(iter(tables.values())).sparkSession
    if any("\n" in name or "/" in name for name in tables):
        raise ValueError("a table's name can't hold line breaks or slashes")
    before = _pointer(spark, root)
    version = f"{int(before[0].split('-')[0]) + 1 if before else 1:08d}-{uuid.uuid4().hex}"
    save_tables(tables, f"{root}/{version}", by)
    jvm, store = spark._jvm, _store(spark, root)
    path = jvm.org.apache.hadoop.fs.Path
    begun = path(root, f".{POINTER}-{version}")
    stream = store.create(begun, True)
    try:
        stream.write("\n".join([version, *tables]).encode())
    finally:
        stream.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(store.makeQualified(begun), store.makeQualified(path(root, POINTER)), how)
    kept = {version, before[0] if before else version}
    for found in store.listStatus(path(root)):
        if found.isDirectory() and found.getPath().getName() not in kept:
            store.delete(found.getPath(), True)
    return version


def load_bundle(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """All tables of the current version of a bundle."""
    current = _pointer(spark, root)
    if current is None:
        raise FileNotFoundError(f"no bundle in {root}")
    version, *names = current
    return load_tables(spark, f"{root}/{version}", names)
