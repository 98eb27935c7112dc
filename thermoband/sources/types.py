"""Types of the columns of a log folder, learned from all values of all files.

A value is of the narrowest kind that its text fits; a column of a file, and of
the folder, is of the narrowest kind that holds all its values:

    logical, integer < double, date, time < text

Kinds that don't lie in a line meet in text; a column without values is
logical, as nothing contradicts it. Each kind is a bit, so a column is one
aggregate: the bits of all its values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thermoband.sources import logs

#: Kinds in the order of their bits, with the texts they take (patterns of whole values; `text` takes all).
KINDS = {
    "logical": r"(?i)true|false|t|f",
    "integer": r"[+-]?[0-9]{1,9}",
    "double": r"(?i)[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|[+-]?(inf|infinity)|nan",
    "date": r"[0-9]{4}[-/](0?[1-9]|1[0-2])[-/](0?[1-9]|[12][0-9]|3[01])",
    "time": r"[0-9]{4}[-/](0?[1-9]|1[0-2])[-/](0?[1-9]|[12][0-9]|3[01])[T ]([01]?[0-9]|2[0-4]):[0-5][0-9](:[0-5][0-9](\.[0-9]+)?)?Z?",
    "text": "",
}
BITS = {kind: 1 << i for i, kind in enumerate(KINDS)}
#: Spark's types of the kinds.
TYPES = {"logical": "boolean", "integer": "int", "double": "double", "date": "date", "time": "timestamp_ntz", "text": "string"}


def kind_bit(text: Column) -> Column:
    """The bit of a value's kind; 0 for missing and empty ones."""
    trimmed = F.trim(text)
    bit = F.when(text.isNull() | (trimmed == ""), 0)
    for kind, pattern in KINDS.items():
        if pattern:
            bit = bit.when(trimmed.rlike(f"^(?:{pattern})$"), BITS[kind])
    return bit.otherwise(BITS["text"]).cast("int")


def merged(bits: Column) -> Column:
    """The kind that holds all values with these bits together."""
    kind = F.when(bits == 0, "logical").when(bits == BITS["integer"] | BITS["double"], "double")
    for name, bit in BITS.items():
        kind = kind.when(bits == bit, name)
    return kind.otherwise("text")


def file_types(spark: SparkSession, path: str, subfolders: bool = False) -> DataFrame:
    """A row per file below `path` and column that it has: name, file, its own `kind` (null without values) and the
    `merged` kind of the column in all files.

    Every value of every record counts. Names are in lower case. Two aggregates, with map-side partial results: the
    bits of each column of each file, then those of each column.
    """
    rows, _ = logs.with_headers(logs.log_records(spark, path, subfolders), path, headers=True)
    cells = F.transform("names", lambda name, i: F.struct(name.alias("name"), F.get("fields", i).alias("value")))
    held = rows.select("file", "is_header", F.explode(cells).alias("cell")).where("cell.name <> ''")
    bit = F.when(F.col("is_header"), 0).otherwise(kind_bit(F.col("cell.value")))
    own = held.groupBy(F.col("cell.name").alias("name"), "file").agg(F.bit_or(bit).alias("bits"))
    whole = own.groupBy("name").agg(merged(F.bit_or("bits")).alias("merged"))
    kind = F.when(F.col("bits") != 0, merged(F.col("bits")))
    return own.join(whole, "name").select("name", "file", kind.alias("kind"), "merged")


def folder_types(spark: SparkSession, path: str, subfolders: bool = False) -> DataFrame:
    """A row per column of the files below `path`: name, kind, n_files that have it, and n_apart, those of them whose
    own values are of another kind. A column without any value is logical."""
    apart = F.col("kind") != F.col("merged")
    return file_types(spark, path, subfolders).groupBy("name", F.col("merged").alias("kind")).agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if(apart).alias("n_apart")
    )


def folder_schema(types: DataFrame) -> T.StructType:
    """The schema that `read_log_dir` takes, from `folder_types` (a row per column)."""
    fields = [f"`{r.name}` {TYPES[r.kind]}" for r in types.orderBy("name").collect()]
    return T.StructType.fromDDL(", ".join(fields))
