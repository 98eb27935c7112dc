"""Sharding through fixed virtual slots, in DataFrame functions only.

A record's id hashes to one of SLOTS virtual slots, for good. Bytes are summed
per slot, and a map from slot to shard balances them: slots go, largest first,
to the shard with the least bytes so far. The map is a small table with a
version. Rebalancing, for more shards or changed sizes, is an edit of the map:
each shard keeps the slots that fit its share, and only the others move.

Nothing but the slot table (SLOTS rows) is ever brought together. Places in a
shard are counted per cell, a slot's rows being dealt over CELLS cells by the
part of the input that they lie in, equal rows too, and then offset by the
cells and slots before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thermoband.llm.common import exists
from thermoband.session import durable, remove_folder, shared_dir

SLOTS = 8192
CELLS = 64
SHARDS = 24
#: Bytes that a record takes besides its text.
RECORD = 8


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, cell of each row; the slot comes from doc_id alone, or from the text if
    that is null. The cell is a matter of where the row stands, so rows that need it are written first."""
    text = F.coalesce("text", F.lit(""))
    doc_id = F.col("doc_id").cast("bigint")
    crc = F.crc32(text.cast("binary"))
    return docs.select(
        doc_id.alias("doc_id"),
        (F.octet_length(text) + RECORD).cast("bigint").alias("size"),
        crc.alias("text_crc32"),
        F.pmod(F.xxhash64(F.coalesce(doc_id, crc)), F.lit(slots)).cast("int").alias("virtual_slot"),
        F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(CELLS)).cast("int").alias("cell"),
    )


def slot_sizes(rows: DataFrame) -> DataFrame:
    """virtual_slot and its bytes."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"))


def _dealt(slots: DataFrame, loads: Column) -> DataFrame:
    """Give each slot (virtual_slot, bytes), largest first, to the least loaded shard, starting from `loads` (array by shard)."""
    start = F.struct(loads.alias("loads"), F.array().cast("array<int>").alias("to"))

    def give(state: Column, slot: Column) -> Column:
        shard = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        return F.struct(
            F.transform(state["loads"], lambda x, i: F.when(i == shard, x + slot["bytes"]).otherwise(x)).alias("loads"),
            F.concat(state["to"], F.array(shard)).alias("to"),
        )

    largest_first = F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "virtual_slot"))),
        lambda s: F.struct((-s["less"]).alias("bytes"), s["virtual_slot"].alias("virtual_slot")),
    )
    return (
        slots.agg(largest_first.alias("slots"))
        .select("slots", F.aggregate("slots", start, give)["to"].alias("to"))
        .select(F.explode(F.arrays_zip("slots", "to")).alias("x"))
        .select("x.slots.virtual_slot", F.col("x.to").alias("shard"))
    )


def first_map(sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(version 1, virtual_slot, shard) with near equal bytes in all shards."""
    dealt = _dealt(sizes, F.array_repeat(F.lit(0).cast("bigint"), shards))
    return dealt.select(F.lit(1).alias("version"), "virtual_slot", "shard")


def rebalanced(slot_map: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version of a map for `sizes` and `shards` shards. Shards with more than their share give slots
    away, smallest last to stay; slots of shards that no longer exist, and new slots, are dealt as well."""
    known = sizes.join(slot_map, "virtual_slot", "left").select("virtual_slot", "bytes", "version", "shard")
    total = known.agg(F.sum("bytes").alias("bytes"), F.max("version").alias("version")).first()
    in_shard = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
    stays = (F.col("shard") < shards) & (F.sum("bytes").over(in_shard) * shards <= (total["bytes"] or 0))
    ranked = durable(known.withColumn("stays", F.coalesce(stays, F.lit(False))))
    loads = ranked.where("stays").groupBy("shard").agg(F.sum("bytes").alias("bytes"))
    kept = loads.agg(F.map_from_entries(F.collect_list(F.struct("shard", "bytes"))).alias("m")).select(
        F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("bigint"))).alias("loads")
    )
    start = kept.first()["loads"]  # one number per shard
    moved = _dealt(ranked.where("NOT stays"), F.array(*[F.lit(x).cast("bigint") for x in start]))
    number = (total["version"] or 0) + 1
    stay = ranked.where("stays").select("virtual_slot", "shard")
    return stay.union(moved).select(F.lit(number).alias("version"), "virtual_slot", "shard")


def save_map(slot_map: DataFrame, folder: str) -> int:
    """Add a version to the maps stored below `folder` and return its number; a stored version is never touched again:
    saving one that is there is an error, as is a map of no or several versions."""
    versions = [r.version for r in slot_map.select("version").distinct().limit(2).collect()]
    if len(versions) != 1 or versions[0] is None:
        raise ValueError("a map has one version")
    target = f"{folder.rstrip('/')}/version={versions[0]}"
    if exists(slot_map.sparkSession, target):
        raise FileExistsError(f"version {versions[0]} is stored already in {folder}")
    slot_map.select("virtual_slot", "shard").write.mode("errorifexists").parquet(target)
    return versions[0]


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, the latest by default."""
    maps = spark.read.parquet(folder).select("version", "virtual_slot", "shard")
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    found = maps.where(F.col("version") == version)
    if found.isEmpty():
        raise FileNotFoundError(f"no version {version} in {folder}")
    return found


def placed(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """`rows` with their shard and their place in it (`slot`, from 0 without gaps)."""
    cells = rows.groupBy("virtual_slot", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("virtual_slot").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("in_slot", F.coalesce(F.sum("n").over(before), F.lit(0)))
    slots = cells.groupBy("virtual_slot").agg(F.sum("n").alias("slot_rows")).join(slot_map, "virtual_slot", "left")
    unknown = F.raise_error(F.lit("a virtual slot is not in the map: rebalance it first")).cast("int")
    slots = slots.withColumn("shard", F.coalesce("shard", unknown))
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select("virtual_slot", "shard", F.coalesce(F.sum("slot_rows").over(before), F.lit(0)).alias("in_shard"))
    offsets = cells.join(slots, "virtual_slot").select(
        "virtual_slot", "cell", "shard", (F.col("in_slot") + F.col("in_shard")).alias("offset")
    )
    order = Window.partitionBy("virtual_slot", "cell").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("place", F.row_number().over(order))
        .join(offsets, ["virtual_slot", "cell"])
        .withColumn("slot", (F.col("offset") + F.col("place") - 1).cast("bigint"))
        .drop("offset", "place", "cell")
    )


def shard(
    docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, slot_map: DataFrame | None = None, folder: str | None = None
) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard, slot of each row of `docs`.

    The map is the given one, or the latest of `folder`; if nothing is stored there yet, the first one is made from the
    sizes (law: near equal bytes) and stored. Without a folder it is stored in the shared one for the time being. A map
    has to know all slots that occur. A null text has no bytes and the checksum of the empty text. Rows with equal ids
    share a virtual slot and each have a place of their own; rows equal in everything are told apart by their order
    only. Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = durable(records(docs, slots))
    if slot_map is None:
        store = folder or f"{shared_dir(spark).rstrip('/')}/slots-{uuid.uuid4().hex}"
        if not exists(spark, store):
            first = durable(first_map(slot_sizes(rows), shards))
            if first.isEmpty():
                return placed(rows, first.select("virtual_slot", "shard"))
            save_map(first, store)
        slot_map = durable(load_map(spark, store))
        if not folder:
            remove_folder(spark, store)
    return placed(rows, slot_map.select("virtual_slot", "shard"))
