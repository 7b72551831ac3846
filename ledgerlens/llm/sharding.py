"""Sharding by fixed virtual slots and a versioned slot-to-shard map (native).

A record's hash names one of some thousands of slots for ever.  Bytes are summed
per slot, and a small map says which shard holds a slot.  Rebalancing edits the
map, never the hash, so only the records of moved slots move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.settings import settle

SLOTS = 4096
OVERHEAD = 16


def virtual_slot(slots: int = SLOTS) -> Column:
    """The slot of a record: decided by its id, or by its text where the id is null."""
    return F.pmod(F.xxhash64(F.coalesce(F.xxhash64("doc_id"), F.lit(0)), F.when(F.col("doc_id").isNull(), F.col("text"))),
                  F.lit(slots)).cast("int")


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """One narrow row per record: id, size, checksum and virtual slot.

    A null text has no bytes: its size is the overhead and its checksum 0.
    """
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(OVERHEAD)).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).cast("bigint").alias("text_crc32"),
        virtual_slot(slots).alias("virtual_slot"),
    )


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Bytes and rows of every slot, empty slots included."""
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(sums, "virtual_slot", "left").select(
        "virtual_slot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("n", F.lit(0)).alias("n")
    )


def _place(free: DataFrame, loads: DataFrame) -> DataFrame:
    """Give the ``free`` slots, largest first, each to the least loaded shard of ``loads(loads)``.

    Both hold a fixed number of rows (slots and shards), whatever the data's size.
    """
    order = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), F.col("virtual_slot").alias("slot"))))

    def put(acc: Column, x: Column) -> Column:
        at = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int") - 1
        return F.struct(
            F.transform(acc["loads"], lambda load, i: F.when(i == at, load - x["less"]).otherwise(load)).alias("loads"),
            F.concat(acc["shards"], F.array(at)).alias("shards"),
        )

    placed = free.agg(order.alias("slots")).crossJoin(loads).select(
        "slots",
        F.aggregate("slots", F.struct(F.col("loads"), F.array().cast("array<int>").alias("shards")), put)["shards"].alias("shards"),
    )
    return placed.select(F.explode(F.arrays_zip("slots", "shards")).alias("x")).select(
        F.col("x.slots.slot").alias("virtual_slot"), F.col("x.shards").alias("shard")
    )


def first_map(sizes: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the map: shards of near equal bytes."""
    zeros = sizes.sparkSession.range(1).select(F.array_repeat(F.lit(0).cast("bigint"), shards).alias("loads"))
    return _place(sizes, zeros).select(F.lit(1).alias("version"), "virtual_slot", "shard")


def rebalance(slot_map: DataFrame, sizes: DataFrame, shards: int, slack: float = 0.02) -> DataFrame:
    """The next version: shards above their fair share give up slots, which go to the least loaded.

    With more shards than before the new ones start empty and take the freed slots;
    slots that stay within a shard's share (plus ``slack``) never move.
    """
    held = slot_map.join(sizes, "virtual_slot")
    fair = sizes.agg((F.sum("bytes") / shards * (1 + slack)).alias("fair"))
    upto = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    marked = held.withColumn("upto", F.sum("bytes").over(upto)).crossJoin(fair).withColumn(
        "stays", (F.col("upto") <= F.col("fair")) & (F.col("shard") < shards)
    )
    kept = marked.where("stays")
    loads = kept.groupBy("shard").agg(F.sum("bytes").alias("load"))
    every = sizes.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    packed = every.join(loads, "shard", "left").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("shard", F.coalesce("load", F.lit(0)).alias("load")))), lambda x: x["load"]
        ).alias("loads")
    )
    moved = _place(marked.where(~F.col("stays")), packed)
    version = slot_map.agg((F.max("version") + 1).alias("version"))
    return kept.select("virtual_slot", "shard").unionByName(moved).crossJoin(version).select("version", "virtual_slot", "shard")


def write_map(slot_map: DataFrame, path: str) -> None:
    """Add one version to the stored map; earlier versions stay readable."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    stored = spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
    if version is not None:
        return stored.where(F.col("version") == version)
    return stored.join(F.broadcast(stored.agg(F.max("version").alias("version"))), "version")


def place(rows: DataFrame, slot_map: DataFrame, sizes: DataFrame) -> DataFrame:
    """Shard and gapless position of every record: rows are numbered inside their
    virtual slot, and slots follow one another inside their shard."""
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    at = slot_map.join(sizes, "virtual_slot").select(
        "version", "virtual_slot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("place", F.row_number().over(inside))
    # The map has one row per slot, a fixed number.
    return numbered.join(F.broadcast(at), "virtual_slot").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("place") - 1).cast("bigint").alias("slot"),
        "virtual_slot", F.col("version").alias("map_version"),
    )


def shard_documents(docs: DataFrame, shards: int = 40, slots: int = SLOTS) -> DataFrame:
    """Every document with its shard under the ``bytes`` law.

    Null ids go by their text, repeated rows share a slot and get positions of their
    own, an empty table gives no rows, other columns are ignored.  Documents are not
    kept together by text: the id alone names the slot.
    """
    spark = docs.sparkSession
    rows = settle(records(docs, slots), "shard-records")
    sizes = settle(slot_sizes(rows, slots), "shard-slots")
    slot_map = settle(first_map(sizes, shards), "shard-map")
    return place(rows, slot_map, sizes).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )
