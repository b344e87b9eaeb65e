"""Sharding over fixed virtual slots, native.

Records are hashed by key into SLOTS virtual slots, a number that never changes.  The bytes
of each slot are aggregated (at most SLOTS rows), and slots are dealt to shards from the
heaviest down, each to the lightest shard so far, so that shard sizes are near equal.  The
map (version, slot, shard) is what is stored; adding shards edits it into the next version:
each old shard gives up only the slots above the new fair share, and only to new shards.

A row's place in its shard is the rows of the shard's earlier slots plus its rank within its
own slot, so that no task ever sorts a whole shard.

Defined results: a null text has no bytes; a null key hashes like an empty one; rows that
repeat a key share a slot and are placed in order of checksum and size; an empty table gives
no rows; other columns are dropped by assign().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS, OVERHEAD = 4096, 8


def slot_of(key: Column) -> Column:
    """One of SLOTS slots, by the first three hex digits of an MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 3), 16, 10).cast("int")


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, virtual_slot of each row."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(key), (F.octet_length(t) + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), slot_of(F.col(key)).alias("virtual_slot"))


def slot_bytes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def slot_map(slots: DataFrame, shards: int, version: int = 1) -> DataFrame:
    """(version, virtual_slot, shard): heaviest slot first, each to the lightest shard (ties: the lower number)."""
    listed = slots.groupBy().agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("b"), F.col("virtual_slot").alias("s")))).alias("slots"))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast("array<int>").alias("dealt"))

    def deal(state: Column, slot: Column) -> Column:
        at = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int")
        loads = F.transform(state["loads"], lambda x, i: F.when(i == at - 1, x - slot["b"]).otherwise(x))
        return F.struct(loads.alias("loads"), F.concat(state["dealt"], F.array(at - 1)).alias("dealt"))

    dealt = listed.select("slots", F.aggregate("slots", start, deal)["dealt"].alias("dealt"))
    one = dealt.select(F.explode(F.arrays_zip("slots", "dealt")).alias("x"))
    return one.select(F.lit(version).alias("version"), F.col("x.slots.s").alias("virtual_slot"), F.col("x.dealt").alias("shard"))


def grown(mapped: DataFrame, slots: DataFrame, shards: int, more: int = 1) -> DataFrame:
    """The next version of a map for `more` shards more: slots move only into the new ones."""
    w = Window.partitionBy("shard").orderBy("bytes", "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    m = mapped.join(slots, "virtual_slot").withColumn("total", F.sum("bytes").over(Window.partitionBy("version")))
    m = m.withColumn("upto", F.sum("bytes").over(w)).withColumn("moves", F.col("upto") > F.col("total") / (shards + more))
    new = F.pmod(F.hash("virtual_slot"), F.lit(more)) + shards
    return m.select((F.col("version") + 1).alias("version"), "virtual_slot", F.when(F.col("moves"), new).otherwise(F.col("shard")).cast("int").alias("shard"))


def store_map(mapped: DataFrame, path: str) -> None:
    """Appends a version to the stored map."""
    mapped.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    all_ = spark.read.parquet(path)
    if version is None:
        version = all_.agg(F.max("version")).first()[0]
    return all_.where(F.col("version") == version).select("version", "virtual_slot", "shard")


def assign(rows: DataFrame, mapped: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows with shard and slot: the place in the shard, gapless from 0."""
    counts = rows.groupBy("virtual_slot").agg(F.count("*").alias("n")).join(mapped, "virtual_slot")
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("virtual_slot")) - F.col("n")
    bases = counts.select("virtual_slot", "shard", before.alias("base"))
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(F.col(key).asc_nulls_first(), "text_crc32", "size"))
    return rows.withColumn("rank", rank).join(bases, "virtual_slot").withColumn("slot", F.col("base") + F.col("rank") - 1).drop("rank", "base")


def shard_by_bytes(docs: DataFrame, shards: int) -> DataFrame:
    rows = measured(docs)
    return assign(rows, slot_map(slot_bytes(rows), shards).drop("version"))
