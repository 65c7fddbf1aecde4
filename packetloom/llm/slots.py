"""Sharding over fixed virtual slots.

A document's id, size and checksum are hashed to one of SLOTS slots; that never changes. A small versioned table maps slots to shards: version
1 deals the slots round, and each rebalancing reads the bytes of every slot and writes the next version, in which overfull
shards give slots away to the emptiest ones; all other slots stay where they are. Everything here is DataFrame functions;
the tables of slots have SLOTS rows whatever the input.

A null text has no bytes and the checksum of the empty string. A null id is hashed like a value, with its text. Rows that repeat
(doc_id, text) are counted first and dealt to slots in parts of at most PART copies, each with its own place in the shard, so
no id, text or row weighs on one slot, however often it comes. An empty table has an empty
result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from packetloom.session import materialise

SLOTS = 4096
PART = 64


def slot_of(*key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*key, F.lit("slot")), F.lit(slots)).cast("int")


def measured(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, part, virtual_slot, copies): equal rows are counted before the shuffle."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"))
    counted = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    parts = counted.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {PART}"))))
    copies = F.least(F.lit(PART).cast("long"), F.col("n") - F.col("part") * PART)
    return parts.select("doc_id", "size", "text_crc32", copies.alias("copies"), "part").withColumn(
        "virtual_slot", slot_of(*map(F.col, ("doc_id", "size", "text_crc32", "part")), slots=slots))


def slot_bytes(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(virtual_slot, bytes) of every slot, empty ones too."""
    used = rows.groupBy("virtual_slot").agg(F.sum(F.col("size") * F.col("copies")).alias("used"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(used, "virtual_slot", "left").select("virtual_slot", F.coalesce("used", F.lit(0)).alias("bytes"))


def first_map(spark, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1: (version, virtual_slot, shard), slots dealt round."""
    return spark.range(slots).select(
        F.lit(1).alias("version"), F.col("id").cast("int").alias("virtual_slot"), (F.col("id") % shards).cast("int").alias("shard"))


def rebalance(current: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version of a map for `shards` shards.

    A shard keeps its largest slots as far as they fit its equal share of the bytes; the others, and those of shards that
    no longer exist, go, largest first, each to the shard that holds the least so far. The fold runs over one row with at
    most SLOTS entries and a load per shard.
    """
    known = current.join(sizes, "virtual_slot")
    share = (sizes.agg(F.sum("bytes")).first()[0] or 0) / shards
    order = [F.desc("bytes"), F.col("virtual_slot")]
    filled = F.sum("bytes").over(W.partitionBy("shard").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    marked = known.withColumn("stays", (filled <= F.lit(share)) & (F.col("shard") < shards))
    loads = F.array(*[F.coalesce(F.sum(F.when(F.col("stays") & (F.col("shard") == k), F.col("bytes"))), F.lit(0)).cast("long")
                      for k in range(shards)])
    free = F.array_sort(F.collect_list(F.when(~F.col("stays"), F.struct(
        (-F.col("bytes")).alias("less"), F.col("virtual_slot").alias("virtual_slot")))))
    start = marked.agg(loads.alias("loads"), free.alias("free"))

    def give(state, slot):
        shard = (F.array_position(state.loads, F.array_min(state.loads)) - 1).cast("int")
        return F.struct(
            F.transform(state.loads, lambda x, k: F.when(k == shard, x - slot.less).otherwise(x)).alias("loads"),
            F.concat(state.given, F.array(shard)).alias("given"))

    dealt = start.select("free", F.aggregate(
        "free", F.struct(F.col("loads"), F.array().cast("array<int>").alias("given")), give, lambda s: s.given).alias("given"))
    moved = dealt.select(F.explode(F.arrays_zip(F.col("free.virtual_slot").alias("virtual_slot"), F.col("given").alias("to"))).alias("m")).select(
        "m.virtual_slot", F.col("m.to").alias("to"))
    return marked.join(moved, "virtual_slot", "left").select(
        (F.col("version") + 1).alias("version"), "virtual_slot", F.coalesce("to", "shard").alias("shard"))


def store_map(slot_map: DataFrame, path: str) -> None:
    """Adds a version to the stored maps; earlier versions stay readable."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark, path: str, version: int | None = None) -> DataFrame:
    """The given version of the stored maps, by default the newest."""
    maps = spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    return maps.filter(F.col("version") == version).select("version", "virtual_slot", "shard")


def place(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Adds shard and slot, the gapless place in the shard, to measured rows and repeats counted rows.

    A shard's places are dealt to its virtual slots first, so no task has to number a whole shard."""
    counted = rows.groupBy("virtual_slot").agg(F.sum("copies").alias("n")).join(slot_map.drop("version"), "virtual_slot")
    earlier = W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1)
    base = counted.select("virtual_slot", "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inner = W.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32", "part").rowsBetween(W.unboundedPreceding, -1)
    own = rows.withColumn("before", F.coalesce(F.sum("copies").over(inner), F.lit(0))).join(base, "virtual_slot")
    return own.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).select(
        "doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("base") + F.col("before") + F.col("copy")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int, map_path: str, slots: int = SLOTS) -> DataFrame:
    """Rows with shard and slot by the newest map: the first map, once rebalanced by these rows, in a new store."""
    spark = docs.sparkSession
    rows = materialise(measured(docs, slots), "measured")
    store_map(first_map(spark, shards, slots), map_path)
    store_map(rebalance(load_map(spark, map_path), slot_bytes(rows, slots), shards), map_path)
    return place(rows, load_map(spark, map_path))
