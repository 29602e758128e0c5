"""Sharding over fixed virtual slots.

Every record is hashed into one of a fixed number of slots. The bytes of each slot are summed, and a small, stored and
versioned table says which shard holds each slot: version 1 deals the slots out by number, and every rebalancing edits
the version before it and stores the next. Records never change slot.

The slot table has `n_slots` rows whatever the input, so it may be gathered in one row and broadcast. Records take their
place in a shard by ranks inside groups of a slot, whose number follows from the records, so no task ranks more than about
GROUP_ROWS of them.

Nulls: a null text has no bytes; a null doc_id is a value of its own. Repeated rows share a slot and are told apart by
their place alone; ties go by doc_id, checksum and size. Of a very long text only its size, hash and checksum are moved. An
empty table gives an empty result. Columns other than the named ones are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .kernels import stored, table

N_SLOTS = 4096
ROW_BYTES = 8
GROUP_ROWS = 200_000
BROADCAST_ROWS = 1_000_000


def slot_of(*cols: str, n_slots: int = N_SLOTS) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n_slots)).cast("int")


def slot_sizes(records: DataFrame, slot: str = "virtual_slot", size: str = "size") -> DataFrame:
    """Bytes and records of each slot."""
    return records.groupBy(slot).agg(F.sum(size).cast("long").alias("slot_bytes"), F.count("*").alias("slot_rows"))


def first_map(spark: SparkSession, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """Version 1 of the map: slots by their number, before any sizes are known."""
    return spark.range(n_slots).select(F.lit(1).alias("version"), F.col("id").cast("int").alias("virtual_slot"), F.pmod("id", F.lit(n_shards)).cast("int").alias("shard"))


def rebalanced(slot_map: DataFrame, sizes: DataFrame, n_shards: int) -> DataFrame:
    """The next version of the map, of near equal bytes.

    A shard keeps its largest slots up to the mean; the others are dealt out, the largest first, each to the shard that is
    lightest so far. That fold runs over an array of at most n_slots entries.
    """
    m = slot_map.join(F.broadcast(sizes.select("virtual_slot", "slot_bytes")), "virtual_slot", "left").withColumn("slot_bytes", F.coalesce("slot_bytes", F.lit(0)))
    w = Window.partitionBy("shard").orderBy(F.col("slot_bytes").desc(), "virtual_slot")
    mean = F.sum("slot_bytes").over(Window.partitionBy("version")) / n_shards
    m = m.withColumn("stays", F.sum("slot_bytes").over(w) <= mean)
    entry = F.struct("slot_bytes", "virtual_slot", "shard")
    ordered = m.groupBy("version").agg(F.sort_array(F.collect_list(F.when(~F.col("stays"), entry)), asc=False).alias("s"), F.collect_list(F.when(F.col("stays"), entry)).alias("kept"))
    none = F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda _: F.lit(0).cast("long"))
    loads = F.aggregate("kept", none, lambda acc, x: F.transform(acc, lambda v, i: F.when(i == x["shard"], v + x["slot_bytes"]).otherwise(v)))
    start = F.struct(loads.alias("load"), F.array().cast("array<int>").alias("shard"))

    def put(acc: Column, x: Column) -> Column:
        k = (F.array_position(acc["load"], F.array_min(acc["load"])) - 1).cast("int")
        load = F.transform(acc["load"], lambda v, i: F.when(i == k, v + x["slot_bytes"]).otherwise(v))
        return F.struct(load.alias("load"), F.concat(acc["shard"], F.array(k)).alias("shard"))

    to = ordered.select("version", "kept", "s", F.aggregate("s", start, put)["shard"].alias("to"))
    moved = F.zip_with("s", "to", lambda x, k: F.struct(x["virtual_slot"].alias("virtual_slot"), k.alias("shard")))
    every = F.concat(F.transform("kept", lambda x: F.struct(x["virtual_slot"].alias("virtual_slot"), x["shard"].alias("shard"))), moved)
    return to.select((F.col("version") + 1).alias("version"), F.explode(every).alias("p")).select("version", "p.virtual_slot", "p.shard")


def add_shard(slot_map: DataFrame, sizes: DataFrame, n_shards: int) -> DataFrame:
    """The next version of the map, with shard `n_shards` beside 0 .. n_shards - 1.

    Each old shard hands over the slots at the end of its list that lie beyond its share of the new mean; no
    slot moves between old shards.
    """
    m = slot_map.join(F.broadcast(sizes), "virtual_slot")
    w = Window.partitionBy("shard").orderBy(F.col("slot_bytes").desc(), "virtual_slot")
    total = F.sum("slot_bytes").over(Window.partitionBy("version"))
    m = m.withColumn("before", F.sum("slot_bytes").over(w) - F.col("slot_bytes")).withColumn("share", total / (n_shards + 1))
    return m.select(
        (F.col("version") + 1).alias("version"),
        "virtual_slot",
        F.when(F.col("before") >= F.col("share"), F.lit(n_shards)).otherwise(F.col("shard")).cast("int").alias("shard"),
    )


def sharded(docs: DataFrame, n_shards: int = 24, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard, version of the map, and slot: the record's place in its shard, gapless from 0."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    records = docs.select(
        "doc_id",
        (F.octet_length(raw).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(raw).alias("text_crc32"),
        slot_of("doc_id", "text", n_slots=n_slots).alias("virtual_slot"),
        F.xxhash64("doc_id", "text", F.lit(1)).alias("part"),
    )
    sizes = stored(slot_sizes(records))
    n_parts = (sizes.agg(F.sum("slot_rows")).first()[0] or 0) // (n_slots * GROUP_ROWS) + 1
    slot_map = stored(rebalanced(stored(first_map(docs.sparkSession, n_shards, n_slots)), sizes, n_shards))
    records = records.withColumn("part", F.pmod("part", F.lit(n_parts)).cast("int"))
    counts = records.groupBy("virtual_slot", "part").agg(F.count("*").alias("n_part"))
    w = Window.partitionBy("shard").orderBy("virtual_slot", "part")
    placed = counts.join(F.broadcast(slot_map), "virtual_slot").select("virtual_slot", "part", "shard", "version", (F.sum("n_part").over(w) - F.col("n_part")).cast("long").alias("base"))
    if n_slots * n_parts <= BROADCAST_ROWS:
        placed = F.broadcast(placed)
    inside = Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size")
    return (
        records.withColumn("n", F.row_number().over(inside).cast("long"))
        .join(placed, ["virtual_slot", "part"])
        .select("doc_id", "size", "text_crc32", "virtual_slot", "shard", "version", (F.col("base") + F.col("n") - 1).alias("slot"))
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    out = sharded(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version")
    )
