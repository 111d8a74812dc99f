"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Each record is hashed into one of thousands of virtual slots. Bytes and rows
are summed by slot, and a map from slots to shards, of a fixed size whatever
the data, is computed from those sums and stored by version. Rebalancing edits
the map: records never change their slot.

The law kept is `bytes`: the shards' sizes are near equal.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.llm._spark import copies, let, materialize, shared_dir

#: Virtual slots: fixed, so the map and the sums by slot have a fixed size.
SLOTS = 4096
MAP_COLUMNS = ("version", "virtual_slot", "shard", "bytes", "rows")
MAP = "virtual_slot int, shard int, bytes long, rows long, version int"


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(8)


def virtual_slot(doc_id: Column, text_hash: Column, copy: Column, slots: int = SLOTS) -> Column:
    """The slot of a record; copy tells equal records apart, so that no slot gathers them."""
    return F.pmod(F.xxhash64(doc_id, text_hash, copy), F.lit(slots)).cast("int")


def slot_records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, copy, virtual_slot of every row of docs(doc_id, text).

    Equal rows (same id and text) are counted before the shuffle and numbered
    as copies 0, 1, ...; each copy gets its own slot, so repeated rows, null
    ids and null texts spread like any other rows. The text is not shuffled.
    """
    slim = docs.select(
        "doc_id", record_size(F.col("text")).alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.crc32(F.lit(b""))).alias("text_crc32"), F.xxhash64("text").alias("text_hash")
    )
    counted = slim.groupBy("doc_id", "size", "text_crc32", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    return copies(counted).select("doc_id", "size", "text_crc32", "text_hash", "copy", virtual_slot(F.col("doc_id"), F.col("text_hash"), F.col("copy"), slots).alias("virtual_slot"))


def slot_sizes(records: DataFrame) -> DataFrame:
    """virtual_slot, bytes, rows: at most as many rows as there are slots."""
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def new_map(sizes: DataFrame, shards: int, version: int = 1) -> DataFrame:
    """The first map: slots by falling bytes, each to the shard that is smallest so far.

    One row for each slot with records. The greedy assignment folds over the
    sorted slots in one row: their number is fixed, not a matter of the data.
    """
    sorted_slots = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("order"), "virtual_slot", "bytes", "rows")))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("load"), F.array().cast("array<int>").alias("shard"))

    def place(acc: Column, s: Column) -> Column:
        return let(
            F.array_position(acc["load"], F.array_min(acc["load"])).cast("int"),
            lambda k: F.struct(
                F.transform(acc["load"], lambda x, i: F.when(i == k - 1, x + s["bytes"]).otherwise(x)).alias("load"),
                F.concat(acc["shard"], F.array(k - 1)).alias("shard"),
            ),
        )

    placed = sizes.agg(sorted_slots.alias("s")).select("s", F.aggregate("s", start, place, lambda acc: acc["shard"]).alias("shard"))
    each = placed.select(F.explode(F.arrays_zip("s", "shard")).alias("x"))
    return each.select(F.lit(version).alias("version"), F.col("x.s.virtual_slot"), F.col("x.shard").alias("shard"), F.col("x.s.bytes").alias("bytes"), F.col("x.s.rows").alias("rows"))


def rebalance(current: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version of a map for new sizes and a number of shards at least as large.

    Each shard keeps its slots, largest first, while they fit its fair share
    of bytes (always its first); what is over, slots not yet mapped and slots
    of shards beyond the number are dealt anew to the smallest shards. A map
    of a fixed number of rows, so windows over one shard's slots are small.
    """
    known = sizes.join(F.broadcast(current.select("virtual_slot", F.col("shard").alias("was"), "version")), "virtual_slot", "left")
    fair = sizes.agg((F.sum("bytes") / F.lit(shards)).alias("fair"))
    upto = F.sum("bytes").over(Window.partitionBy("was").orderBy(F.col("bytes").desc(), "virtual_slot"))
    kept = known.crossJoin(F.broadcast(fair)).withColumn("stays", F.col("was").isNotNull() & (F.col("was") < shards) & ((upto <= F.col("fair")) | (upto == F.col("bytes"))))
    sums = F.sum(F.when(F.col("stays"), F.col("bytes")).otherwise(0))
    load = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda k: F.coalesce(F.element_at("sums", k), F.lit(0).cast("long")))
    by_shard = kept.filter("stays").groupBy("was").agg(sums.alias("b")).agg(F.map_from_entries(F.collect_list(F.struct("was", "b"))).alias("sums"))
    entry = F.struct((-F.col("bytes")).alias("order"), "virtual_slot", "bytes", "rows")
    one = kept.filter("not stays").agg(F.array_sort(F.collect_list(entry)).alias("s")).crossJoin(by_shard).select("s", load.alias("load"))

    def place(acc: Column, s: Column) -> Column:
        return let(
            F.array_position(acc["load"], F.array_min(acc["load"])).cast("int"),
            lambda k: F.struct(F.transform(acc["load"], lambda x, i: F.when(i == k - 1, x + s["bytes"]).otherwise(x)).alias("load"), F.concat(acc["shard"], F.array(k - 1)).alias("shard")),
        )

    moved = one.select("s", F.aggregate("s", F.struct("load", F.array().cast("array<int>").alias("shard")), place, lambda acc: acc["shard"]).alias("shard")).select(F.explode(F.arrays_zip("s", "shard")).alias("x"))
    version = current.agg((F.max("version") + 1).alias("version"))
    rows = kept.filter("stays").select("virtual_slot", F.col("was").alias("shard"), "bytes", "rows").unionByName(
        moved.select(F.col("x.s.virtual_slot").alias("virtual_slot"), F.col("x.shard").alias("shard"), F.col("x.s.bytes").alias("bytes"), F.col("x.s.rows").alias("rows"))
    )
    return rows.crossJoin(F.broadcast(version)).select(*MAP_COLUMNS)


def save_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to the stored maps; one that is there already is refused, so maps are never overwritten or doubled."""
    try:
        stored = slot_map.sparkSession.read.schema(MAP).parquet(path).select("version").distinct()
    except AnalysisException:  # nothing is stored yet
        stored = None
    if stored is not None and slot_map.join(F.broadcast(stored), "version", "left_semi").limit(1).count():
        raise ValueError(f"{path} holds this version of the map already")
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, the latest by default."""
    stored = spark.read.schema(MAP).parquet(path)
    latest = stored.agg(F.max("version").alias("v"))
    return stored.filter(F.col("version") == version) if version is not None else stored.join(F.broadcast(latest), stored.version == latest.v, "left_semi")


def assign(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """records with shard, and slot: the place within the shard, gapless from 0.

    The place is the number of records in the shard's earlier virtual slots,
    a prefix sum over the map, plus the rank within the virtual slot. So the
    ranks run over thousands of even groups, not over a few shards. The map
    has a fixed number of rows and is broadcast.
    """
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1))
    offsets = slot_map.select("virtual_slot", "shard", "version", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_hash", "copy"))
    return records.withColumn("rank", rank).join(F.broadcast(offsets), "virtual_slot").withColumn("slot", F.col("before") + F.col("rank") - 1)


def shard_documents(docs: DataFrame, shards: int = 24, slots: int = SLOTS, maps: str | None = None) -> DataFrame:
    """Every row of docs(doc_id, text) with its shard, by a map stored in the folder maps (one of its own by default).

    Without a stored map, the first version is made of the sizes by slot; with
    one, the latest is edited for the new sizes. The version is stored, and
    records are assigned from what is stored. Returns doc_id, size, text_crc32,
    law, shard, slot, grown_shard (null under this law), virtual_slot,
    map_version. Null texts have size 8 and the CRC of the empty text; null ids
    and repeated rows are dealt like others; texts of any length are read once;
    an empty table gives no rows; other columns of docs are ignored.
    """
    spark = docs.sparkSession
    records = materialize(slot_records(docs, slots), "shard-records")
    sizes = slot_sizes(records)
    version = 1
    if maps is None:
        maps = f"{shared_dir(spark)}/slot-maps-{uuid.uuid4().hex}"
        save_map(new_map(sizes, shards, version), maps)
    else:
        current = load_map(spark, maps)
        version = current.agg(F.max("version")).first()[0] + 1
        save_map(rebalance(current, sizes, shards), maps)
    return assign(records, load_map(spark, maps, version)).select(
        "doc_id",
        "size",
        F.col("text_crc32").cast("long").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.col("version").cast("int").alias("map_version"),
    )
