"""Sharding by fixed virtual slots, with DataFrame and SQL functions only.

Records are hashed by their text into a fixed number of virtual slots, so equal texts share a slot. A versioned map sends every slot to a
shard; it begins with slot modulo shards, is stored, and is edited when bytes per slot have been counted: slots stay where
they are while their shard holds no more than a fair share, and only what is over moves.

A group of equal texts that alone holds as much as several slots is taken out of its slot and has a map entry of its own; so it never drags
small texts along. Only a group over a whole shard's fair share is cut (by the id's hash, into parts of about a slot's mean size): no shard
could hold it whole. All other groups of equal texts stay in one shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyledger.llm.shared import scratch_path, staged

SLOTS = 4096
#: A group of equal texts with more bytes than this many slots have on average has a map entry of its own (at most SLOTS / LARGE groups).
LARGE = 8
#: Items of a map that are dealt out in one step of the fold; about the root of the greatest number of entries.
STEP = 96
#: The law that the query keeps: shard sizes in bytes are near equal.
LAW = "bytes"
#: What names an entry of the map: the slot, the group of equal texts (0: all others of the slot) and its part (-1: uncut).
UNIT = ["vslot", "text_key", "part"]


def slot_rows(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, hash (of the text), vslot. Null texts count as empty; null ids are allowed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("hash"), F.pmod(F.xxhash64(text), F.lit(slots)).cast("int").alias("vslot"),
    )


def large_groups(rows: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """(hash, parts) of the large groups of equal texts, at most slots / LARGE; parts is 0 for a group that a shard can hold.

    Bytes per slot tell where large groups can be; only the rows of those slots are summed by text.
    """
    by_slot = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"))
    total = by_slot.agg(F.sum("bytes")).first()[0] or 0  # of at most `slots` rows
    full = by_slot.where(F.col("bytes") * slots > total * LARGE).select("vslot")
    groups = rows.join(F.broadcast(full), "vslot", "left_semi").groupBy("hash").agg(F.sum("size").alias("bytes"))
    parts = F.when(F.col("bytes") * shards > total, F.ceil(F.col("bytes") * slots / total)).otherwise(0).cast("int")
    return groups.where(F.col("bytes") * slots > total * LARGE).select("hash", parts.alias("parts"))


def in_units(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows with their map entry: text_key and part beside vslot."""
    found = rows.join(F.broadcast(groups), "hash", "left")  # at most slots / LARGE groups
    cut = F.when(F.col("parts") > 0, F.pmod(F.xxhash64("doc_id", F.lit("part")), F.col("parts"))).otherwise(F.lit(-1)).cast("int")
    return found.withColumn("text_key", F.when(F.col("parts").isNotNull(), F.col("hash")).otherwise(F.lit(0).cast("long"))).withColumn("part", cut).drop("parts", "hash")


def unit_stats(rows: DataFrame) -> DataFrame:
    """Bytes and rows per entry, summed map-side first: at most slots + slots / LARGE entries and slots + slots / LARGE parts."""
    return rows.groupBy(*UNIT).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1 of the map, before anything is counted: (version, vslot, text_key, part, shard)."""
    slot = F.col("id").cast("int")
    return spark.range(slots).select(F.lit(1).alias("version"), slot.alias("vslot"), F.lit(0).cast("long").alias("text_key"), F.lit(-1).alias("part"), (slot % shards).alias("shard"))


def _least_loaded(items: Column, loads: Column) -> Column:
    """The shards of items (largest first): each goes to the least loaded one. A fold over runs of STEP items, so that no long array is copied at each."""
    least = lambda now: F.array_position(now, F.array_min(now)).cast("int") - 1

    def put(acc: Column, item: Column) -> Column:
        to = least(acc["loads"])
        loaded = F.transform(acc["loads"], lambda x, i: F.when(i == to, x + item["bytes"]).otherwise(x))
        return F.struct(loaded.alias("loads"), F.concat(acc["to"], F.array(to)).alias("to"))

    def run(acc: Column, part: Column) -> Column:
        dealt = F.aggregate(part, F.struct(acc["loads"].alias("loads"), F.array().cast("array<int>").alias("to")), put)
        return F.transform(F.array(dealt), lambda d: F.struct(d["loads"].alias("loads"), F.concat(acc["runs"], F.array(d["to"])).alias("runs")))[0]

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / STEP).cast("int")), lambda i: F.slice(items, i * STEP + 1, STEP))
    start = F.struct(loads.alias("loads"), F.array().cast("array<array<int>>").alias("runs"))
    return F.when(F.size(items) > 0, F.flatten(F.aggregate(parts, start, run)["runs"])).otherwise(F.array().cast("array<int>"))


def edited_map(old: DataFrame, stats: DataFrame, shards: int) -> DataFrame:
    """The next version of a map for counted bytes or another number of shards.

    An entry stays while its shard, filled in the order of a hash, holds no more than a fair share; what is over goes, largest first, to the
    least loaded shards. A large group that the old map lacks begins in its slot's shard. Entries without bytes stay where they are, or
    leave if they are of a group or their shard is gone.
    """
    version = F.coalesce(old.agg(F.max("version")).select("max(version)").scalar(), F.lit(0)) + 1
    slot_of = old.where("part = -1 AND text_key = 0").select("vslot", F.col("shard").alias("slot_shard"))
    exact = old.select(*UNIT, F.col("shard").alias("old_shard"))
    fair = stats.agg((F.sum("bytes") / shards).alias("fair"))
    filled = Window.partitionBy("was").orderBy(F.xxhash64(*UNIT), *UNIT).rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        stats.select(*UNIT, "bytes").join(exact, UNIT, "left").join(slot_of, "vslot", "left").withColumn("was", F.coalesce("old_shard", "slot_shard"))
        .withColumn("upto", F.sum("bytes").over(filled)).crossJoin(F.broadcast(fair))  # one row
        .withColumn("stays", F.coalesce((F.col("was") < shards) & (F.col("upto") <= F.col("fair")), F.lit(False)))
    )
    placed = staged(placed, "shard-placed")
    kept = placed.where("stays").select(*UNIT, F.col("was").alias("shard"), "bytes")
    held = kept.groupBy("shard").agg(F.sum("bytes").alias("load")).agg(F.map_from_entries(F.collect_list(F.struct("shard", "load"))).alias("held"))
    loads = held.select(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.coalesce(F.try_element_at("held", s), F.lit(0).cast("long"))).alias("loads"))
    free = placed.where(~F.col("stays")).agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), *UNIT))).alias("items"))
    items = F.transform("items", lambda x: F.struct(*(x[c].alias(c) for c in UNIT), (-x["less"]).alias("bytes")))
    dealt = free.select(items.alias("items")).crossJoin(loads).select("items", _least_loaded(F.col("items"), F.col("loads")).alias("to"))
    moved = dealt.select(F.explode(F.arrays_zip("items", "to")).alias("x")).select(*(F.col(f"x.items.{c}").alias(c) for c in UNIT), F.col("x.to").alias("shard"))
    unused = old.where((F.col("part") == -1) & (F.col("text_key") == 0) & (F.col("shard") < shards)).join(stats.select(*UNIT), UNIT, "left_anti").select(*UNIT, "shard")
    return kept.drop("bytes").unionByName(moved).unionByName(unused).select(version.cast("int").alias("version"), *UNIT, F.col("shard").cast("int").alias("shard"))


def write_map(slot_map: DataFrame, path: str) -> None:
    """Append the map's version to a Parquet table that keeps all versions."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, the latest if none is named."""
    stored = spark.read.parquet(path)
    wanted = F.lit(version) if version is not None else stored.agg(F.max("version").alias("v")).select("v").scalar()
    return stored.where(F.col("version") == wanted)


def shard_documents(docs: DataFrame, shards: int = 16, slots: int = SLOTS, map_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its shard and its place in the shard, by the latest map under map_path, edited for these documents.

    Returns doc_id, size, text_crc32, law, shard, slot (place in the shard, gapless from 0), grown_shard (null: law ``bytes`` has none),
    virtual_slot, map_version. Without a stored map one is begun (in scratch if no path is named); the edit is stored as its next version.
    Null and empty texts are one group of equal texts; very long ones are sized by their bytes alone. Null ids are allowed. Repeated rows and
    ties each get a place of their own. An empty table gives no rows and a map without groups. Other columns of the table do not matter.
    """
    spark = docs.sparkSession
    path = map_path or scratch_path(spark, "shard-map")
    rows = staged(slot_rows(docs, slots, id_col, text_col), "shard-rows")
    rows = in_units(rows, staged(large_groups(rows, shards, slots), "shard-groups"))
    stats = staged(unit_stats(rows), "shard-units")
    if map_path is None or not _stored(spark, path):
        write_map(first_map(spark, shards, slots), path)
    write_map(staged(edited_map(read_map(spark, path), stats, shards), "shard-edit"), path)
    now = read_map(spark, path)
    before = Window.partitionBy("shard").orderBy(*UNIT).rowsBetween(Window.unboundedPreceding, -1)  # of the map's entries
    places = stats.select(*UNIT, "n").join(now, UNIT).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).select(*UNIT, "shard", "offset", F.col("version").alias("map_version"))
    in_unit = Window.partitionBy(*UNIT).orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("nth", F.row_number().over(in_unit)).join(F.broadcast(places), UNIT)  # at most 2 * (slots + slots / LARGE) entries
        .select(
            "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("offset") + F.col("nth") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"), "map_version",
        )
    )


def _stored(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
