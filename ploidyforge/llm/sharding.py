"""Shards by fixed virtual slots and a versioned slot-to-shard map. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, quoted, staged, table

#: Virtual slots; fixed for the life of a data set. The map has a row for each, so it may be broadcast.
SLOTS = 4096
SHARDS = 16
#: Copies of a record that are numbered in one array.
BLOCK = 10_000


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _facts(docs: DataFrame, slots: int) -> list[Column]:
    """doc_id, size, text_crc32 and the virtual slot of a row, from the row alone."""
    doc_id, size, crc = F.col("doc_id").cast("long"), (F.octet_length(_text()) + 1).cast("long"), F.crc32(_text().cast("binary"))
    return [doc_id.alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), F.pmod(F.xxhash64(doc_id, size, crc), F.lit(slots)).cast("int").alias("virtual")]


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual, n: one row for all rows equal in these, n of them."""
    return docs.select(*_facts(docs, slots)).groupBy("doc_id", "size", "text_crc32", "virtual").agg(F.count("*").alias("n"))


def slot_loads(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """virtual, bytes, n of every slot, empty ones included, from records()."""
    summed = rows.groupBy("virtual").agg(F.sum(F.col("size") * F.col("n")).alias("bytes"), F.sum("n").alias("n"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual"))
    return every.join(summed, "virtual", "left").select("virtual", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("n", F.lit(0)).alias("n"))


def first_map(spark: SparkSession, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """virtual, shard: slots dealt in turn, as long as nothing is known of their bytes."""
    return spark.range(slots).select(F.col("id").cast("int").alias("virtual"), (F.col("id") % shards).cast("int").alias("shard"))


def _split(mapped: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """virtual, shard, bytes, stays: a shard keeps its largest slots up to an equal share of all bytes, and one at least."""
    all_slots, down = Window.partitionBy(), Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual")
    known = mapped.join(F.broadcast(loads.select("virtual", "bytes")), "virtual")  # a row a slot on both sides
    share = F.ceil(F.sum("bytes").over(all_slots) / shards)
    return known.withColumn("stays", (F.sum("bytes").over(down.rowsBetween(Window.unboundedPreceding, 0)) <= share) | (F.row_number().over(down) == 1))


def rebalanced(mapped: DataFrame, loads: DataFrame, shards: int = SHARDS) -> DataFrame:
    """virtual, shard: mapped (virtual, shard) edited so that shards have near equal bytes.

    Slots beyond a shard's equal share, its smallest ones, are given up; the largest of them goes to the shard with least
    bytes (the smallest number on ties), then the next. All others stay where they are. Works on one row a slot only."""
    split = _split(mapped, loads, shards)
    loads_of = [F.coalesce(F.sum(F.when(F.col("stays") & (F.col("shard") == k), F.col("bytes"))), F.lit(0)).cast("long") for k in range(shards)]
    released = F.when(~F.col("stays"), F.struct((-F.col("bytes")).alias("less"), "virtual"))  # collect_list leaves nulls out
    both = split.agg(F.array(*loads_of).alias("start"), F.array_sort(F.collect_list(released)).alias("moved"))

    def put(state: Column, slot: Column) -> Column:
        at = (F.array_position(state["loads"], F.array_min(state["loads"])) - 1).cast("int")
        loads_ = F.transform(state["loads"], lambda x, k: x - F.when(k == at, slot["less"]).otherwise(F.lit(0).cast("long")))
        return F.struct(loads_.alias("loads"), F.concat(state["placed"], F.array(F.struct(slot["virtual"].alias("virtual"), at.alias("shard")))).alias("placed"))

    none = F.from_json(F.lit("[]"), "array<struct<virtual:int,shard:int>>")
    placed = F.aggregate("moved", F.struct(F.col("start").alias("loads"), none.alias("placed")), put, lambda s: s["placed"])
    new = both.select(F.explode(placed).alias("p")).select("p.virtual", "p.shard")
    return split.where("stays").select("virtual", "shard").union(new)


def grown(mapped: DataFrame, loads: DataFrame, shards: int = SHARDS) -> DataFrame:
    """virtual, shard: mapped, of as many shards, with one more. Only the new one gets slots: each shard's smallest,
    beyond an equal share of all bytes among the larger number."""
    split = _split(mapped, loads, shards + 1)
    return split.select("virtual", F.when(F.col("stays"), F.col("shard")).otherwise(shards).cast("int").alias("shard"))


@dataclass
class SlotMaps:
    """Versions of a slot-to-shard map in a shared folder; a version is never changed once it is there."""

    spark: SparkSession
    path: str
    slots: int = SLOTS

    def publish(self, mapped: DataFrame, version: int) -> DataFrame:
        """Write a version, which must be new, and reread it."""
        mapped.select("virtual", "shard").coalesce(1).write.mode("error").parquet(f"{self.path}/version={version}")
        return self.at(version)

    def at(self, version: int) -> DataFrame:
        return self.spark.read.schema("virtual int, shard int").parquet(f"{self.path}/version={version}")

    def versions(self) -> list[int]:
        """Whole versions in ascending order: one that was cut off while it was written doesn't count."""
        every = self.spark.read.option("basePath", self.path).schema("virtual int, shard int, version int").parquet(self.path)
        return [r["version"] for r in every.groupBy("version").count().where(F.col("count") == self.slots).orderBy("version").collect()]

    def latest(self) -> DataFrame:
        return self.at(self.versions()[-1])


def places(rows: DataFrame, loads: DataFrame, mapped: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, virtual, shard, slot of every row: slot is its place in its shard, gapless from 0.

    Slots of a shard follow one another by number, rows of a slot by doc_id, size and checksum. A place is the rows of
    the slots before (a sum over the map) and of the records before in the slot, so no task holds a shard. Rows that are
    equal in all are counted first and numbered at last, in blocks."""
    before = Window.partitionBy("shard").orderBy("virtual").rowsBetween(Window.unboundedPreceding, -1)
    starts = mapped.join(F.broadcast(loads.select("virtual", "n")), "virtual").select("virtual", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("virtual").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("above", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    joined = ranked.join(F.broadcast(starts), "virtual")  # one row a virtual slot
    blocks = joined.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(BLOCK).cast("long"))))
    copy = F.explode(F.sequence(F.col("block"), F.least(F.col("n"), F.col("block") + BLOCK) - 1))
    return blocks.select("doc_id", "size", "text_crc32", "virtual", "shard", (F.col("start") + F.col("above")).alias("first"), copy.alias("copy")).select("doc_id", "size", "text_crc32", "virtual", "shard", (F.col("first") + F.col("copy")).alias("slot"))


def sharded(docs: DataFrame, path: str, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual, shard, slot of every row of docs (doc_id, text), under the law of near equal bytes.

    size is the UTF-8 bytes of the text (null: none) plus 1. A row's virtual slot is a hash of doc_id, size and checksum;
    version 1 of the map deals slots in turn, version 2 is that map edited by the bytes of the slots. Both stay at path, a new
    folder. A null text counts as empty; rows with a null doc_id are dealt by their texts; equal texts with
    different ids are spread over slots; rows equal in id and text share a slot, and only these can make one heavy;
    very long texts count by their bytes; an empty table gives a map and no rows; other columns are not read."""
    spark = docs.sparkSession
    rows = staged(records(docs, slots), "records")
    loads = staged(slot_loads(rows, slots), "slot_loads")
    maps = SlotMaps(spark, path, slots)
    first = maps.publish(first_map(spark, shards, slots), 1)
    return places(rows, loads, maps.publish(rebalanced(first, loads, shards), 2))


def write_shards(docs: DataFrame, mapped: DataFrame, path: str, files: int = 8, slots: int = SLOTS) -> None:
    """All rows and columns of docs below path, in a folder shard=k for each shard, in some files each.

    A row's shard comes from its own slot and the broadcast map; rows are moved once, by shard and part of its slots. A
    column named shard is replaced."""
    virtual = next(c for c in _facts(docs, slots)[3:])
    kept = [c for c in docs.columns if c.lower() != "shard"]
    named = docs.select(*quoted(kept), virtual.alias("_virtual_slot_"))
    dealt = named.join(F.broadcast(mapped.select(F.col("virtual").alias("_virtual_slot_"), "shard")), "_virtual_slot_")
    part = F.pmod(F.xxhash64("_virtual_slot_"), F.lit(files))
    n = max(files, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt.repartition(n, "shard", part).drop("_virtual_slot_").write.partitionBy("shard").parquet(path)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharded(table(spark, sf_dir, "documents"), fresh_path(spark, "slot_map"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual")
