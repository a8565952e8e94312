"""Sharding by fixed virtual slots and a versioned slot-to-shard map."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 4096
CUTS = 16  # pieces of a slot that are numbered by themselves


def slots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with vslot (0..SLOTS-1), vcut (0..CUTS-1), size (UTF-8 bytes of the text, null: none,
    plus 1) and text_crc32.

    The slot is a hash of id and text, so neither a hot id nor a group of equal texts fills one:
    equal texts of unlike ids are not kept together, as a group that holds a third of all bytes
    could not be, if shards are to be equal. Rows that repeat both id and text add the number of
    their place in the input to the hash and spread too; they alone depend on that place, so
    write the result before it is used twice. Slot columns of docs are replaced.
    """
    text = F.coalesce(F.encode(F.col(text_col).cast("string"), "utf-8"), F.lit(b"").cast("binary"))
    rows = docs.drop("vslot", "vcut").withColumns({"_k": F.xxhash64(F.lit("slot"), id_col, text_col), "_at": F.monotonically_increasing_id(), "size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text)})
    again = rows.groupBy("_k").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_k", F.lit(True).alias("_again"))
    rows = rows.join(again, "_k", "left").withColumn("_k", F.when(F.col("_again"), F.xxhash64("_k", "_at")).otherwise(F.col("_k")))
    spread = {"vslot": F.pmod("_k", F.lit(SLOTS)).cast("int"), "vcut": F.pmod(F.shiftright("_k", 32), F.lit(CUTS)).cast("int")}
    return rows.withColumns(spread).drop("_k", "_at", "_again")


def slot_loads(slotted: DataFrame) -> list[tuple[int, int]]:
    """(slot, bytes): at most SLOTS rows, whatever the table."""
    return [(r[0], r[1]) for r in slotted.groupBy("vslot").agg(F.sum("size").alias("bytes")).collect()]


@dataclass(frozen=True)
class SlotMap:
    """One version of the map. ``edits`` are the slots this version moved."""

    version: int
    shards: int
    shard_of: tuple[int, ...]
    edits: tuple[int, ...] = ()

    @staticmethod
    def fresh(loads: list[tuple[int, int]], shards: int) -> SlotMap:
        """Slots by falling bytes, each to the lightest shard; slots without rows in turn."""
        out, full = [s % shards for s in range(SLOTS)], [0] * shards
        for slot, size in sorted(loads, key=lambda x: (-x[1], x[0])):
            out[slot] = min(range(shards), key=lambda k: (full[k], k))
            full[out[slot]] += size
        return SlotMap(1, shards, tuple(out))

    def totals(self, loads: list[tuple[int, int]], shards: int | None = None) -> list[int]:
        full = [0] * (shards or self.shards)
        for slot, size in loads:
            full[self.shard_of[slot]] += size
        return full

    def rebalanced(self, loads: list[tuple[int, int]], shards: int | None = None) -> SlotMap:
        """The next version, for as many shards or more. Only slots of shards above the mean
        move, the largest that fits first, and only to shards below it: new shards fill, and
        what stays in place is not rewritten."""
        shards = shards or self.shards
        if shards < self.shards:
            raise ValueError("a map can grow only; build a fresh one for fewer shards")
        out, size_of = list(self.shard_of), dict(loads)
        full = self.totals(loads, shards)
        mean, moved = sum(full) / shards, []
        for slot in sorted(size_of, key=lambda s: (-size_of[s], s)):
            low = min(range(shards), key=lambda k: (full[k], k))
            here, size = out[slot], size_of[slot]
            if here != low and full[here] - size >= mean - size / 2 and full[low] + size <= mean + size / 2:
                full[here] -= size
                full[low] += size
                out[slot] = low
                moved.append(slot)
        return SlotMap(self.version + 1, shards, tuple(out), tuple(moved))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.shard_of)), "vslot int, shard int")

    def save(self, spark: SparkSession, folder: str) -> None:
        """Add this version under ``folder``; earlier versions stay readable."""
        one = [(self.version, self.shards, json.dumps(self.shard_of), json.dumps(self.edits))]
        spark.createDataFrame(one, "version int, shards int, shard_of string, edits string").coalesce(1).write.parquet(f"{folder}/v{self.version:06d}")

    @staticmethod
    def load(spark: SparkSession, folder: str, version: int | None = None) -> SlotMap:
        rows = spark.read.parquet(f"{folder}/v*") if version is None else spark.read.parquet(f"{folder}/v{version:06d}")
        r = rows.orderBy(F.desc("version")).first()
        return SlotMap(r.version, r.shards, tuple(json.loads(r.shard_of)), tuple(json.loads(r.edits)))


def placed(slotted: DataFrame, chart: SlotMap, id_col: str = "doc_id") -> DataFrame:
    """slotted with shard and slot, the row's number in its shard, from 0 without gaps.

    Pieces of virtual slots are counted first; a piece's base is the sum of those before it in
    the shard, over SLOTS * CUTS (65,536) counts at most, so what is broadcast does not grow with
    the table; only rows within a piece are numbered by a window. Ties of id, size and checksum
    are equal rows, of which either may come first.
    """
    spark = slotted.sparkSession
    at = slotted.join(F.broadcast(chart.frame(spark)), "vslot")
    counts = at.groupBy("shard", "vslot", "vcut").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("vslot", "vcut")) - F.col("_n")
    base = counts.select("vslot", "vcut", before.alias("_base"))
    row = F.row_number().over(Window.partitionBy("vslot", "vcut").orderBy(id_col, "size", "text_crc32")) - 1
    return at.withColumn("_row", row).join(F.broadcast(base), ["vslot", "vcut"]).withColumn("slot", F.col("_base") + F.col("_row")).drop("vcut", "_base", "_row", "vslot")
