"""Sharding over fixed virtual slots.

Records hash into thousands of slots by their text, so that equal texts stay together; bytes are summed per slot; a
versioned slot-to-shard map is stored, and edited where shards are to be near equal in bytes: rebalancing moves slots
from the heaviest shard to the lightest until the loads are within bounds, and a new version is stored.  A text whose
copies outweigh a fixed part of a shard is dealt out by key, since no map could balance it.  Only DataFrame
expressions touch records; what reaches the driver is one sum per slot, whose number is a fixed parameter.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.llm.common import materialize, shared_dir

SLOTS = 4096
#: Copies of a text are split if they have more than this part of a shard, and the excess of a shard that rebalancing leaves.
PARTS, TOLERANCE = 64, 0.0002


@dataclass
class SlotMap:
    """shard_of[slot]; edits gives (slot, from, to) of the step that made this version."""

    version: int
    n_shards: int
    shard_of: list[int]
    edits: list[tuple[int, int, int]] = field(default_factory=list)

    @classmethod
    def even(cls, n_shards: int, slots: int = SLOTS) -> SlotMap:
        """Version 1, before any load is known: slots are dealt in turn."""
        return cls(1, n_shards, [s % n_shards for s in range(slots)])

    @classmethod
    def balanced(cls, loads: dict[int, int], n_shards: int, slots: int = SLOTS) -> SlotMap:
        """Version 1: the heaviest slot first, each to the lightest shard (ties: the lower number)."""
        heap = [(0, s) for s in range(n_shards)]
        shard_of = [0] * slots
        for slot in sorted(range(slots), key=lambda s: (-loads.get(s, 0), s)):
            load, shard = heapq.heappop(heap)
            shard_of[slot] = shard
            heapq.heappush(heap, (load + max(1, loads.get(slot, 0)), shard))
        return cls(1, n_shards, shard_of)

    def loads(self, loads: dict[int, int], n_shards: int | None = None) -> list[int]:
        out = [0] * (n_shards or self.n_shards)
        for slot, shard in enumerate(self.shard_of):
            out[shard] += loads.get(slot, 0)
        return out

    def rebalanced(self, loads: dict[int, int], n_shards: int | None = None, tolerance: float = 0.01) -> SlotMap:
        """The next version: while the heaviest shard exceeds the mean by more than tolerance, its best-fitting slot moves to the lightest."""
        n = n_shards or self.n_shards
        if n < self.n_shards:
            raise ValueError("shards are only added")
        shard_of, total, edits = list(self.shard_of), self.loads(loads, n), []
        held: list[list[int]] = [[] for _ in range(n)]
        for slot, shard in enumerate(shard_of):
            held[shard].append(slot)
        mean = sum(total) / n
        while True:
            high, low = max(range(n), key=lambda s: (total[s], -s)), min(range(n), key=lambda s: (total[s], s))
            gap = total[high] - total[low]
            if total[high] <= mean * (1 + tolerance) or gap <= 1:
                break
            fits = [s for s in held[high] if 0 < loads.get(s, 0) < gap]
            if not fits:
                break
            slot = min(fits, key=lambda s: (abs(loads[s] - min(gap / 2, total[high] - mean)), s))
            held[high].remove(slot)
            held[low].append(slot)
            shard_of[slot] = low
            total[high] -= loads[slot]
            total[low] += loads[slot]
            edits.append((slot, high, low))
        return SlotMap(self.version + 1, n, shard_of, edits)

    def column(self, slot: Column) -> Column:
        """The shard of a slot column: a lookup in one literal, whose length is the number of slots."""
        return F.element_at(F.split(F.lit(",".join(map(str, self.shard_of))), ","), (slot + 1).cast("int")).cast("int")

    def frame(self, spark: SparkSession) -> DataFrame:
        slots = spark.range(len(self.shard_of)).select(F.col("id").cast("int").alias("slot"))
        return slots.select(F.lit(self.version).alias("version"), F.lit(self.n_shards).alias("n_shards"), "slot", self.column(F.col("slot")).alias("shard"))

    def save(self, spark: SparkSession, path: str) -> None:
        self.frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/version={self.version:06d}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int) -> SlotMap:
        rows = sorted(spark.read.parquet(f"{path}/version={version:06d}").collect(), key=lambda r: r["slot"])
        return cls(version, rows[0]["n_shards"], [r["shard"] for r in rows])


def record_size(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def slotted(docs: DataFrame, n_shards: int, slots: int, key: str, text: str) -> DataFrame:
    """key, size, text_crc32, virtual_slot of every row.

    Texts whose copies have more than 1 / PARTS of a shard's mean bytes together, so n_shards * PARTS texts at most,
    are broadcast as hashes; their rows go to slots by key and text, all others by text.
    """
    digest = F.xxhash64(F.coalesce(text, F.lit("")))
    rows = docs.select(F.col(key), record_size(text).alias("size"), F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), digest.alias("text_hash"))
    sums = materialize(rows.groupBy("text_hash").agg(F.sum("size").alias("bytes")), "text-bytes")
    total = sums.agg(F.sum("bytes")).first()[0] or 0
    heavy = sums.where(F.col("bytes") > total / (n_shards * PARTS)).select("text_hash", F.lit(True).alias("heavy"))
    rows = rows.join(F.broadcast(heavy), "text_hash", "left")
    hashed = F.when(F.col("heavy"), F.xxhash64(F.col("text_hash"), F.col(key))).otherwise(F.col("text_hash"))
    return rows.select(key, "size", "text_crc32", F.pmod(F.xxhash64(hashed), F.lit(slots)).cast("int").alias("virtual_slot"))


def slot_loads(rows: DataFrame) -> dict[int, int]:
    """Bytes per slot: summed before the shuffle, so what moves is at most one row per slot and task."""
    return {r["virtual_slot"]: r["bytes"] for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes")).collect()}


def shard(docs: DataFrame, n_shards: int, slots: int = SLOTS, key: str = "doc_id", text: str = "text", folder: str | None = None) -> tuple[DataFrame, SlotMap]:
    """Per row: key, size, text_crc32, virtual_slot, shard and slot (the row's place in its shard, gapless from 0).

    Law `bytes`: shards are near equal in summed size.  folder holds the versions of the map: the newest is read (or
    an even one stored), edited for these rows, stored as the next version and read again to place the rows; without
    it, a folder of this call's own is used.  Equal texts share a shard, unless their copies outweigh 1 / PARTS of a
    shard; then they are split by key.  Null texts count 8 bytes and crc 0 and are equal to empty ones.  Rows that
    repeat key and text share a slot.  Other columns are ignored, whatever their names; no rows give no rows.
    Places are counted inside virtual slots and shifted by the sizes of the slots before, so that no task ever
    holds a whole shard.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/lodestone/slot-map-{uuid.uuid4().hex}"
    rows = slotted(docs, n_shards, slots, key, text)
    newest = newest_version(spark, folder)
    if not newest:
        SlotMap.even(n_shards, slots).save(spark, folder)
    old = SlotMap.load(spark, folder, newest or 1)
    edited = old.rebalanced(slot_loads(rows), n_shards, TOLERANCE)
    edited.save(spark, folder)
    slot_map = SlotMap.load(spark, folder, edited.version)
    slot_map.edits = edited.edits
    rows = rows.withColumn("shard", slot_map.column(F.col("virtual_slot")))
    counts = rows.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("n")).withColumn("shard", slot_map.column(F.col("virtual_slot")))
    # One row per virtual slot: at most `slots` rows, whatever the input, so both the window and the broadcast are bounded.
    before = W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1)
    shifts = counts.select("virtual_slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    inside = F.row_number().over(W.partitionBy("virtual_slot").orderBy(key, "text_crc32", "size"))
    out = rows.withColumn("inside", inside).join(F.broadcast(shifts), "virtual_slot")
    return out.select(key, "size", "text_crc32", "virtual_slot", "shard", (F.col("shift") + F.col("inside") - 1).cast("long").alias("slot")), slot_map


def newest_version(spark: SparkSession, folder: str) -> int:
    """The greatest version that a folder of maps holds; 0 for none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in store.listStatus(path)] if store.exists(path) else []
    return max((int(n.removeprefix("version=")) for n in names if n.startswith("version=")), default=0)
