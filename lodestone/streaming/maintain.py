"""Incremental full-text maintenance with Structured Streaming.

Changes are appended to a journal of Parquet files, each row with a source sequence.  A streaming query takes pending
files in micro-batches; its checkpoint is the cursor.  Every batch writes an immutable generation of the changed
documents' segments and of their postings, and a reader sees for each document its latest generation.  A batch that is replayed after a
failure writes the same generation again, so the result doesn't change.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.text.stored import StoredIndex

CHANGES = "doc bigint, domain string, field string, segment int, text string, deleted boolean, seq bigint"


@dataclass
class Report:
    status: str  # READY, PAUSED, TIMEOUT
    target_seq: int
    covered_seq: int
    batches: int
    elapsed_ms: int
    documents: int = 0  # that the batches took in


class Maintainer:
    def __init__(self, spark: SparkSession, folder: str, batch_files: int = 16):
        if not 1 <= batch_files <= 4096:
            raise ValueError("a batch has 1 to 4096 files")
        self.spark, self.folder, self.batch_files, self.paused = spark, folder.rstrip("/"), batch_files, False
        self.postings = StoredIndex(spark, f"{self.folder}/postings")
        self._running = None  # the batches that a wait gave up waiting for
        spark.createDataFrame([], CHANGES).write.mode("append").parquet(f"{self.folder}/journal")
        spark.createDataFrame([], CHANGES + ", batch bigint").write.mode("append").parquet(f"{self.folder}/index/generation=0")

    # Journal

    def last_seq(self) -> int:
        return self.spark.read.schema(CHANGES).parquet(f"{self.folder}/journal").agg(F.max("seq")).first()[0] or 0

    def record(self, segments: DataFrame, deleted: DataFrame | None = None) -> int:
        """Append the whole new state of some documents, and ids of deleted ones; returns their sequence."""
        seq = self.last_seq() + 1
        rows = segments.select("doc", "domain", "field", F.col("segment").cast("int").alias("segment"), "text", F.lit(False).alias("deleted"), F.lit(seq).cast("bigint").alias("seq"))
        if deleted is not None:
            none = F.lit(None).cast("string")
            rows = rows.unionByName(deleted.select("doc", none.alias("domain"), none.alias("field"), F.lit(None).cast("int").alias("segment"), none.alias("text"), F.lit(True).alias("deleted"), F.lit(seq).cast("bigint").alias("seq")))
        rows.write.mode("append").parquet(f"{self.folder}/journal")
        return seq

    # Batches

    def _take(self, batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("doc").agg(F.max("seq").alias("last"))
        kept = batch.join(latest, "doc").where("seq = last").drop("last")
        place = f"{self.folder}/index/generation={number + 1}"
        kept.withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(place)
        done = self.spark.read.schema(CHANGES).parquet(place)
        self.postings.write(done.where("not deleted"), done.where("deleted").select("doc").distinct())

    def _stream(self):
        source = self.spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", self.batch_files).parquet(f"{self.folder}/journal")
        return source.writeStream.foreachBatch(self._take).option("checkpointLocation", f"{self.folder}/cursor")

    def _drive(self):
        """The running batches; a second stream would fight with them over the cursor."""
        if self._running is None or not self._running.isActive:
            self._running = self._stream().trigger(availableNow=True).start()
        return self._running

    def sync(self) -> int:
        """Process everything that is pending; returns the covered sequence."""
        if not self.paused:
            if self._running is not None and self._running.isActive:
                self._running.awaitTermination()  # it may have begun before the last record
            self._drive().awaitTermination()
        return self.covered()

    def follow(self, interval_ms: int = 5000):
        """A running query that takes a batch every interval."""
        if not 100 <= interval_ms <= 86_400_000:
            raise ValueError("the interval is 100 to 86400000 ms")
        return self._stream().trigger(processingTime=f"{interval_ms} milliseconds").start()

    def wait(self, seconds: float = 30) -> Report:
        """Drive batches until what is recorded now is covered; never claims coverage after a timeout.

        A timeout ends the waiting and not the batches, or one that takes longer would never be done; the next wait
        joins them.
        """
        target, begun = self.last_seq(), time.time()
        if self.paused:
            return Report("PAUSED", target, self.covered(), 0, 0)
        until = begun + min(seconds, 60)
        query = self._drive()
        done = query.awaitTermination(max(0.001, until - time.time()))
        if done and self.covered() < target:  # these batches had begun before the last record
            query = self._drive()
            done = query.awaitTermination(max(0.001, until - time.time()))
        covered = self.covered()
        took = sum(p["numInputRows"] for p in query.recentProgress)
        return Report("READY" if done and covered >= target else "TIMEOUT", target, covered, len(query.recentProgress), int(1000 * (time.time() - begun)), took)

    # Reading

    def _index(self) -> DataFrame:
        return self.spark.read.schema(CHANGES + ", batch bigint, generation bigint").parquet(f"{self.folder}/index")

    def covered(self) -> int:
        return self._index().agg(F.max("seq")).first()[0] or 0

    def documents(self) -> int:
        return self.segments().select("doc").distinct().count()

    def segments(self) -> DataFrame:
        """The latest indexed state of every document."""
        index = self._index()
        latest = index.groupBy("doc").agg(F.max("seq").alias("last"))
        return index.join(latest, "doc").where("seq = last and not deleted").select("doc", "domain", "field", "segment", "text")
