"""A stored inverted index: postings ordered by term, lengths and statistics, in generations.

Postings lie in files ordered by (domain, term, doc), so a search for a few terms reads the row groups that hold them
and nothing else, and a term that is in every document spans many files.  Statistics are kept, not counted again.
A change writes a new generation with the documents' whole new state; a posting counts if no later generation has
its document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.text.analyzer import BIT, channel_tokens
from lodestone.operators.text.bm25 import Request, ranked, wanted

POSTINGS = "domain string, term string, doc bigint, field string, channels int, tf bigint, places array<struct<segment:int,at:int>>, generation int"
LENGTHS = "domain string, field string, doc bigint, terms bigint, phrase bigint, exact bigint, generation int"
CHANGES = "doc bigint, generation int"
STATISTICS = "domain string, field string, channel string, n_docs bigint, total_len bigint"
GROUPED = "domain string, term string, doc bigint, field string, channels int, tf bigint, places array<struct<segment:int,at:int>>"
#: Bytes of tokens in an Arrow batch to a Python worker, but for one document; rows in a batch back.
ARROW_BYTES, ROWS_BACK = 16 << 20, 1 << 16


def _grouping():
    """Rows of (domain, field, doc, tokens) -> a posting for each term and set of channels of a row.

    A closure, so that workers get it by value and need no copy of this package.
    """
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            lists = batch.column("tokens")
            flat = lists.flatten()
            if not len(flat):
                continue
            term, at, channels, segment = flat.flatten()
            encoded = term.dictionary_encode()
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            key = (row * len(encoded.dictionary) + encoded.indices.to_numpy()) * 8 + channels.to_numpy()
            place = (segment.to_numpy().astype(np.int64) << 32) + at.to_numpy()
            order = np.lexsort((place, key))
            key = key[order]
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            ends = np.append(starts[1:], len(key))
            for k in range(0, len(starts), ROWS_BACK):
                first, last = starts[k : k + ROWS_BACK], ends[k : k + ROWS_BACK]
                held, one = order[first[0] : last[-1]], order[first]
                places = pa.StructArray.from_arrays([segment.take(pa.array(held)), at.take(pa.array(held))], ["segment", "at"])
                offsets = pa.array(np.append(first, last[-1]) - first[0], pa.int32())
                of_row = {n: batch.column(n).take(pa.array(row[one])) for n in ("domain", "doc", "field")}
                terms = encoded.dictionary.take(encoded.indices.take(pa.array(one)))
                columns = [of_row["domain"], terms, of_row["doc"], of_row["field"], channels.take(pa.array(one)), pa.array(last - first, pa.int64()), pa.ListArray.from_arrays(offsets, places)]
                yield pa.RecordBatch.from_arrays(columns, ["domain", "term", "doc", "field", "channels", "tf", "places"])

    return run


class StoredIndex:
    """segments(doc, domain, field, segment, text) by their tokens, under a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, part: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{part}")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def generation(self) -> int:
        """The newest whole generation: statistics are written last."""
        return max((int(n.removeprefix("after-")) for n in self._names("statistics") if n.startswith("after-")), default=-1)

    def _read(self, part: str, schema: str) -> DataFrame:
        newest = self.generation()
        places = [f"{self.folder}/{part}/{n}" for n in self._names(part) if n.startswith("generation-") and int(n.removeprefix("generation-")) <= newest]
        return self.spark.read.schema(schema).parquet(*places) if places else self.spark.createDataFrame([], schema)

    def _current(self, df: DataFrame) -> DataFrame:
        """Rows of the latest generation of their document; without changes there is nothing to look up."""
        if self.generation() <= 0:
            return df
        latest = self._read("changes", CHANGES).groupBy("doc").agg(F.max("generation").alias("latest"))
        return df.join(latest, "doc", "left").where("generation = coalesce(latest, 0)").drop("latest")

    # Writing

    def write(self, segments: DataFrame, deleted: DataFrame | None = None) -> int:
        """The next generation: the whole new state of some documents (all, at first), and the ids of deleted ones."""
        number = self.generation() + 1
        # A document's segments come together before they are taken apart, so that its postings are whole where they arise.
        docs = segments.where("text is not null").groupBy("domain", "doc", "field").agg(F.collect_list(F.struct(F.col("segment").cast("int").alias("segment"), "text")).alias("parts"))
        placed = F.transform("parts", lambda p: F.transform(channel_tokens(p["text"]), lambda t: F.struct(t["term"].alias("term"), t["at"].alias("at"), t["channels"].alias("channels"), p["segment"].alias("segment"))))
        self.spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
        rows = docs.select("domain", F.col("doc").cast("bigint").alias("doc"), "field", F.flatten(placed).alias("tokens")).mapInArrow(_grouping(), GROUPED)
        rows = rows.withColumn("generation", F.lit(number))
        place = f"generation-{number:06d}"
        draft = f"{self.folder}/draft/{place}"
        rows.write.mode("overwrite").parquet(draft)  # so that ranges are drawn from what is there, not computed twice
        laid = self.spark.read.schema(POSTINGS).parquet(draft)
        laid.repartitionByRange("domain", "term", "doc").sortWithinPartitions("domain", "term", "doc").write.mode("overwrite").parquet(f"{self.folder}/postings/{place}")
        by_channel = [F.sum(F.when(F.col("channels").bitwiseAND(F.lit(bit)) > 0, F.col("tf")).otherwise(0)).alias(c) for c, bit in BIT.items()]
        laid.groupBy("domain", "field", "doc", "generation").agg(*by_channel).select("domain", "field", "doc", *BIT, "generation").write.mode("overwrite").parquet(f"{self.folder}/lengths/{place}")
        touched = segments.select("doc") if deleted is None else segments.select("doc").union(deleted.select("doc"))
        if number:
            touched.distinct().select("doc", F.lit(number).alias("generation")).write.mode("overwrite").parquet(f"{self.folder}/changes/{place}")
        self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/draft"), True)
        lengths = self.spark.read.schema(LENGTHS).parquet(*[f"{self.folder}/lengths/{n}" for n in self._names("lengths")])
        if number:
            latest = self.spark.read.schema(CHANGES).parquet(*[f"{self.folder}/changes/{n}" for n in self._names("changes")]).groupBy("doc").agg(F.max("generation").alias("latest"))
            lengths = lengths.join(latest, "doc", "left").where("generation = coalesce(latest, 0)")
        long = lengths.select("domain", "field", F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("len")) for c in BIT])).alias("l")).where("l.len > 0")
        statistics = long.groupBy("domain", "field", "l.channel").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("l.len").alias("total_len"))
        statistics.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/statistics/after-{number:06d}")
        return number

    # Reading

    def statistics(self) -> DataFrame:
        return self.spark.read.schema(STATISTICS).parquet(f"{self.folder}/statistics/after-{self.generation():06d}")

    def statistics_rows(self) -> int:
        return self.statistics().count() if self.generation() >= 0 else 0

    def postings(self) -> DataFrame:
        return self._current(self._read("postings", POSTINGS))

    def search(self, request: Request) -> DataFrame:
        """What bm25.search() gives for the same segments."""
        terms, unique = wanted(self.spark, request)
        chosen = (F.col("domain") == request.domain) & F.col("field").isin(*request.fields)
        own = self._current(self._read("postings", POSTINGS).where(chosen & F.col("term").isin(*unique) & (F.col("channels").bitwiseAND(F.lit(BIT[request.channel])) > 0)))
        counts = [F.max(F.when(F.col("term") == t, F.col("tf")).otherwise(0)).alias(f"tf{i}") for i, t in enumerate(unique)]
        places = F.flatten(F.collect_list(F.transform("places", lambda p: F.struct(p["segment"].alias("segment"), p["at"].alias("at"), F.col("term").alias("term"))))).alias("hits")
        by_doc = own.groupBy("field", "doc").agg(*counts, places)
        frequencies = own.groupBy("field").agg(*[F.count(F.when(F.col("term") == t, 1)).alias(f"df{i}") for i, t in enumerate(unique)])
        lengths = self._current(self._read("lengths", LENGTHS).where(chosen)).select("field", "doc", F.col(request.channel).alias("len"))
        totals = self.statistics().where(chosen & (F.col("channel") == request.channel)).select("field", "n_docs", "total_len").join(F.broadcast(frequencies), "field")
        return ranked(by_doc.join(lengths, ["field", "doc"]), totals, terms, request)
