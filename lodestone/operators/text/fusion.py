"""Rank fusion of several ranked streams(stream, rank, doc): round robin and reciprocal ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def ranked(hits: DataFrame, stream: int, order: list, doc: str = "doc", most: int = 10_000) -> DataFrame:
    """A stream of at most `most` hits with ranks from 1; the cut comes first, so the window sees a short list."""
    top = hits.orderBy(*order).limit(most)
    return top.select(F.lit(stream).alias("stream"), F.row_number().over(W.partitionBy(F.lit(stream)).orderBy(*order)).alias("rank"), F.col(doc).alias("doc"))


def round_robin(streams: DataFrame, limit: int = 20) -> DataFrame:
    """Interleaved by rank, then stream; a document counts where it comes first."""
    if not 1 <= limit <= 1000:
        raise ValueError("the limit is 1 to 1000")
    first = streams.groupBy("doc").agg(F.min(F.struct("rank", "stream")).alias("at"))
    return first.select("doc", F.col("at.rank").alias("rank"), F.col("at.stream").alias("stream")).orderBy("rank", "stream").limit(limit)


def reciprocal_rank(streams: DataFrame, k: int = 60, limit: int = 20) -> DataFrame:
    """Sum of 1 / (k + rank); raw scores are never added. A document counts once in a stream."""
    once = streams.groupBy("doc", "stream").agg(F.min("rank").alias("rank"))
    fused = once.groupBy("doc").agg(F.aggregate(F.array_sort(F.collect_list(F.col("rank"))), F.lit(0.0), lambda a, r: a + 1.0 / (k + r)).alias("score"), F.count(F.lit(1)).alias("n_streams"))
    return fused.orderBy(F.desc("score"), F.asc("doc")).limit(limit)
