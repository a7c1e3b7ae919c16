"""Queries of specified extensions: vectors, memory; and of Spark's event-time windows, which are an addition of ours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import memory, vector
from lodestone.sources.scratch import shared_place


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _first(spark: SparkSession, sf_dir: str) -> list[float]:
    return _vectors(spark, sf_dir).where("vec_id = 0").first()["embedding"]


def _topk(metric: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return vector.search(_vectors(spark, sf_dir), _first(spark, sf_dir), 10, metric).select("vec_id", F.round("distance", 6).alias("distance"))

    return run


def v_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.search(_vectors(spark, sf_dir), _first(spark, sf_dir), 5, "l2", where=F.col("label") == 3).select("vec_id", F.round("distance", 6).alias("distance"))


def v_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverted lists; with all cells probed the answer is exact, which the SQL checks."""
    index = vector.InvertedLists(_vectors(spark, sf_dir), shared_place(spark, "lists"), cells=8)
    return index.search(_first(spark, sf_dir), 10, probes=8).select("vec_id", F.round("distance", 6).alias("distance"))


def v_ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 10 of the index at its fitted number of probes, over every row whose id is divisible by 50."""
    vectors = _vectors(spark, sf_dir)
    index = vector.InvertedLists(vectors, shared_place(spark, "lists"))
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    exact = index.neighbours(asked, 10, len(index.centres)).select("query", "vec_id")
    found = index.neighbours(asked, 10).select("query", "vec_id", F.lit(1).alias("met"))
    out = exact.join(found, ["query", "vec_id"], "left").agg(F.count_distinct("query").alias("n_queries"), (F.count("met") / F.count(F.lit(1)) >= 0.9).alias("enough"))
    return out.withColumn("fewer_cells", F.lit(index.probes < len(index.centres)))


def memories(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as memories, customers as sources, lines as derivations."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    mem = orders.select(
        F.col("o_orderkey").alias("memory_id"), F.when(F.col("o_orderstatus") == "P", "deleted").when(F.col("o_orderstatus") == "F", "superseded").otherwise("active").alias("status"),
        F.col("o_custkey").alias("source_id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate")).alias("expires_at"),
    )
    sources = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("source_id"), (F.col("c_acctbal") < 0).alias("revoked"))
    return mem, sources, orders


def mem_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    mem, sources, _ = memories(spark, sf_dir)
    return memory.visible(mem, sources, F.lit("1995-06-01").cast("timestamp")).select("memory_id")


def mem_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as versions of their order: the latest line shipped by a date."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    versions = lines.select(F.col("l_orderkey").alias("memory_id"), F.col("l_linenumber").alias("version"), F.col("l_shipdate").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), F.col("l_shipdate").alias("recorded_at"), F.lit(None).cast("timestamp").alias("retired_at"), F.col("l_partkey").alias("body"))
    now = F.lit("1996-01-01").cast("timestamp")
    return memory.as_of(versions, now, now).groupBy("memory_id").agg(F.max("recorded_at").alias("recorded_at"))


def mem_revoked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What derives from one region: region, nations, customers."""
    nation, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "customer"))
    links = nation.select((F.col("n_regionkey") + 1_000_000).cast("bigint").alias("parent"), (F.col("n_nationkey") + 2_000_000).cast("bigint").alias("child"))
    links = links.union(customer.select((F.col("c_nationkey") + 2_000_000).cast("bigint"), F.col("c_custkey").cast("bigint") + 3_000_000))
    return memory.revoked_closure(spark.createDataFrame([(1_000_002,)], "id bigint"), links)


def ev_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    out = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n")


def ev_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    out = events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), "n")


QUERIES = {"v_l2_topk": _topk("l2"), "v_cosine_topk": _topk("cosine"), "v_ip_topk": _topk("ip")}
QUERIES |= {f.__name__: f for f in (v_filtered, v_ivf, v_ivf_recall, mem_visible, mem_as_of, mem_revoked, ev_tumbling, ev_session)}

_V = "CAST(e.embedding AS DOUBLE[])"
_Q = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)"


def _nearest(expression: str, k: int = 10, where: str = "true") -> str:
    return f"SELECT vec_id, round(d, 6) AS distance FROM (SELECT vec_id, {expression} AS d FROM embeddings e WHERE {where}) ORDER BY d, vec_id LIMIT {k}"


ORACLE_SQL = {
    "v_l2_topk": _nearest(f"list_distance({_V}, {_Q})"),
    "v_cosine_topk": _nearest(f"1 - list_cosine_similarity({_V}, {_Q})"),
    "v_ip_topk": _nearest(f"-list_inner_product({_V}, {_Q})"),
    "v_filtered": _nearest(f"list_distance({_V}, {_Q})", 5, "label = 3"),
    "v_ivf": _nearest(f"list_distance({_V}, {_Q})"),
    "v_ivf_recall": "SELECT count(*) AS n_queries, true AS enough, true AS fewer_cells FROM embeddings WHERE vec_id % 50 = 0",
    "mem_visible": "SELECT o_orderkey AS memory_id FROM orders WHERE o_orderstatus NOT IN ('P', 'F') AND (o_orderkey % 3 <> 0 OR o_orderdate > TIMESTAMP '1995-06-01') AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "mem_as_of": "SELECT l_orderkey AS memory_id, max(l_shipdate) AS recorded_at FROM lineitem WHERE l_shipdate <= TIMESTAMP '1996-01-01' GROUP BY l_orderkey",
    "mem_revoked": "SELECT 1000002 AS id UNION ALL SELECT n_nationkey + 2000000 FROM nation WHERE n_regionkey = 2 UNION ALL SELECT c_custkey + 3000000 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2",
    "ev_tumbling": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "ev_session": "WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k",
}
