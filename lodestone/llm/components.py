"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014), and joins that bear hubs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import discard, materialize

#: Keys that are met by broadcast at most, and the rows a key has at least for that.
HOT_KEYS, HOT_ROWS = 5000, 128


def meet(rows: DataFrame, summary: DataFrame, on: list[str], total: int, n: str = "n") -> DataFrame:
    """rows joined with the one row of summary for each key (rows without one go), however many rows a key has.

    summary's column n has at most the number of rows of each key, and total at least the sum.  Keys with more than
    total / HOT_KEYS rows, of which there are HOT_KEYS at most, are broadcast; so no task gets all rows of a hub.
    """
    bound = max(HOT_ROWS, total // HOT_KEYS)
    hot, cool = summary.where(F.col(n) > bound), summary.where(F.col(n) <= bound)
    by_broadcast = rows.join(F.broadcast(hot), on)
    by_shuffle = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cool, on)
    return by_broadcast.unionByName(by_shuffle)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return meet(both, least, ["u"], 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = meet(edges, least, ["u"], total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges(u, v) -> (u, root) for every node that isn't its component's smallest; loops and nulls don't count.

    Each round's two halves are written to the shared folder, and the round before is deleted; only a count and a
    checksum come back to the driver.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, state = materialize(edges, "edges"), None
    total = edges.count()
    for _ in range(rounds):
        large = materialize(_large_star(edges, total), "large-star")
        discard(edges)
        edges = materialize(_small_star(large, large.count()), "stars")
        discard(large)
        row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (row["n"], row["x"]) == state:
            break
        state, total = (row["n"], row["x"]), row["n"]
    else:
        raise RuntimeError("components didn't settle")
    return edges.select("u", F.col("v").alias("root"))
