"""Mixing sources to target weights by temperature, with DataFrame and SQL expressions only.

Token shares p are raised to an exponent a and normalised, w = p^a / sum p^a.  a is bisected to the flattest
mixture that keeps within a repetition limit, or to a target entropy: each round of the bisection tries 32 exponents
in one aggregate over the sources, of which one row comes back, so sources may be many.  The weights are realised under a token
budget: each source is dealt in whole passes, and a last, partial pass takes blocks in a permuted order until the
source's budget is met; the block at the edge is cut at a row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.llm.common import fresh, materialize

BLOCKS = 1024
#: The plan (a row for each source and block) is broadcast up to so many bytes, summed first; beyond, it is joined by shuffle.
BROADCAST_BYTES = 8 << 20
WORD = r"[^\x20\x09-\x0D]+"
#: Rounds of the bisection and the parts into which each cuts what is left: 32^4 steps, finer than the sixth decimal.
ROUNDS, CUTS = 4, 32


def token_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _permuted(*parts: Column, seed: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))


def _least_for_repetition(low: float, high: float, repetition: float) -> float:
    """The smallest exponent in [0, 1] at which a source of `low` tokens is read `repetition` times at most while one of
    `high` is read once; bisected."""
    a, b = 0.0, 1.0
    for _ in range(40):
        mid = (a + b) / 2
        a, b = (a, mid) if math.exp((mid - 1) * (math.log(low) - math.log(high))) <= repetition else (mid, b)
    return b


def _least_for_entropy(shares: DataFrame, target: float) -> float:
    """The smallest exponent in [0, 1] at which the entropy of share^a / sum is the target or less; 1 if there is none."""
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        step = (high - low) / CUTS
        tries = [low + step * k for k in range(1, CUTS + 1)]
        power = [F.exp(F.lit(a) * F.log("share")) for a in tries]
        sums = shares.agg(*[F.sum(x).alias(f"z{k}") for k, x in enumerate(power)], *[F.sum(F.lit(a) * F.log("share") * x).alias(f"m{k}") for k, (a, x) in enumerate(zip(tries, power, strict=True))]).first()
        met = [k for k in range(CUTS) if math.log(sums[f"z{k}"]) - sums[f"m{k}"] / sums[f"z{k}"] <= target]
        k = met[0] if met else CUTS - 1
        low, high = tries[k] - step, tries[k]
    return high


def weights(totals: DataFrame, repetition: float | None = 2.0, entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """totals(source, tokens) -> source, tokens, share, exponent, weight, budget, copies (the passes over the source).

    repetition: no source is read more than so many times.  entropy: the target, as a share of log(number of
    sources).  The larger exponent (the one nearer to the corpus) holds if both are given.  budget: tokens in all;
    by default so many that every source is read at least once.  Sources without tokens get one pass and no weight.
    totals is read several times.
    """
    worded = totals.where("tokens > 0")
    of = worded.agg(F.count(F.lit(1)).alias("n"), F.min("tokens").alias("low"), F.max("tokens").alias("high"), F.sum("tokens").cast("double").alias("sum")).first()
    exponent, z = 1.0, 1.0
    if of["n"]:
        shares = worded.select((F.col("tokens") / F.lit(of["sum"])).alias("share"))
        least = []
        if of["n"] > 1 and repetition is not None:
            least.append(_least_for_repetition(of["low"], of["high"], repetition))
        if of["n"] > 1 and entropy is not None:
            least.append(_least_for_entropy(shares, entropy * math.log(of["n"])))
        exponent = round(max(least), 6) if least else 1.0
        z = shares.agg(F.sum(F.exp(F.lit(exponent) * F.log("share")))).first()[0]
    share = F.when(F.col("tokens") > 0, F.col("tokens") / F.lit(of["sum"])).otherwise(0.0)
    weight = F.when(F.col("tokens") > 0, F.exp(F.lit(exponent) * F.log(share)) / F.lit(z)).otherwise(0.0)
    out = totals.select("source", "tokens", share.alias("share"), F.lit(exponent).alias("exponent"), weight.alias("weight"))
    whole = float(budget) if budget is not None else of["high"] / (math.exp(exponent * math.log(of["high"] / of["sum"])) / z) if of["n"] else 0.0
    out = out.withColumn("budget", F.when(F.col("tokens") > 0, F.floor(F.round(F.lit(whole) * F.col("weight"), 3))).otherwise(0).cast("long"))
    return out.select("*", F.when(F.col("tokens") > 0, F.col("budget") / F.col("tokens")).otherwise(F.lit(1.0)).alias("copies"))


def mix(docs: DataFrame, repetition: float | None = 2.0, entropy: float | None = None, budget: int | None = None, blocks: int = BLOCKS, seed: str = "mix", source: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of the mixture: all columns of docs, copy (0, 1, ...), mix_block and mix_order (sort by it to shuffle).

    Every row appears once for each whole pass over its source, and once more if the partial pass reaches it.  Null
    sources form a source of their own; texts that are null or empty have no tokens and follow the passes.  Rows
    that repeat a key are kept; rows without a key are dealt by their text.  Columns of docs with the names added here are replaced.  Blocks (hashes of the
    key) split the largest source into `blocks` parts, and only blocks at a budget's edge are counted row by row.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("copy", "mix_block", "mix_order")])
    named = F.when(F.col(source).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(source).cast("string")))
    # Rows without a key are told apart by their text, so that they are no block of their own.
    block = F.pmod(F.when(F.col(key).isNull(), F.xxhash64(text)).otherwise(F.xxhash64(key)), F.lit(blocks)).cast("int")
    known = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("~"), F.xxhash64(text).cast("string")))
    place = _permuted(known, seed=seed)
    slim = materialize(docs.select(named.alias("mix_source"), block.alias("mix_block"), place.alias("place"), token_count(text).alias("n")), "mix")
    sums = materialize(slim.groupBy("mix_source", "mix_block").agg(F.sum("n").alias("tokens")), "mix-sums")
    plan = weights(materialize(sums.groupBy(F.col("mix_source").alias("source")).agg(F.sum("tokens").alias("tokens")), "mix-totals"), repetition, entropy, budget)
    plan = plan.select(F.col("source").alias("mix_source"), F.col("tokens").alias("source_tokens"), "budget", F.floor("copies").cast("int").alias("whole"))
    # One row per source and block from here on.
    before = W.partitionBy("mix_source").orderBy(_permuted(F.col("mix_source"), F.col("mix_block"), seed=seed), "mix_block").rowsBetween(W.unboundedPreceding, -1)
    dealt = sums.join(plan, "mix_source").withColumn("part", F.when(F.col("source_tokens") > 0, F.col("budget") - F.col("whole") * F.col("source_tokens")).otherwise(0))
    dealt = dealt.select("mix_source", "mix_block", "whole", "tokens", (F.col("part") - F.coalesce(F.sum("tokens").over(before), F.lit(0))).alias("room"))
    # Blocks at a budget's edge (one for each source) are cut where their rows, in permuted order, fill the room.
    edges = dealt.where("room > 0 and room < tokens").select("mix_source", "mix_block", "room")
    filled = F.sum("n").over(W.partitionBy("mix_source", "mix_block").orderBy("place"))
    cuts = slim.join(edges, ["mix_source", "mix_block"]).withColumn("filled", filled).where("filled <= room").groupBy("mix_source", "mix_block").agg(F.max("place").alias("cut"))
    last = F.when(F.col("room") <= 0, F.lit("")).when(F.col("room") >= F.col("tokens"), F.lit("~")).otherwise(F.coalesce("cut", F.lit("")))
    # The plan is joined to whole rows, under names that these don't have.
    of, at, passes, cut = fresh(docs, "of", "at", "passes", "cut")
    dealt = dealt.join(cuts, ["mix_source", "mix_block"], "left").select(F.col("mix_source").alias(of), F.col("mix_block").alias(at), F.col("whole").alias(passes), last.alias(cut))
    dealt = materialize(dealt, "mix-plan")
    if (dealt.agg(F.sum(F.octet_length(of) + 80)).first()[0] or 0) <= BROADCAST_BYTES:
        dealt = F.broadcast(dealt)
    rows = docs.withColumns({of: named, at: block}).join(dealt, [of, at])
    times = F.col(passes) + (place <= F.col(cut)).cast("int")
    rows = rows.withColumn("copy", F.explode(F.filter(F.sequence(F.lit(0), F.col(passes)), lambda i: i < times)))
    return rows.select(*docs.columns, "copy", F.col(at).alias("mix_block"), _permuted(known, F.col("copy"), seed=seed).alias("mix_order"))
