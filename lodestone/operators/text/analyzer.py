"""Mixed-language analysis with JVM expressions only.

A run is a maximal stretch of letters, digits and `_` that is wholly CJK or wholly not.  A run outside CJK is one token
in the channels terms, phrase and exact.  A CJK run of n characters gives n single characters (phrase), those and n - 1
pairs (terms), and itself (exact); positions advance by n.  Terms are lower-cased; those over 512 bytes are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The code points that count as CJK.
CJK = r"㐀-䶿一-鿿豈-﫿぀-ヿ가-힯"
RUN = rf"[{CJK}]+|[\p{{L}}\p{{N}}\p{{M}}_&&[^{CJK}]]+"
MAX_TERM_BYTES = 512
CHANNELS = ("terms", "phrase", "exact")


#: Stands before a CJK character that follows another one directly.
_JOINED = "\u0001"


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def _steps(lowered: Column) -> Column:
    """array<struct<own, after, at>>: one element for each position, a single CJK character or a whole other run.

    own and after (the next element) begin with _JOINED where they belong to the run before them.
    """
    marked = F.regexp_replace(F.replace(lowered, F.lit(_JOINED), F.lit(" ")), f"(?<=[{CJK}])(?=[{CJK}])", _JOINED)
    found = F.regexp_extract_all(marked, F.lit(rf"{_JOINED}?[{CJK}]|[\p{{L}}\p{{N}}\p{{M}}_&&[^{CJK}]]+"), F.lit(0))

    def zipped(own):
        # Neighbours are zipped, so that no element looks back into the array and a text costs no more than its length.
        pairs = F.arrays_zip(own.alias("own"), F.slice(own, F.lit(2), F.greatest(F.size(own), F.lit(1))).alias("after"))
        return F.transform(pairs, lambda p, i: F.struct(p["own"].alias("own"), p["after"].alias("after"), i.cast("int").alias("at")))

    return let(found, zipped)


#: The bit of each channel in a token's set of channels.
BIT = {c: 1 << k for k, c in enumerate(CHANNELS)}


def channel_tokens(text: Column) -> Column:
    """array<struct<term, at, channels>> of all channels: a token that several share stands once, with their bits.

    A text without CJK characters, whose runs are its tokens in every channel, takes one short pass.
    """

    def token(term, at, channels):
        return F.struct(term.alias("term"), at.cast("int").alias("at"), channels.cast("int").alias("channels"))

    def bare(x):
        return F.replace(x, F.lit(_JOINED), F.lit(""))

    every, singles = F.lit(sum(BIT.values())), F.lit(BIT["terms"] | BIT["phrase"])

    def plain(lowered):
        return F.transform(F.regexp_extract_all(lowered, F.lit(r"[\p{L}\p{N}\p{M}_]+"), F.lit(0)), lambda w, i: token(w, i, every))

    def mixed(lowered, steps):
        single = F.transform(steps, lambda s: token(bare(s["own"]), s["at"], F.when(s["own"].rlike(f"[{CJK}]"), singles).otherwise(every)))
        double = F.transform(F.filter(steps, lambda s: F.startswith(F.coalesce(s["after"], F.lit("")), F.lit(_JOINED))), lambda s: token(bare(F.concat(s["own"], s["after"])), s["at"], F.lit(BIT["terms"])))
        # Whole CJK runs, whose places are those of the elements that begin them.
        starts = F.filter(steps, lambda s: s["own"].rlike(f"^[{CJK}]"))
        zipped = F.zip_with(F.regexp_extract_all(lowered, F.lit(f"[{CJK}]+"), F.lit(0)), starts, lambda r, s: token(r, s["at"], F.lit(BIT["exact"])))
        return F.concat(single, double, zipped)

    def found(lowered):
        return F.when(lowered.rlike(f"[{CJK}]"), let(_steps(lowered), lambda steps: mixed(lowered, steps))).otherwise(plain(lowered))

    return F.filter(let(F.lower(text), found), lambda t: F.octet_length(t["term"]) <= MAX_TERM_BYTES)


def own_tokens(text: Column, channel: str) -> Column:
    """array<struct<term, at, channels>> of one channel."""
    return F.filter(channel_tokens(text), lambda t: t["channels"].bitwiseAND(F.lit(BIT[channel])) > 0)


def tokens(text: Column, channel: str) -> Column:
    """array<struct<term, at>> of one channel, by place."""
    if channel not in CHANNELS:
        raise ValueError(f"no channel {channel}")
    placed = F.array_sort(F.transform(own_tokens(text, channel), lambda t: F.struct(t["at"].alias("at"), t["term"].alias("term"))))
    return F.transform(placed, lambda t: F.struct(t["term"].alias("term"), t["at"].alias("at")))


def tokenised(segments: DataFrame, channel: str, text: str = "text") -> DataFrame:
    """segments with one row for each token: term and at, in place of the text."""
    kept = [c for c in segments.columns if c != text]
    own = F.col("t.channels").bitwiseAND(F.lit(BIT[channel])) > 0
    # The outer form: a plain explode gets a filter on the array's size, which would compute the tokens twice.
    return segments.select(*kept, F.explode_outer(channel_tokens(F.col(text))).alias("t")).where(own).select(*kept, "t.term", "t.at")


def query_terms(spark, text: str, channel: str) -> list[tuple[str, int]]:
    """A query's tokens in order; a query is short, so they come to the driver."""
    row = spark.range(1).select(tokens(F.lit(text), channel).alias("t")).first()
    return [(t["term"], t["at"]) for t in row["t"]]
