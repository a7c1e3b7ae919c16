"""BM25 over segments(doc, domain, field, segment, text): postings, statistics, matching, ranking, evidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.text.analyzer import own_tokens, query_terms, tokenised

K1, B = 1.2, 0.75
SNIPPET_BEFORE, SNIPPET_AFTER, SNIPPET_MOST = 96, 128, 256


class SearchError(ValueError):
    pass


@dataclass(frozen=True)
class Request:
    text: str
    domain: str
    fields: tuple[str, ...]
    channel: str = "terms"
    limit: int | None = 20  # None: all matches, in no order

    def __post_init__(self):
        if not self.domain:
            raise SearchError("a search needs a domain")
        if not 1 <= len(self.fields) <= 16:
            raise SearchError("a search takes 1 to 16 fields")
        if self.channel not in ("terms", "phrase", "exact"):
            raise SearchError(f"there is no channel {self.channel}")
        if self.limit is not None and not 1 <= self.limit <= 10_000:
            raise SearchError("the limit is 1 to 10000")


def postings(segments: DataFrame, channel: str) -> DataFrame:
    """(domain, field, doc, term) -> tf, places (segment, position)."""
    found = tokenised(segments, channel)
    return found.groupBy("domain", "field", "doc", "term").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list(F.struct("segment", "at"))).alias("places"))


def lengths(segments: DataFrame, channel: str) -> DataFrame:
    """(domain, field, doc) -> len, the number of tokens; documents without one don't count."""
    # Tokens are counted where the texts are; only counts move.
    counted = segments.select("domain", "field", "doc", F.size(own_tokens(F.col("text"), channel)).alias("n"))
    return counted.groupBy("domain", "field", "doc").agg(F.sum("n").alias("len")).where("len > 0")


def field_statistics(by_doc: DataFrame) -> DataFrame:
    return by_doc.groupBy("domain", "field").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("len").alias("total_len"))


def document_frequencies(segments: DataFrame, channel: str) -> DataFrame:
    """(domain, field, term) -> df."""
    terms = F.array_distinct(F.transform(own_tokens(F.col("text"), channel), lambda t: t["term"]))
    # A document's distinct terms are brought together first, so that each counts once and counts add up before they move.
    by_doc = segments.where("doc is not null").select("domain", "field", "doc", terms.alias("terms")).groupBy("domain", "field", "doc").agg(F.collect_list("terms").alias("terms"))
    each = by_doc.select("domain", "field", F.explode_outer(F.array_distinct(F.flatten("terms"))).alias("term")).where("term is not null")
    return each.groupBy("domain", "field", "term").agg(F.count(F.lit(1)).alias("df"))


def document_tokens(segments: DataFrame, channel: str) -> DataFrame:
    """doc -> n_tokens, n_terms (distinct), last_at, of documents with a token."""
    by_segment = segments.select("doc", own_tokens(F.col("text"), channel).alias("t"))
    counted = by_segment.select("doc", F.size("t").alias("n"), F.array_distinct(F.transform("t", lambda t: t["term"])).alias("terms"), F.array_max(F.transform("t", lambda t: t["at"])).alias("last"))
    found = counted.groupBy("doc").agg(F.sum("n").alias("n_tokens"), F.size(F.array_distinct(F.flatten(F.collect_list("terms")))).cast("bigint").alias("n_terms"), F.max("last").alias("last_at"))
    return found.where("n_tokens > 0")


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def weight(n: Column, df: Column, tf: Column, length: Column, mean: Column) -> Column:
    return idf(n, df) * tf / (tf + K1 * (1 - B + B * length / mean))


def search(segments: DataFrame, request: Request) -> DataFrame:
    """Matching documents: doc, score, best_field, place of the first hit; best first by score, then doc.

    Every distinct term has to be in some selected field.  A phrase also has to stand in one segment of one field;
    exact takes one token.  This reads and tokenises the domain's texts; StoredIndex reads postings instead.
    """
    terms, unique = wanted(segments.sparkSession, request)
    chosen = segments.where((F.col("domain") == request.domain) & F.col("field").isin(*request.fields))
    # One pass over the texts, which gives lengths and hits; tokens that aren't asked for don't become rows.
    by_segment = chosen.select("field", "doc", "segment", own_tokens(F.col("text"), request.channel).alias("t"))
    met = F.transform(F.filter("t", lambda t: t["term"].isin(*unique)), lambda t: F.struct(F.col("segment").alias("segment"), t["at"].alias("at"), t["term"].alias("term")))
    found = by_segment.select("field", "doc", F.size("t").alias("n"), met.alias("met"))
    by_doc = found.groupBy("field", "doc").agg(F.sum("n").alias("len"), F.flatten(F.collect_list("met")).alias("hits")).where("len > 0")
    by_doc = by_doc.select("field", "doc", "len", "hits", *[_times(t).alias(f"tf{i}") for i, t in enumerate(unique)])
    totals = by_doc.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("len").alias("total_len"), *[F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(unique))])
    return ranked(by_doc, totals, terms, request)


def _times(term: str) -> Column:
    """How often a term is among the hits."""
    return F.size(F.filter("hits", lambda h: h["term"] == term)).cast("bigint")


def wanted(spark, request: Request) -> tuple[list[tuple[str, int]], list[str]]:
    """A request's tokens in order, and its distinct terms."""
    terms = query_terms(spark, request.text, request.channel)
    if not terms:
        raise SearchError("the query has no tokens")
    if request.channel == "exact" and len(terms) != 1:
        raise SearchError("an exact search takes one token")
    return terms, sorted({t for t, _ in terms})


def ranked(by_doc: DataFrame, totals: DataFrame, terms: list[tuple[str, int]], request: Request) -> DataFrame:
    """by_doc(field, doc, len, tf0..., hits), totals(field, n_docs, total_len, df0...) -> the documents found, best first."""
    unique = sorted({t for t, _ in terms})
    order = {f: i for i, f in enumerate(request.fields)}
    # At most 16 rows: one for each selected field.
    scored = by_doc.where(" or ".join(f"tf{i} > 0" for i in range(len(unique)))).join(F.broadcast(totals), "field")
    parts = [F.when(F.col(f"tf{i}") > 0, weight(F.col("n_docs"), F.col(f"df{i}"), F.col(f"tf{i}"), F.col("len"), F.col("total_len") / F.col("n_docs"))).otherwise(0.0) for i in range(len(unique))]
    score = parts[0]
    for p in parts[1:]:
        score = score + p
    if request.channel == "phrase":
        scored = scored.where(F.exists("hits", lambda h: _phrase_at(h, terms)))
    rank = F.create_map(*[x for f, i in order.items() for x in (F.lit(f), F.lit(i))])
    scored = scored.select("doc", "field", score.alias("score"), F.element_at(rank, F.col("field")).alias("field_no"), F.array_sort("hits").alias("hits"), *[(F.col(f"tf{i}") > 0).cast("int").alias(f"has{i}") for i in range(len(unique))])
    best = F.max_by(F.struct("field", "hits"), F.struct("score", -F.col("field_no"))).alias("best")
    in_order = F.array_sort(F.collect_list(F.struct("field_no", "score")))
    out = scored.groupBy("doc").agg(F.aggregate(in_order, F.lit(0.0), lambda a, x: a + x["score"]).alias("score"), best, *[F.max(f"has{i}").alias(f"has{i}") for i in range(len(unique))])
    for i in range(len(unique)):
        out = out.where(F.col(f"has{i}") == 1)
    out = out.select("doc", "score", F.col("best.field").alias("best_field"), F.col("best.hits")[0].alias("first_hit"))
    return out if request.limit is None else out.orderBy(F.desc("score"), F.asc("doc")).limit(request.limit)


def _phrase_at(h: Column, terms: list[tuple[str, int]]) -> Column:
    """Whether the phrase's terms stand from hit h on; h must be its first term."""
    base = terms[0][1]
    test = h["term"] == terms[0][0]
    for term, at in terms[1:]:
        test = test & F.array_contains("hits", F.struct(h["segment"].alias("segment"), (h["at"] + (at - base)).cast("int").alias("at"), F.lit(term).alias("term")))
    return test


def with_evidence(hits: DataFrame, segments: DataFrame) -> DataFrame:
    """hits with snippet, byte_offset and line_number of the first hit in its best field."""
    keyed = segments.select(F.col("doc").alias("s_doc"), F.col("field").alias("s_field"), F.col("segment").alias("s_segment"), "text")
    test = (F.col("doc") == F.col("s_doc")) & (F.col("best_field") == F.col("s_field")) & (F.col("first_hit.segment") == F.col("s_segment"))
    joined = hits.join(keyed, test, "left")
    char = F.greatest(F.instr(F.lower("text"), F.col("first_hit.term")) - 1, F.lit(0))
    joined = joined.withColumn("char_at", char)
    before = F.substring(F.col("text"), F.lit(1), F.col("char_at"))
    offset = F.octet_length(before)
    joined = joined.withColumns({"byte_offset": offset, "line_number": F.char_length(before) - F.char_length(F.replace(before, F.lit("\n"), F.lit(""))) + 1})
    raw = F.encode("text", "UTF-8")
    start = F.greatest(F.col("byte_offset") - SNIPPET_BEFORE, F.lit(0))
    stop = F.least(F.col("byte_offset") + SNIPPET_AFTER, F.octet_length("text"), start + SNIPPET_MOST)
    # A cut inside a character is moved inwards.
    cut = F.regexp_replace(F.make_valid_utf8(F.substring(raw, start + 1, stop - start).cast("string")), "^�+|�+$", "")
    return joined.withColumn("snippet", cut).drop("s_doc", "s_field", "s_segment", "text", "char_at")
