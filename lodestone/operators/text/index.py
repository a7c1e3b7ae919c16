"""Full-text indexes over a graph's nodes or relationships."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.graph import values as V
from lodestone.operators.text import bm25
from lodestone.operators.text.bm25 import Request, SearchError

DOMAIN_FIELD, MAX_DOMAIN_BYTES = "db_type", 128
OPTIONS = {"db_type", "fields", "labels", "channel", "consistency", "limit"}


@dataclass
class FullTextIndex:
    name: str
    labels: tuple[str, ...]
    fields: tuple[str, ...]
    target: str = "node"
    maintained: object = None  # a streaming.maintain.Maintainer, for eventual reads

    def elements(self, graph) -> DataFrame:
        df = graph.nodes if self.target == "node" else graph.edges
        if self.target == "node":
            return df.where(F.arrays_overlap("labels", F.array(*[F.lit(x) for x in self.labels])))
        return df.where(F.col("type").isin(*self.labels))

    def segments(self, graph, labels: list[str] | None = None) -> DataFrame:
        """(doc, domain, field, segment, text): a text field is one segment, a list of texts one for each text."""
        schema = graph.node_schema if self.target == "node" else graph.edge_schema
        v = schema.value(lambda f: F.col(f))
        df = self.elements(graph)
        if labels:
            df = df.where(F.arrays_overlap("labels", F.array(*[F.lit(x) for x in labels])) if self.target == "node" else F.col("type").isin(*labels))
        domain = V.as_text(V.prop(v, DOMAIN_FIELD))
        parts = []
        for field in self.fields:
            x = v
            for step in field.split("."):
                x = V.prop(x, step)
            if x.kind == "any":
                listed = F.filter(F.transform(F.try_variant_get(x.col, "$", "array<variant>"), lambda e: V.as_text(V.variant(e))), lambda t: t.isNotNull())
                texts = F.when(F.schema_of_variant(x.col).startswith("ARRAY"), listed).when(V.as_text(x).isNotNull(), F.array(V.as_text(x)))
            elif x.kind == "list":
                texts = x.col
            else:
                texts = F.when(x.key.isNotNull(), F.array(V.as_text(x)))
            parts.append(F.struct(F.lit(field).alias("field"), texts.alias("texts")))
        df = df.where(domain.isNotNull() & (F.octet_length(domain) <= MAX_DOMAIN_BYTES))
        df = df.select(F.col("id").alias("doc"), domain.alias("domain"), F.explode(F.array(*parts)).alias("p")).select("doc", "domain", "p.field", F.posexplode("p.texts").alias("segment", "text"))
        return df.where("text is not null")

    def record_changes(self, before, after) -> None:
        """Append to the journal the documents whose segments differ between two versions of a graph."""
        old, new = self.segments(before), self.segments(after)
        shape = ["doc", "domain", "field", "segment", "text"]
        changed = new.join(old, shape, "left_anti").select("doc").union(old.join(new, shape, "left_anti").select("doc")).distinct()
        gone = changed.join(new.select("doc"), "doc", "left_anti")
        if not changed.isEmpty():
            self.maintained.record(new.join(changed, "doc", "left_semi"), gone)

    def request(self, text: str, options: dict) -> Request:
        if unknown := set(options) - OPTIONS:
            raise SearchError(f"there is no option {sorted(unknown)[0]}")
        fields = tuple(options.get("fields") or self.fields)
        if missing := set(fields) - set(self.fields):
            raise SearchError(f"index {self.name} has no field {sorted(missing)[0]}")
        return Request(text, options.get("db_type") or "", fields, options.get("channel", "terms"), options.get("limit", 20))

    def hits(self, graph, text: str, options: dict) -> tuple[DataFrame, DataFrame]:
        request = self.request(text, options)
        if options.get("consistency", "strict") == "eventual":
            if self.maintained is None:
                raise SearchError(f"index {self.name} isn't maintained")
            segments = self.maintained.segments()
            current = self.segments(graph).groupBy("doc").agg(_revision().alias("now"))
            held = segments.groupBy("doc").agg(_revision().alias("then"))
            stale = held.join(current, (held["doc"] == current["doc"]) & (held["then"] == current["now"]), "left_anti").select("doc")
            if stale.isEmpty() and self.maintained.postings.generation() >= 0:
                return self.maintained.postings.search(request), segments
            segments = segments.join(stale, "doc", "left_anti")
        else:
            segments = self.segments(graph, options.get("labels"))
        return bm25.search(segments, request), segments

    def search_table(self, graph, text: str, options: dict) -> DataFrame:
        """The twelve columns of SEARCH FULLTEXT."""
        found, segments = self.hits(graph, text, options)
        eventual = options.get("consistency", "strict") == "eventual"
        covered = self.maintained.covered() if eventual else None
        shown = bm25.with_evidence(found, segments)
        return shown.select(
            F.lit(self.target).alias("entity_kind"), F.col("doc").alias("entity_id"), "score", "best_field", "snippet", "byte_offset", "line_number",
            F.lit(options["db_type"]).alias("db_type"), F.lit(options.get("channel", "terms")).alias("channel"), F.lit(self.name).alias("index_name"),
            F.lit("eventual" if eventual else "strict").alias("consistency"), F.lit(covered).cast("long").alias("covered_source_seq"),
        ).orderBy(F.desc("score"), F.asc("entity_id"))


def _revision():
    """A digest of a document's segments, the same in the graph and in the index."""
    return F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("field", "segment", "text")))), 256)


def automatic(indexes: dict[str, FullTextIndex], labels: list[str], fields: list[str]) -> list[FullTextIndex]:
    """For each field the covering index with the fewest fields, then by name; each index once, in order of use."""
    out = []
    for field in fields:
        able = [i for i in indexes.values() if field in i.fields and set(labels) <= set(i.labels)]
        if not able:
            raise SearchError(f"no index covers {field}")
        best = min(able, key=lambda i: (len(i.fields), i.name))
        if all(i.name != best.name for i in out):
            out.append(best)
    return out
