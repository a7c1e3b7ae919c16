"""CALL ... YIELD inside graph queries: full-text and scan searches joined to the bindings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.graph import language as L
from lodestone.operators.graph import values as V
from lodestone.operators.graph.language import GraphError
from lodestone.operators.text import bm25, fusion
from lodestone.operators.text.bm25 import Request
from lodestone.operators.text.index import automatic
from lodestone.operators.text.scan import scan_search

QUERY_NODES, QUERY_EDGES = "db.index.fulltext.queryNodes", "db.index.fulltext.queryRelationships"


def _plain(e, compiler):
    """A constant argument: searches are compiled with their text."""
    if isinstance(e, L.Const):
        return int(e.value[1]) if isinstance(e.value, tuple) else e.value
    if isinstance(e, L.Argument):
        return compiler.parameters[e.name]
    if isinstance(e, L.ListOf):
        return [_plain(x, compiler) for x in e.items]
    if isinstance(e, L.MapOf):
        return {n: _plain(x, compiler) for n, x in e.items}
    raise GraphError("a search takes constant arguments or parameters")


def call(graph, compiler, clause: L.Procedure, state) -> tuple[DataFrame, dict]:
    args = [_plain(a, compiler) for a in clause.args]
    if clause.name in (QUERY_NODES, QUERY_EDGES):
        kind = "node" if clause.name == QUERY_NODES else "edge"
        if len(args) != 3:
            raise GraphError(f"{clause.name} takes an index, a text and options")
        index = graph.fulltext.get(args[0])
        if index is None or index.target != kind:
            raise GraphError(f"no full-text index {args[0]} on {kind}s")
        found, _ = index.hits(graph, args[1], args[2])
        found, given = found.select("doc", "score"), {"node" if kind == "node" else "relationship": "element", "score": "score"}
    elif clause.name.split(".")[-1] == "searchNodes":
        kind, (found, given) = "node", search_nodes(graph, *args)
    else:
        raise GraphError(f"there is no procedure {clause.name}")
    if unknown := {n for n, _ in clause.yields} - set(given):
        raise GraphError(f"{clause.name} doesn't yield {sorted(unknown)[0]}")
    schema = graph.node_schema if kind == "node" else graph.edge_schema
    prefix = compiler.fresh("hit")
    elements = (graph.nodes if kind == "node" else graph.edges).select(*[F.col(f).alias(f"{prefix}__{f}") for f in schema.fields])
    columns = {n: compiler.fresh(n) for n in found.columns}
    found = found.select(*[F.col(n).alias(c) for n, c in columns.items()])
    # At most `limit` hits, which the request bounds by 10,000, unless it is null.
    whole = len(args) == 3 and args[2].get("limit", 0) is None
    hits = elements.join(found if whole else F.broadcast(found), F.col(f"{prefix}__id") == F.col(columns["doc"]))
    df = compiler.rows(state).join(hits) if state.df is not None or compiler.outer is not None else hits
    scope = {}
    for name, alias in clause.yields:
        if given[name] == "element":
            scope[alias] = compiler.flat(prefix, schema, alias)
        else:
            scope[alias] = V.Value("str" if name == "mode" else "num", F.col(columns[given[name]]))
    return df, scope


def search_nodes(graph, text: str, options: dict | None = None) -> tuple[DataFrame, dict]:
    """(found, yields): a scan without indexes, else the named or automatic indexes fused round robin."""
    options = options or {}
    limit = options.get("limit", 20)
    if not isinstance(limit, int) or not 1 <= limit <= 1000:
        raise GraphError("the limit is 1 to 1000")
    fields, labels = options.get("fields") or [], options.get("labels") or []
    given = {"node": "element", "rank": "rank", "mode": "mode"}
    wanted = options.get("indexes")
    if not wanted:
        v = graph.node_schema.value(lambda f: F.col(f))
        nodes = graph.nodes
        if labels:
            nodes = nodes.where(F.arrays_overlap("labels", F.array(*[F.lit(x) for x in labels])))
        if options.get("db_type") is not None:
            nodes = nodes.where(V.equal(V.prop(v, "db_type"), V.constant(options["db_type"])))
        names = fields or ["name"]
        shown = nodes.select(F.col("id").alias("doc"), *[V.as_text(V.prop(v, f)).alias(f"f{i}") for i, f in enumerate(names)])
        hits = scan_search(shown, text, [f"f{i}" for i in range(len(names))], limit=limit)
        place = fusion.ranked(hits, 0, [F.desc("rank"), F.asc("doc")], most=limit).select("doc", "rank")
        return place.withColumn("mode", F.lit("bounded_scan")), given
    if wanted == "auto":
        chosen = automatic(graph.fulltext, labels, fields)
    else:
        if missing := [n for n in wanted if n not in graph.fulltext]:
            raise GraphError(f"no full-text index {missing[0]}")
        chosen = [graph.fulltext[n] for n in wanted]
    streams = None
    for k, index in enumerate(chosen):
        own = tuple(f for f in fields if f in index.fields) or index.fields
        request = Request(text, options.get("db_type") or "", own, options.get("channel", "terms"), limit)
        one = fusion.ranked(bm25.search(index.segments(graph, labels or None), request), k, [F.desc("score"), F.asc("doc")], most=limit)
        streams = one if streams is None else streams.union(one)
    fused = fusion.round_robin(streams, limit)
    place = fusion.ranked(fused.select("doc", F.col("rank").alias("r"), "stream"), 0, [F.asc("r"), F.asc("stream")], most=limit)
    return place.select("doc", "rank").withColumn("mode", F.lit("indexed")), given
