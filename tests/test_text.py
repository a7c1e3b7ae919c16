"""Analysis, ranking and search against golden facts and a plain-Python BM25."""

import math
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lodestone.operators.graph import Graph
from lodestone.operators.text import bm25, fusion
from lodestone.operators.text.analyzer import tokens
from lodestone.operators.text.bm25 import Request, SearchError
from lodestone.operators.text.index import FullTextIndex, automatic
from lodestone.session import Session
from lodestone.streaming.maintain import Maintainer


def analysed(spark, text, channel):
    return [(t["term"], t["at"]) for t in spark.range(1).select(tokens(F.lit(text), channel).alias("t")).first()["t"]]


def test_channels(spark):
    text = "Oat_Milk 茶水壶 x"
    assert analysed(spark, text, "exact") == [("oat_milk", 0), ("茶水壶", 1), ("x", 4)]
    assert analysed(spark, text, "phrase") == [("oat_milk", 0), ("茶", 1), ("水", 2), ("壶", 3), ("x", 4)]
    assert analysed(spark, text, "terms") == [("oat_milk", 0), ("茶", 1), ("茶水", 1), ("水", 2), ("水壶", 2), ("壶", 3), ("x", 4)]
    assert analysed(spark, "茶 水\u0001壶木", "terms") == [("茶", 0), ("水", 1), ("壶", 2), ("壶木", 2), ("木", 3)]
    assert analysed(spark, "茶水" * 3000, "terms")[-3:] == [("茶", 5998), ("茶水", 5998), ("水", 5999)]
    assert analysed(spark, "a" * 600 + " b", "terms") == [("b", 1)]
    assert analysed(spark, "", "terms") == []
    assert analysed(spark, "ab中c", "exact") == [("ab", 0), ("中", 1), ("c", 2)]


def plain_bm25(docs, query, fields):
    """docs: {id: {field: text}}."""
    words = {d: {f: re.findall(r"\w+", t.lower()) for f, t in fs.items() if f in fields} for d, fs in docs.items()}
    out = {}
    for d, fs in words.items():
        if not all(any(q in ts for ts in fs.values()) for q in query):
            continue
        total = 0.0
        for f in fields:
            have = [w[f] for w in words.values() if w.get(f)]
            if d in words and fs.get(f) and have:
                n, mean = len(have), sum(map(len, have)) / len(have)
                for q in set(query):
                    tf, df = fs[f].count(q), sum(q in ts for ts in have)
                    if tf:
                        total += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * len(fs[f]) / mean))
        out[d] = total
    return out


def test_bm25_matches_a_plain_model(spark):
    docs = {1: {"a": "red fox jumps", "b": "blue"}, 2: {"a": "red red dog", "b": "fox"}, 3: {"a": "dog", "b": "red dog"}, 4: {"a": "cat"}}
    segments = spark.createDataFrame([(d, "x", f, 0, t) for d, fs in docs.items() for f, t in fs.items()], "doc bigint, domain string, field string, segment int, text string")
    for query in (["red"], ["red", "fox"], ["dog"]):
        got = dict(bm25.search(segments, Request(" ".join(query), "x", ("a", "b"))).select("doc", "score").collect())
        want = plain_bm25(docs, query, ["a", "b"])
        assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-9 for d in want)
    assert bm25.search(segments, Request("red", "other", ("a",))).count() == 0
    for bad in (lambda: Request("x", "", ("a",)), lambda: Request("x", "d", ()), lambda: Request("x", "d", ("a",), "sound")):
        with pytest.raises(SearchError):
            bad()
    with pytest.raises(SearchError):
        bm25.search(segments, Request("red fox", "x", ("a",), "exact"))


@pytest.fixture
def sample(spark):
    """A small cookery: dishes, a note on one, and an edge with a text of its own."""
    nodes = [
        (1, ["Dish"], {"db_type": "winter", "name": "barley soup", "summary": "SLOW_COOKED_STOCK_BASE", "tags": ["hearty", "soup barley", 3, None]}),
        (2, ["Note"], {"db_type": "winter", "name": "barley soaking", "summary": "the soup"}),
        (3, ["Dish"], {"db_type": "summer", "name": "barley soup"}),
        (4, ["Menu"], {"db_type": "winter", "name": "barley soup"}),
        (5, ["Dish"], {"name": "barley soup"}),
    ]
    g = Graph.from_json(spark, nodes, [(1, 1, 2, "NEEDS", {"db_type": "winter", "remark": "barley overnight"})])
    g.fulltext["i"] = FullTextIndex("i", ("Dish", "Note"), ("name", "summary", "tags"))
    g.fulltext["e"] = FullTextIndex("e", ("NEEDS",), ("remark",), "edge")
    return g


def hits(g, text, **options):
    found, _ = g.fulltext["i"].hits(g, text, {"db_type": "winter", **options})
    return sorted(r["doc"] for r in found.collect())


def test_graph_index(sample):
    assert hits(sample, "barley soup", fields=["name", "summary"]) == [1, 2]
    assert hits(sample, "barley soup", fields=["name", "summary"], channel="phrase") == [1]
    assert hits(sample, "barley soup", fields=["tags"], channel="phrase") == []
    assert hits(sample, "barley soup", fields=["tags"]) == [1]
    assert hits(sample, "slow_cooked_stock_base", channel="exact") == [1]
    assert hits(sample, "barley", fields=["name"], channel="exact") == [1, 2]
    assert hits(sample, "barley", labels=["Note"]) == [2]
    for bad in ({"fields": ["none"]}, {"db_type": ""}, {"what": 1}):
        with pytest.raises(SearchError):
            hits(sample, "barley", **bad)


def test_procedures(sample):
    q = "CALL db.index.fulltext.queryNodes('i', 'barley', {db_type: 'winter'}) YIELD node AS n, score WHERE score > 0 MATCH (n)-[:NEEDS]->(m) RETURN id(n) AS n, id(m) AS m"
    assert rows(sample.query(q)) == [(1, 2)]
    q = "CALL db.index.fulltext.queryRelationships('e', 'overnight', {db_type: 'winter'}) YIELD relationship AS r, score RETURN id(r) AS r"
    assert rows(sample.query(q)) == [(1,)]
    q = "CALL kb.searchNodes('barley soup', {fields: ['name'], limit: 2}) YIELD node, rank, mode RETURN id(node) AS n, rank, mode"
    assert rows(sample.query(q)) == [(1, 1, "bounded_scan"), (3, 2, "bounded_scan")]
    q = "CALL kb.searchNodes('barley', {fields: ['name'], labels: ['Dish'], indexes: 'auto', db_type: 'winter'}) YIELD node, mode RETURN id(node) AS n, mode"
    assert rows(sample.query(q)) == [(1, "indexed")]


def test_automatic_choice():
    def index(name, *fields):
        return FullTextIndex(name, ("A", "B"), fields)

    found = {i.name: i for i in (index("zname", "name"), index("wide", "name", "summary"), FullTextIndex("scoped", ("A",), ("summary",)), index("aname", "name"))}
    assert [i.name for i in automatic(found, ["A", "B"], ["summary", "name"])] == ["wide", "aname"]


def test_search_statement(spark, sample):
    s = Session(spark)
    s.register_graph("kb", sample)
    s.indexes["kb", "i"] = sample.fulltext["i"]
    out = s.sql("""SEARCH FULLTEXT GRAPH INDEX i ON kb FOR 'barley' OPTIONS '{"db_type": "winter"}'""")
    assert len(out.columns) == 12 and [r["entity_id"] for r in out.collect()] == sorted([1, 2], key=lambda d: [r["entity_id"] for r in out.collect()].index(d))


def test_fusion(spark):
    streams = spark.createDataFrame([(0, 1, 10), (0, 2, 11), (1, 1, 11), (1, 2, 12)], "stream int, rank int, doc bigint")
    assert [r["doc"] for r in fusion.round_robin(streams, 10).collect()] == [10, 11, 12]
    best = fusion.reciprocal_rank(streams).first()
    assert best["doc"] == 11 and abs(best["score"] - (1 / 62 + 1 / 61)) < 1e-12


def test_maintenance(spark, tmp_path, sample):
    m = Maintainer(spark, tmp_path.as_uri())
    index = sample.fulltext["i"]
    m.record(index.segments(sample))
    assert m.covered() == 0
    report = m.wait(60)
    assert (report.status, report.covered_seq) == ("READY", 1)
    index.maintained = m
    assert hits(sample, "barley", consistency="eventual") == [1, 2]
    changed, _ = sample.write("MATCH (n:Note) SET n.name = 'something else'")
    changed.fulltext["i"] = index
    assert hits(changed, "barley", consistency="eventual") == [1]  # the stale document is left out
    assert hits(changed, "something", consistency="eventual") == []
    m.record(index.segments(changed))
    m.paused = True
    assert m.wait(1).status == "PAUSED"
    m.paused = False
    assert m.sync() == 2
    assert hits(changed, "something", consistency="eventual") == [2]
    m.record(index.segments(changed).limit(0), deleted=spark.createDataFrame([(2,)], "doc bigint"))
    m.sync()
    assert 2 not in [r["doc"] for r in m.segments().collect()]


def test_index_statements(spark, tmp_path, sample):
    s = Session(spark, tmp_path.as_uri())
    sample.fulltext.clear()
    s.register_graph("kb", sample)
    s.execute("CREATE FULLTEXT GRAPH INDEX t ON kb NODES LABEL (\"Dish\", \"Note\") (name, summary, tags)")
    s.execute("CREATE UNIQUE GRAPH INDEX u ON kb NODES LABEL \"Note\" (name)")
    assert s.sql("SHOW GRAPH INDEXES ON kb").first()["is_unique"]
    search = """SEARCH FULLTEXT GRAPH INDEX t ON kb FOR 'soaking' OPTIONS '{"db_type": "winter", "consistency": "%s"}'"""
    assert s.sql(search % "eventual").count() == 0
    assert s.sql("ALTER FULLTEXT GRAPH INDEX t ON kb WAIT").first()["status"] == "READY"
    assert s.sql(search % "eventual").count() == s.sql(search % "strict").count() == 1
    s.execute("CYPHER kb 'MATCH (n:Note) SET n.name = \"gone\"'")
    assert s.sql(search % "eventual").count() == s.sql(search % "strict").count() == 0
    s.execute("ALTER FULLTEXT GRAPH INDEX t ON kb PAUSE")
    assert s.sql("ALTER FULLTEXT GRAPH INDEX t ON kb WAIT").first()["status"] == "PAUSED"
    s.execute("ALTER FULLTEXT GRAPH INDEX t ON kb RESUME; ALTER FULLTEXT GRAPH INDEX t ON kb SYNC")
    row = s.sql("SHOW FULLTEXT GRAPH INDEXES ON kb").first()
    assert (row["covered_source_seq"], row["source_seq"], row["status"], len(row)) == (2, 2, "READY", 20)
    s.execute("DROP FULLTEXT GRAPH INDEX t ON kb; DROP GRAPH INDEX u ON kb")
    assert s.sql("SHOW FULLTEXT GRAPH INDEXES ON kb").count() == 0


def test_stored_postings_answer_like_a_scan(spark, tmp_path):
    """Every channel, over generations: changed, added and deleted documents."""
    from lodestone.operators.text.stored import StoredIndex

    def frame(docs):
        return spark.createDataFrame([(d, "x" if d % 3 else "y", f, k, t) for d, fs in docs.items() for f, ts in fs.items() for k, t in enumerate(ts)], "doc bigint, domain string, field string, segment int, text string")

    docs = {d: {"a": [f"red fox {d % 4} jumps", "茶水壶 tea"], "b": [f"word{d} red" if d % 2 else "茶水"]} for d in range(1, 40)}
    index = StoredIndex(spark, tmp_path.as_uri())
    index.write(frame(docs))
    asks = [Request("red fox", "x", ("a", "b")), Request("茶水", "x", ("b", "a")), Request("水壶 tea", "x", ("a",), "phrase"), Request("茶水壶", "x", ("a",), "exact", None), Request("word7", "x", ("b",)), Request("nowhere", "x", ("a",))]

    def same():
        whole = frame(docs)
        for r in asks:
            got, want = index.search(r).collect(), bm25.search(whole, r).collect()
            assert [(x["doc"], round(x["score"], 9), x["best_field"], x["first_hit"]) for x in got] == [(x["doc"], round(x["score"], 9), x["best_field"], x["first_hit"]) for x in want] or r.limit is None and {x["doc"] for x in got} == {x["doc"] for x in want}

    same()
    for changed, gone in (({7: {"a": ["blue fox"]}, 50: {"b": ["red 茶水壶"]}}, [8]), ({50: {"b": ["word7 red"]}, 8: {"a": ["red fox again"]}}, [7, 10])):
        index.write(frame(changed), spark.createDataFrame([(d,) for d in gone], "doc bigint"))
        for d in gone:
            docs.pop(d, None)
        docs.update(changed)
        same()
    assert index.generation() == 2 and StoredIndex(spark, tmp_path.as_uri()).generation() == 2
    plan = index.search(asks[0])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(domain)" in plan.replace("...", "") or "EqualTo(domain,x)" in plan


def test_phrase_counts_have_no_limit(spark, tmp_path):
    """More documents hold the phrase than a ranked search returns."""
    from lodestone.queries_text import t_procedure

    docs = spark.range(1300).selectExpr("id AS doc_id", "concat('all rights reserved ', id) AS text", "'en' AS lang", "concat('src', id % 2) AS source")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(t_procedure(spark, str(tmp_path))) == [("src0", 650), ("src1", 650)]


def test_tokens_take_one_pass(spark):
    """The text's runs are drawn once for each kind of text, and a plain explode's filter doesn't draw them again."""
    from lodestone.operators.text.analyzer import tokenised

    texts = spark.createDataFrame([(1, "x", "a", 0, "Red fox red"), (1, "x", "a", 1, "fox 茶水"), (2, "x", "a", 0, ""), (2, "x", "b", 0, None)], "doc bigint, domain string, field string, segment int, text string")
    plan = tokenised(texts, "terms")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 3
    assert rows(bm25.lengths(texts, "terms")) == [("x", "a", 1, 7)]
    assert rows(bm25.document_frequencies(texts, "phrase")) == [("x", "a", t, 1) for t in ("fox", "red", "水", "茶")]
    assert rows(bm25.document_tokens(texts, "terms")) == [(1, 7, 5, 2)]


def test_a_timeout_leaves_the_batches_running(spark, tmp_path):
    m = Maintainer(spark, tmp_path.as_uri())
    m.record(spark.createDataFrame([(d, "x", "a", 0, f"red fox {d}") for d in range(9)], "doc bigint, domain string, field string, segment int, text string"))
    first = m.wait(0.01)
    assert first.status == "TIMEOUT" and m._running is not None and m._running.isActive
    assert next(r for r in iter(lambda: m.wait(20), None) if r.status != "TIMEOUT").covered_seq == 1
    assert m.postings.generation() == 0
