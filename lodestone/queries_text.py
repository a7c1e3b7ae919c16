"""Queries of the full-text surface over documents: domain is the language, fields are text and source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.attachments import matches
from lodestone.operators.graph import Graph
from lodestone.operators.text import bm25, fusion
from lodestone.operators.text.analyzer import tokenised
from lodestone.operators.text.bm25 import Request
from lodestone.operators.text.index import FullTextIndex
from lodestone.operators.text.scan import scan_search
from lodestone.operators.text.stored import StoredIndex
from lodestone.session import Session
from lodestone.sources.scratch import shared_place

DOMAIN = "en"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fields of each document in long form."""
    docs = documents(spark, sf_dir)
    parts = F.array(F.struct(F.lit("text").alias("field"), F.col("text").alias("text")), F.struct(F.lit("source").alias("field"), F.col("source").alias("text")))
    return docs.select(F.col("doc_id").alias("doc"), F.col("lang").alias("domain"), F.explode(parts).alias("p")).select("doc", "domain", "p.field", F.lit(0).alias("segment"), "p.text").where("text is not null")


def t_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.document_tokens(segments(spark, sf_dir).where("field = 'text'"), "terms")


def t_postings_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.document_frequencies(segments(spark, sf_dir), "terms").where("df >= 5")


def t_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.field_statistics(bm25.lengths(segments(spark, sf_dir), "terms"))


#: Indexes by context, table and the table's files, so that a table is indexed once and again when it changes.
_STORED: dict[tuple, StoredIndex] = {}


def stored_index(spark: SparkSession, sf_dir: str) -> StoredIndex:
    """The stored index of the documents, built when it is first asked for."""
    files = tuple(sorted(documents(spark, sf_dir).inputFiles()))
    key = (spark.sparkContext.applicationId, sf_dir, files)
    if key not in _STORED:
        index = StoredIndex(spark, shared_place(spark, "documents-index"))
        index.write(segments(spark, sf_dir))
        _STORED[key] = index
    return _STORED[key]


def _search(spark: SparkSession, sf_dir: str, text: str, **options) -> DataFrame:
    request = Request(text, DOMAIN, options.pop("fields", ("text", "source")), **options)
    return stored_index(spark, sf_dir).search(request)


def t_bm25_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "the tion of", limit=50).select("doc", F.round("score", 6).alias("score"), "best_field")


def t_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "SRC3", fields=("source",), channel="exact", limit=100).select("doc", F.round("score", 6).alias("score"))


def t_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "all rights reserved", fields=("text",), channel="phrase", limit=1000).select("doc", F.round("score", 6).alias("score"))


def t_search_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_search(documents(spark, sf_dir), "mit license", ["text", "source"], doc="doc_id", limit=100)


def t_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = fusion.ranked(_search(spark, sf_dir, "rights reserved", fields=("text",), limit=30), 0, [F.desc("score"), F.asc("doc")], most=30)
    scan = fusion.ranked(scan_search(documents(spark, sf_dir), "mit license", ["text"], doc="doc_id", limit=30), 1, [F.desc("rank"), F.asc("doc")], most=30)
    return fusion.round_robin(words.union(scan), 40)


def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = fusion.ranked(_search(spark, sf_dir, "rights reserved", fields=("text",), limit=30), 0, [F.desc("score"), F.asc("doc")], most=30)
    scan = fusion.ranked(scan_search(documents(spark, sf_dir), "reserved", ["text"], doc="doc_id", limit=30), 1, [F.desc("rank"), F.asc("doc")], most=30)
    return fusion.reciprocal_rank(words.union(scan), limit=40).select("doc", F.round("score", 9).alias("score"), "n_streams")


def t_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = segments(spark, sf_dir)
    hits = _search(spark, sf_dir, "license", fields=("text",), limit=50)
    return bm25.with_evidence(hits, own).select("doc", "best_field", "byte_offset", "line_number", F.contains(F.lower("snippet"), F.lit("license")).alias("shows"))


def t_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of a literal in every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return matches(pages, "</article>", "page_id", "html").select("page_id", "match_no", "line_number", "byte_offset")


def t_cjk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of CJK characters between others, in the channel that takes single characters and pairs."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    mixed = nations.select("n_nationkey", F.concat("n_name", F.lit(" 茶水壶 "), F.col("n_nationkey").cast("string"), F.lit(" 한국")).alias("text"))
    return tokenised(mixed, "terms")


def t_maintained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that a journal feeds, read eventually after WAIT: all documents, in whatever state the graph is."""
    s = Session(spark, shared_place(spark, "store"))
    s.register_graph("kb", document_graph(spark, sf_dir))
    s.execute("CREATE FULLTEXT GRAPH INDEX held ON kb NODES LABEL (\"Document\") (text, name)")
    status = "TIMEOUT"
    while status == "TIMEOUT":  # the batches go on; an index of many documents takes longer than one wait
        status = s.sql("ALTER FULLTEXT GRAPH INDEX held ON kb WAIT").first()["status"]
    out = s.sql("""SEARCH FULLTEXT GRAPH INDEX held ON kb FOR 'license' OPTIONS '{"db_type": "en", "fields": ["text"], "limit": 50, "consistency": "eventual"}'""")
    return out.select("entity_id", F.round("score", 6).alias("score"), "consistency", "covered_source_seq", F.lit(status).alias("status"))


def t_grep_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A literal in attachments: the nations of each region as one file, in two chunks."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    bodies = nations.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]), "\n").alias("body"))
    half = (F.char_length("body") / 2).cast("int")
    parts = F.array(F.struct(F.lit(0).alias("ordinal"), F.substring("body", F.lit(1), half).alias("d")), F.struct(F.lit(1).alias("ordinal"), F.substring(F.col("body"), half + 1, F.char_length("body")).alias("d")))
    data = bodies.select(F.concat(F.lit("file"), "n_regionkey").alias("attachment_id"), F.lit("s").alias("session_id"), F.lit("txt").alias("format"), F.explode(parts).alias("p"))
    s = Session(spark)
    s.register("attachment$files", bodies.select(F.concat(F.lit("file"), "n_regionkey").alias("attachment_id"), F.lit(7).alias("user_id"), F.concat(F.lit("region "), "n_regionkey").alias("filename")))
    s.register("attachment$data", data.select("attachment_id", "session_id", "format", "p.ordinal", F.encode("p.d", "UTF-8").alias("data")))
    return s.sql("SELECT attachment_id, filename, user_id, byte_len, searchable, match_no, line_number, byte_offset, scan_snapshot FROM attachment_grep('NATION_1')")


def document_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Documents as nodes (db_type: language), sources as nodes, FROM edges."""
    docs = documents(spark, sf_dir)
    sources = docs.select("source").where("source is not null").distinct().withColumn("id", F.lit(1 << 40) + F.regexp_extract("source", "[0-9]+", 0).try_cast("bigint"))
    nodes = docs.select(F.col("doc_id").alias("id"), F.array(F.lit("Document")).alias("labels"), F.col("text").alias("p_text"), F.col("source").alias("p_name"), F.col("lang").alias("p_db_type"))
    nodes = nodes.unionByName(sources.select("id", F.array(F.lit("Source")).alias("labels"), F.lit(None).cast("string").alias("p_text"), F.col("source").alias("p_name"), F.lit("none").alias("p_db_type")))
    edges = docs.join(sources, "source").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("src"), F.col("id").alias("dst"), F.lit("FROM").alias("type"))
    out = Graph(nodes, edges)
    out.fulltext["docs"] = FullTextIndex("docs", ("Document",), ("text", "name"))
    return out


def t_procedure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All full-text hits inside a graph pattern, counted by source."""
    return document_graph(spark, sf_dir).query(
        "CALL db.index.fulltext.queryNodes('docs', 'all rights reserved', {db_type: 'en', channel: 'phrase', fields: ['text'], limit: null}) YIELD node AS d, score "
        "MATCH (d)-[:FROM]->(s:Source) RETURN s.name AS source, count(*) AS n"
    )


def t_search_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(spark)
    g = document_graph(spark, sf_dir)
    s.register_graph("kb", g)
    s.indexes["kb", "docs"] = g.fulltext["docs"]
    out = s.sql("""SEARCH FULLTEXT GRAPH INDEX docs ON kb FOR 'license' OPTIONS '{"db_type": "en", "fields": ["text"], "limit": 50}'""")
    return out.select("entity_id", "best_field", "line_number", "byte_offset", "db_type", "channel", "consistency")


def t_search_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_graph(spark, sf_dir).query("CALL kb.searchNodes('src1', {fields: ['name'], labels: ['Source'], limit: 20}) YIELD node, rank, mode RETURN node.name AS name, rank, mode")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 and scan hits fused round robin, with the labels of the documents found."""
    words = fusion.ranked(_search(spark, sf_dir, "the of", limit=20), 0, [F.desc("score"), F.asc("doc")], most=20)
    scan = fusion.ranked(scan_search(documents(spark, sf_dir), "license", ["text"], doc="doc_id", limit=20), 1, [F.desc("rank"), F.asc("doc")], most=20)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return fusion.round_robin(words.union(scan), 20).join(labels, F.col("doc") == F.col("doc_id"), "left").select("doc", "rank", "stream", "quality")


QUERIES = {f.__name__: f for f in (t_tokens, t_postings_df, t_statistics, t_bm25_terms, t_exact, t_phrase, t_search_scan, t_round_robin, rrf_hybrid, t_snippet, t_grep, t_cjk, t_maintained, t_grep_attachments, t_procedure, t_search_statement, t_search_nodes)}

_TOKENS = r"""
    segs AS (SELECT doc_id AS doc, lang AS domain, 'text' AS field, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, lang, 'source', source FROM documents WHERE source IS NOT NULL),
    toks AS (SELECT doc, domain, field, unnest(list) AS term, generate_subscripts(list, 1) - 1 AS pos FROM (SELECT doc, domain, field, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+') AS list FROM segs))"""


def _bm25(terms: list[str], fields: list[str], limit: int, columns: str = "doc, round(score, 6) AS score") -> str:
    """The ranking in SQL, for terms that each have to be met."""
    wanted, shown = ", ".join(f"'{t}'" for t in terms), ", ".join(f"'{f}'" for f in fields)
    order = " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(fields))
    return f"""WITH {_TOKENS},
    own AS (SELECT * FROM toks WHERE domain = '{DOMAIN}' AND field IN ({shown})),
    lens AS (SELECT field, doc, count(*) AS len FROM own GROUP BY ALL),
    stats AS (SELECT field, count(*) AS n, sum(len) / count(*) AS mean FROM lens GROUP BY field),
    tf AS (SELECT field, doc, term, count(*) AS tf FROM own WHERE term IN ({wanted}) GROUP BY ALL),
    df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL),
    parts AS (SELECT doc, field, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * len / mean)) AS s
              FROM tf JOIN df USING (field, term) JOIN lens USING (field, doc) JOIN stats USING (field)),
    by_field AS (SELECT doc, field, sum(s) AS s FROM parts GROUP BY ALL),
    docs AS (SELECT doc, count(DISTINCT term) AS k FROM parts GROUP BY doc HAVING count(DISTINCT term) = {len(terms)}),
    scored AS (SELECT doc, sum(s) AS score, first(field ORDER BY s DESC, CASE field {order} END) AS best_field FROM by_field JOIN docs USING (doc) GROUP BY doc)
    SELECT {columns} FROM scored ORDER BY score DESC, doc LIMIT {limit}"""


_FIRST = "instr(lower(text), 'license')"


def _licensed(columns: str) -> str:
    return f"""WITH hits AS ({_bm25(['license'], ['text'], 50, 'doc')})
    SELECT {columns} FROM (SELECT doc, text, substr(text, 1, {_FIRST} - 1) AS before FROM hits JOIN documents ON doc = doc_id)"""


ORACLE_SQL = {
    "t_tokens": f"WITH {_TOKENS} SELECT doc, count(*) AS n_tokens, count(DISTINCT term) AS n_terms, max(pos) AS last_at FROM toks WHERE field = 'text' GROUP BY doc",
    "t_postings_df": f"WITH {_TOKENS} SELECT domain, field, term, count(DISTINCT doc) AS df FROM toks WHERE octet_length(encode(term)) <= 512 GROUP BY ALL HAVING count(DISTINCT doc) >= 5",
    "t_statistics": f"WITH {_TOKENS}, lens AS (SELECT domain, field, doc, count(*) AS len FROM toks GROUP BY ALL) SELECT domain, field, count(*) AS n_docs, CAST(sum(len) AS BIGINT) AS total_len FROM lens GROUP BY ALL",
    "t_bm25_terms": _bm25(["of", "the", "tion"], ["text", "source"], 50, "doc, round(score, 6) AS score, best_field"),
    "t_exact": _bm25(["src3"], ["source"], 100),
    "t_search_scan": "SELECT doc_id AS doc, 0 AS rank FROM documents WHERE (contains(lower(text), 'mit') OR contains(lower(source), 'mit')) AND (contains(lower(text), 'license') OR contains(lower(source), 'license')) ORDER BY doc_id LIMIT 100",
    "t_round_robin": f"""WITH a AS (SELECT doc, row_number() OVER (ORDER BY score DESC, doc) AS rank, 0 AS stream FROM ({_bm25(['reserved', 'rights'], ['text'], 30, 'doc, score')})),
        b AS (SELECT doc_id AS doc, row_number() OVER (ORDER BY doc_id) AS rank, 1 AS stream FROM documents WHERE contains(lower(text), 'mit') AND contains(lower(text), 'license') QUALIFY rank <= 30),
        f AS (SELECT doc, rank, stream, row_number() OVER (PARTITION BY doc ORDER BY rank, stream) AS k FROM (SELECT * FROM a UNION ALL SELECT * FROM b))
        SELECT doc, rank, stream FROM f WHERE k = 1 ORDER BY rank, stream LIMIT 40""",
    "rrf_hybrid": f"""WITH a AS (SELECT doc, row_number() OVER (ORDER BY score DESC, doc) AS rank, 0 AS stream FROM ({_bm25(['reserved', 'rights'], ['text'], 30, 'doc, score')})),
        b AS (SELECT doc_id AS doc, row_number() OVER (ORDER BY doc_id) AS rank, 1 AS stream FROM documents WHERE contains(lower(text), 'reserved') QUALIFY rank <= 30)
        SELECT doc, round(score, 9) AS score, n_streams FROM (SELECT doc, sum(1.0::DOUBLE / (60 + rank)) AS score, count(*) AS n_streams FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc) ORDER BY score DESC, doc LIMIT 40""",
    "t_snippet": _licensed("doc, 'text' AS best_field, octet_length(encode(before)) AS byte_offset, length(before) - length(replace(before, chr(10), '')) + 1 AS line_number, true AS shows"),
    "t_search_statement": _licensed("doc AS entity_id, 'text' AS best_field, length(before) - length(replace(before, chr(10), '')) + 1 AS line_number, octet_length(encode(before)) AS byte_offset, 'en' AS db_type, 'terms' AS channel, 'strict' AS consistency"),
    "t_procedure": f"WITH {_TOKENS} SELECT source, count(*) AS n FROM documents WHERE lang = 'en' AND doc_id IN (SELECT a.doc FROM toks a JOIN toks b ON a.doc = b.doc AND b.pos = a.pos + 1 JOIN toks c ON a.doc = c.doc AND c.pos = a.pos + 2 WHERE a.field = 'text' AND b.field = 'text' AND c.field = 'text' AND a.term = 'all' AND b.term = 'rights' AND c.term = 'reserved') GROUP BY source",
    "t_cjk": """SELECT n_nationkey, unnest([lower(n_name), '茶', '水', '壶', '茶水', '水壶', CAST(n_nationkey AS VARCHAR), '한', '국', '한국']) AS term, unnest([0, 1, 2, 3, 1, 2, 4, 5, 6, 5]) AS "at" FROM nation""",
    "t_maintained": f"SELECT doc AS entity_id, score, 'eventual' AS consistency, 1 AS covered_source_seq, 'READY' AS status FROM ({_bm25(['license'], ['text'], 50)})",
    "t_grep_attachments": """WITH lines AS (SELECT n_regionkey AS r, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS line_number, coalesce(sum(length(n_name) + 1) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM nation)
        SELECT 'file' || r AS attachment_id, 'region ' || r AS filename, 7 AS user_id, (SELECT sum(length(n_name) + 1) - 1 FROM nation WHERE n_regionkey = r) AS byte_len, true AS searchable, 0 AS scan_snapshot, row_number() OVER (PARTITION BY r ORDER BY line_number) - 1 AS match_no, line_number, CAST(place AS BIGINT) AS byte_offset FROM lines WHERE starts_with(n_name, 'NATION_1')""",
    "t_search_nodes": "SELECT name, row_number() OVER (ORDER BY r DESC, id) AS rank, 'bounded_scan' AS mode FROM (SELECT DISTINCT source AS name, CASE WHEN source = 'src1' THEN 2 ELSE 1 END AS r, CAST(substr(source, 4) AS BIGINT) AS id FROM documents WHERE contains(source, 'src1'))",
    "t_phrase": f"WITH {_TOKENS}, hit AS (SELECT DISTINCT a.doc FROM toks a JOIN toks b ON a.doc = b.doc AND b.pos = a.pos + 1 JOIN toks c ON a.doc = c.doc AND c.pos = a.pos + 2 WHERE a.field = 'text' AND b.field = 'text' AND c.field = 'text' AND a.domain = 'en' AND a.term = 'all' AND b.term = 'rights' AND c.term = 'reserved') SELECT doc, round(score, 6) AS score FROM (" + _bm25(["all", "reserved", "rights"], ["text"], 1_000_000, "doc, score") + ") JOIN hit USING (doc) ORDER BY score DESC, doc LIMIT 1000",
    "t_grep": """SELECT page_id, k - 1 AS match_no, length(before) - length(replace(before, chr(10), '')) + 1 AS line_number, octet_length(encode(before)) AS byte_offset
        FROM (SELECT page_id, k, array_to_string(list_slice(parts, 1, k), '</article>') AS before
              FROM (SELECT page_id, string_split(html, '</article>') AS parts, unnest(range(1, len(string_split(html, '</article>')))) AS k FROM pages))""",
}
