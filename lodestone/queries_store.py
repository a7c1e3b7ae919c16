"""Queries over what a stored session keeps: graphs, snapshots, dictionary tables, constraints, isolation, budgets, profiles."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.graph import Graph
from lodestone.operators.graph.language import GraphError
from lodestone.plans.lexer import SqlError
from lodestone.queries_graph import star_graph
from lodestone.queries_sql import session
from lodestone.session import Session
from lodestone.sources.scratch import shared_place


def _stored(spark: SparkSession, sf_dir: str) -> Session:
    """A session with a folder of its own, a graph of the nations in it, and a table of the orders."""
    s = session(spark, sf_dir, shared_place(spark, "store"))
    s.execute("CREATE GRAPH atlas")
    names = [r["n_name"] for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name").collect()]  # 25 rows at every size
    s.execute(f"CYPHER atlas 'UNWIND $names AS n CREATE (:Nation {{name: n}})' PARAMETERS '{json.dumps({'names': names})}'")
    s.execute("CREATE TABLE held (id INTEGER NOT NULL, status VARCHAR2(4), price NUMBER)")
    s.execute("INSERT INTO held SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
    return s


def s_graph_transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rolled-back deletion and a committed change, read by another session."""
    s = _stored(spark, sf_dir)
    s.execute("BEGIN; CYPHER atlas 'MATCH (n:Nation) DELETE n'; ROLLBACK")
    s.execute("BEGIN; CYPHER atlas 'MATCH (n:Nation) SET n.seen = true'; DELETE FROM held WHERE status = 'O'; COMMIT")
    again = Session(spark, s.store.folder)
    return again.sql("SELECT name, seen FROM GRAPH_TABLE(atlas, 'MATCH (n:Nation) RETURN n.name AS name, toString(n.seen) AS seen' COLUMNS (name VARCHAR2(99), seen VARCHAR2(9)))")


def s_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An open transaction's session, another one, and the second after the commit."""
    s = _stored(spark, sf_dir)
    other = Session(spark, s.store.folder)
    count = "SELECT count(*) AS n FROM held"
    s.execute("BEGIN; DELETE FROM held WHERE status = 'F'")
    inside, outside = s.sql(count), other.sql(count)
    s.execute("COMMIT")
    later = Session(spark, s.store.folder).sql(count)
    return inside.withColumn("who", F.lit("inside")).union(outside.withColumn("who", F.lit("outside"))).union(later.withColumn("who", F.lit("later")))


def s_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects, columns and indexes as tables."""
    s = _stored(spark, sf_dir)
    s.execute("CREATE UNIQUE INDEX held_id ON held (id)")
    shown = s.sql("SELECT table_name AS name, column_name AS part, type AS what FROM col$")
    return shown.union(s.sql("SELECT name, kind FROM obj$").withColumn("what", F.concat("kind", F.lit("")))).union(s.sql("SELECT index_name, table_name, columns FROM ind$"))


def s_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One part for each INSERT, and the version that the statements made."""
    s = _stored(spark, sf_dir)
    s.execute("INSERT INTO held (id) VALUES (-1)")
    parts = s.sql("SELECT table_name, count(*) AS n FROM file$ GROUP BY table_name")
    return parts.crossJoin(s.sql("SELECT version, in_transaction FROM recovery$"))


def s_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).sql("DESCRIBE held")


def s_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that break a rule are refused, and leave the table as it was."""
    s = _stored(spark, sf_dir)
    s.execute("CREATE UNIQUE INDEX held_id ON held (id)")
    tries = {"null": "INSERT INTO held (status) VALUES ('x')", "length": "UPDATE held SET status = 'longer'", "unique": "INSERT INTO held (id) SELECT min(o_orderkey) FROM orders", "kind": "INSERT INTO held (id) VALUES ('x')", "fine": "INSERT INTO held (id) VALUES (-5)"}
    refused = {}
    for name, text in tries.items():
        try:
            s.execute(text)
            refused[name] = False
        except SqlError:
            refused[name] = True
    return spark.createDataFrame(list(refused.items()), "rule string, refused boolean").crossJoin(s.sql("SELECT count(*) AS n FROM held"))


def s_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the dialect doesn't take is an error of its own."""
    s = session(spark, sf_dir)
    tries = {
        "grouping": "SELECT n_name, count(*) AS n FROM nation", "like": "SELECT n_name FROM nation WHERE n_name LIKE 'A%'", "over": "SELECT count(*) OVER () AS n FROM nation", "subquery": "SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region)",
        "function": "SELECT upper(n_name) AS n FROM nation", "kinds": "SELECT n_name FROM nation WHERE n_name = 1", "right": "SELECT n_name FROM nation RIGHT JOIN region ON n_regionkey = r_regionkey", "parameter": "SELECT n_name FROM nation WHERE n_name = :x", "fine": "SELECT n_name FROM nation",
    }
    refused = {}
    for name, text in tries.items():
        try:
            s.sql(text)
            refused[name] = False
        except SqlError:
            refused[name] = True
    return spark.createDataFrame(list(refused.items()), "what string, refused boolean")


def s_show_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs and their index declarations, after the session is opened anew."""
    s = _stored(spark, sf_dir)
    s.execute("CREATE UNIQUE GRAPH INDEX by_name ON atlas NODES LABEL \"Nation\" (name)")
    again = Session(spark, s.store.folder)
    return again.sql("SHOW GRAPHS").select("graph_name").crossJoin(again.sql("SHOW GRAPH INDEXES ON atlas").select("index_name", "label_type", "is_unique"))


def s_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole star graph saved, restored and read."""
    place = shared_place(spark, "snapshot")
    star_graph(spark, sf_dir).save(place)
    return Graph.load(spark, place).query("MATCH (a)-[e]->(b) RETURN type(e) AS t, count(*) AS n")


def s_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget that holds and one that is exceeded, of each kind; never a shorter answer."""
    g = Graph(*(df.where(only) for df, only in ((star_graph(spark, sf_dir).nodes, "array_contains(labels, 'Nation') or array_contains(labels, 'Region')"), (star_graph(spark, sf_dir).edges, "type = 'IN_REGION'"))))
    text, tries = "MATCH (n:Nation)-[e:IN_REGION]->(r:Region) RETURN n.name AS n", {"max_rows": 25, "max_expansions": 25, "max_nodes": 30, "max_edges": 25}
    out = []
    for name, most in tries.items():
        for allowed in (most, most - 1):
            try:
                out.append((name, allowed, g.query(text, budgets={name: allowed}).count()))
            except GraphError:
                out.append((name, allowed, None))
    return spark.createDataFrame(out, "budget string, allowed int, n bigint")


def s_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    s.register_graph("star", star_graph(spark, sf_dir))
    return s.sql("PROFILE CYPHER star 'MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN id(o) AS o'").select("rows_returned", "access", (F.col("elapsed_ms") >= 0).alias("timed"), (F.col("entries_read") >= F.col("rows_returned")).alias("read"))


def s_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON paths: a value, whether there is one, and a changed document."""
    s = session(spark, sf_dir)
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    shown = F.struct(F.struct(F.col("n_name").alias("name"), F.array("n_regionkey", "n_nationkey").alias("keys")).alias("nation"))
    s.register("docs", nation.select("n_nationkey", F.to_json(shown).alias("doc")))
    return s.sql("SELECT n_nationkey, json_get(doc, 'nation.name') AS name, json_get(doc, 'nation.keys[1]') AS key, json_exists(doc, 'nation.keys[2]') AS third, json_get(json_set(doc, 'nation.seen', n_nationkey), 'nation.seen') AS seen, json_exists(json_set(doc, 'nation.keys', NULL), 'nation.keys') AS kept FROM docs")


def s_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directory of attachments: every page as a file in chunks of 8 KiB."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("page"), "page_id").alias("attachment_id"), F.encode("html", "UTF-8").alias("body"), "url")
    starts = F.sequence(F.lit(0), F.greatest(F.octet_length("body") - 1, F.lit(0)), F.lit(8192))
    chunks = pages.select("attachment_id", F.lit("s").alias("session_id"), F.lit("html").alias("format"), "body", F.posexplode(starts).alias("ordinal", "at"))
    s = Session(spark)
    s.register("attachment$files", pages.select("attachment_id", F.col("url").alias("filename"), F.lit("text/html").alias("media_type")))
    s.register("attachment$data", chunks.select("attachment_id", "session_id", "format", "ordinal", F.substring(F.col("body"), F.col("at") + 1, F.lit(8192)).alias("data")))
    return s.sql("SELECT attachment_id, session_id, filename, file_type, media_type, byte_len, sha256, searchable, search_mode, user_id IS NULL AS nobody FROM attachment$")


QUERIES = {f.__name__: f for f in (s_json, s_attachments, s_graph_transaction, s_isolation, s_dictionary, s_files, s_describe, s_constraints, s_rejected, s_show_graphs, s_snapshot, s_budgets, s_profile)}

ORACLE_SQL = {
    "s_json": "SELECT n_nationkey, n_name AS name, CAST(n_nationkey AS VARCHAR) AS key, false AS third, CAST(n_nationkey AS VARCHAR) AS seen, true AS kept FROM nation",
    "s_attachments": "SELECT 'page' || page_id AS attachment_id, 's' AS session_id, url AS filename, 'html' AS file_type, 'text/html' AS media_type, octet_length(encode(html)) AS byte_len, sha256(html) AS sha256, true AS searchable, 'literal' AS search_mode, true AS nobody FROM pages WHERE html IS NOT NULL",
    "s_graph_transaction": "SELECT n_name AS name, 'true' AS seen FROM nation",
    "s_isolation": "SELECT count(*) AS n, 'inside' AS who FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT count(*), 'outside' FROM orders UNION ALL SELECT count(*), 'later' FROM orders WHERE o_orderstatus <> 'F'",
    "s_dictionary": "SELECT * FROM (VALUES ('held', 'id', 'integer'), ('held', 'status', 'varchar2'), ('held', 'price', 'number'), ('held', 'table', 'table'), ('atlas', 'graph', 'graph'), ('held_id', 'held', 'id')) t(name, part, what)",
    "s_files": "SELECT 'held' AS table_name, 2 AS n, 5 AS version, false AS in_transaction",
    "s_describe": "SELECT * FROM (VALUES ('id', 'number'), ('status', 'text'), ('price', 'number')) t(column_name, kind)",
    "s_constraints": "SELECT rule, refused, n FROM (VALUES ('null', true), ('length', true), ('unique', true), ('kind', true), ('fine', false)) t(rule, refused), (SELECT count(*) + 1 AS n FROM orders)",
    "s_rejected": "SELECT * FROM (VALUES ('grouping', true), ('like', true), ('over', true), ('subquery', true), ('function', true), ('kinds', true), ('right', true), ('parameter', true), ('fine', false)) t(what, refused)",
    "s_show_graphs": "SELECT 'atlas' AS graph_name, 'by_name' AS index_name, 'Nation' AS label_type, true AS is_unique",
    "s_snapshot": "SELECT 'IN_REGION' AS t, count(*) AS n FROM nation UNION ALL SELECT 'IN_NATION', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) UNION ALL SELECT 'PLACED', count(*) FROM orders UNION ALL SELECT 'CONTAINS', count(*) FROM lineitem UNION ALL SELECT 'SHIPPED_BY', count(*) FROM lineitem",
    "s_budgets": "SELECT b AS budget, m - k AS allowed, CASE WHEN k = 0 THEN (SELECT count(*) FROM nation) END AS n FROM (VALUES ('max_rows', 25), ('max_expansions', 25), ('max_nodes', 30), ('max_edges', 25)) t(b, m), (VALUES (0), (1)) u(k)",
    "s_profile": "SELECT count(*) AS rows_returned, 'scan' AS access, true AS timed, true AS read FROM orders",
}
