"""Queries of the graph surface over a graph that is made of the star-schema tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.graph import Graph
from lodestone.queries_sql import session
from lodestone.session import Session

#: Ids are label number * 2^40 + key, below 2^48.
SHIFT = 1 << 40
LABELS = ("Region", "Nation", "Customer", "Supplier", "Part", "Order")
NODE_PROPS = {"name": "string", "segment": "string", "brand": "string", "status": "string", "priority": "string", "size": "int", "balance": "double", "total": "double"}
EDGE_PROPS = {"qty": "double", "line": "int"}


def _id(label: str, column: str):
    return (F.lit(LABELS.index(label) * SHIFT) + F.col(column)).cast("bigint")


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Typed nodes and edges, as unions whose branches the optimiser drops when a label or type rules them out."""

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def nodes(table: str, label: str, key: str, **props: str) -> DataFrame:
        shown = [(F.col(props[p]) if p in props else F.lit(None)).cast(kind).alias(f"p_{p}") for p, kind in NODE_PROPS.items()]
        return read(table).select(_id(label, key).alias("id"), F.array(F.lit(label)).alias("labels"), *shown)

    def edges(number: int, table: str, type_: str, a: str, a_key: str, b: str, b_key: str, key, **props: str) -> DataFrame:
        shown = [(F.col(props[p]) if p in props else F.lit(None)).cast(kind).alias(f"p_{p}") for p, kind in EDGE_PROPS.items()]
        return read(table).select((F.lit(number * SHIFT) + key).cast("bigint").alias("id"), _id(a, a_key).alias("src"), _id(b, b_key).alias("dst"), F.lit(type_).alias("type"), *shown)

    line = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    all_nodes = [
        nodes("region", "Region", "r_regionkey", name="r_name"),
        nodes("nation", "Nation", "n_nationkey", name="n_name"),
        nodes("customer", "Customer", "c_custkey", name="c_name", segment="c_mktsegment", balance="c_acctbal"),
        nodes("supplier", "Supplier", "s_suppkey", name="s_name", balance="s_acctbal"),
        nodes("part", "Part", "p_partkey", name="p_name", brand="p_brand", size="p_size"),
        nodes("orders", "Order", "o_orderkey", status="o_orderstatus", priority="o_orderpriority", total="o_totalprice"),
    ]
    all_edges = [
        edges(1, "nation", "IN_REGION", "Nation", "n_nationkey", "Region", "n_regionkey", F.col("n_nationkey")),
        edges(2, "customer", "IN_NATION", "Customer", "c_custkey", "Nation", "c_nationkey", F.col("c_custkey")),
        edges(3, "supplier", "IN_NATION", "Supplier", "s_suppkey", "Nation", "s_nationkey", F.col("s_suppkey")),
        edges(4, "orders", "PLACED", "Customer", "o_custkey", "Order", "o_orderkey", F.col("o_orderkey")),
        edges(5, "lineitem", "CONTAINS", "Order", "l_orderkey", "Part", "l_partkey", line, qty="l_quantity", line="l_linenumber"),
        edges(6, "lineitem", "SHIPPED_BY", "Order", "l_orderkey", "Supplier", "l_suppkey", line, line="l_linenumber"),
    ]
    return Graph(reduce(DataFrame.unionAll, all_nodes), reduce(DataFrame.unionAll, all_edges))


def graph_session(spark: SparkSession, sf_dir: str) -> Session:
    out = session(spark, sf_dir)
    out.register_graph("star", star_graph(spark, sf_dir))
    return out


C, O, P, S, N, R = (f"{LABELS.index(x)} * 1099511627776 + " for x in ("Customer", "Order", "Part", "Supplier", "Nation", "Region"))

# name: (graph query, oracle)
STATEMENTS: dict[str, tuple[str, str]] = {
    "g_match_1hop": (
        "MATCH (c:Customer)-[:IN_NATION]->(n:Nation) WHERE c.balance > 9000 RETURN c.name AS customer, n.name AS nation",
        "SELECT c_name AS customer, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000",
    ),
    "g_match_2hop": (
        "MATCH (s:Supplier)-[:IN_NATION]->(:Nation)-[:IN_REGION]->(r:Region {name: 'ASIA'}) RETURN s.name AS supplier, r.name AS region",
        "SELECT s_name AS supplier, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'",
    ),
    "g_reverse": (
        "MATCH (o:Order)<-[:PLACED]-(c:Customer) WHERE o.total > 400000 RETURN id(o) AS o, c.segment AS segment",
        f"SELECT {O} o_orderkey AS o, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 400000",
    ),
    "g_undirected": (
        "MATCH (n:Nation)-[:IN_REGION]-(x) RETURN n.name AS n, x.name AS x",
        "SELECT n_name AS n, r_name AS x FROM nation JOIN region ON n_regionkey = r_regionkey",
    ),
    "g_edge_unique": (
        "MATCH (a:Nation)-[:IN_REGION]->(r:Region)<-[:IN_REGION]-(b:Nation) RETURN a.name AS a, b.name AS b",
        "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey",
    ),
    "g_multi_pattern": (
        "MATCH (c:Customer)-[:IN_NATION]->(n:Nation), (s:Supplier)-[:IN_NATION]->(n) RETURN n.name AS nation, count(*) AS pairs",
        "SELECT n_name AS nation, count(*) AS pairs FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name",
    ),
    "g_type_alternation": (
        "MATCH (o:Order)-[e:CONTAINS|SHIPPED_BY]->(x) WHERE o.total > 450000 RETURN type(e) AS t, e.line AS line, id(x) AS x",
        f"SELECT 'CONTAINS' AS t, l_linenumber AS line, {P} l_partkey AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice > 450000 UNION ALL SELECT 'SHIPPED_BY', l_linenumber, {S} l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice > 450000",
    ),
    "g_prop_map": (
        "MATCH (p:Part {size: 7})<-[e:CONTAINS {line: 1}]-(o:Order {status: 'F'}) RETURN id(o) AS o, p.name AS part, e.qty AS qty",
        f"SELECT {O} o_orderkey AS o, p_name AS part, l_quantity AS qty FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE p_size = 7 AND l_linenumber = 1 AND o_orderstatus = 'F'",
    ),
    "g_optional": (
        "MATCH (c:Customer) WHERE c.balance > 9500 OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.total > 300000 RETURN c.name AS name, id(o) AS o",
        f"SELECT c_name AS name, {O} o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 WHERE c_acctbal > 9500",
    ),
    "g_exists": (
        "MATCH (c:Customer) WHERE c.balance < 0 AND EXISTS { MATCH (c)-[:PLACED]->(o:Order) WHERE o.status = 'P' } RETURN c.name AS name",
        "SELECT c_name AS name FROM customer WHERE c_acctbal < 0 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    ),
    "g_not_exists": (
        "MATCH (p:Part) WHERE NOT EXISTS { MATCH (p)<-[e:CONTAINS]-(:Order) WHERE e.qty > 45 } RETURN p.name AS name",
        "SELECT p_name AS name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)",
    ),
    "g_exists_flag": (
        "MATCH (n:Nation) RETURN n.name AS name, EXISTS { MATCH (n)<-[:IN_NATION]-(:Supplier) } AS has_suppliers",
        "SELECT n_name AS name, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey) AS has_suppliers FROM nation",
    ),
    "g_call": (
        "MATCH (n:Nation) CALL (n) { MATCH (n)<-[:IN_NATION]-(c:Customer) RETURN count(c) AS customers, max(c.balance) AS best } RETURN n.name AS nation, customers, best",
        "SELECT n_name AS nation, count(c_custkey) AS customers, max(c_acctbal) AS best FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name",
    ),
    "g_call_top": (
        "MATCH (r:Region) CALL (r) { MATCH (r)<-[:IN_REGION]-(n:Nation) RETURN n.name AS nation ORDER BY nation LIMIT 2 } RETURN r.name AS region, nation",
        "SELECT r_name AS region, n_name AS nation FROM (SELECT r_name, n_name, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_name) AS k FROM nation JOIN region ON n_regionkey = r_regionkey) WHERE k <= 2",
    ),
    "g_unwind": (
        "UNWIND ['ASIA', 'EUROPE', 'NOWHERE'] AS wanted MATCH (r:Region {name: wanted})<-[:IN_REGION]-(n:Nation) RETURN wanted, n.name AS nation",
        "SELECT r_name AS wanted, n_name AS nation FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE', 'NOWHERE')",
    ),
    "g_with_having": (
        "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(o) AS n, max(o.total) AS top WHERE n > 14 RETURN c.name AS name, n, top",
        "SELECT c_name AS name, count(*) AS n, max(o_totalprice) AS top FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name HAVING count(*) > 14",
    ),
    "g_collect": (
        "MATCH (r:Region)<-[:IN_REGION]-(n:Nation) WITH r, n.name AS nation ORDER BY nation WITH r, collect(nation) AS nations RETURN r.name AS region, size(nations) AS n, reduce(s = 0, x IN nations | s + size(x)) AS letters",
        "SELECT r_name AS region, count(*) AS n, CAST(sum(length(n_name)) AS DECIMAL(38,10)) AS letters FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    ),
    "g_count_distinct": (
        "MATCH (s:Supplier)<-[:SHIPPED_BY]-(o:Order)<-[:PLACED]-(c:Customer) RETURN s.name AS supplier, count(DISTINCT c) AS customers, count(*) AS lines",
        "SELECT s_name AS supplier, count(DISTINCT o_custkey) AS customers, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey GROUP BY s_name",
    ),
    "g_order_skip_limit": (
        "MATCH (p:Part) RETURN p.name AS name, p.size AS size ORDER BY p.size DESC, id(p) SKIP 5 LIMIT 10",
        "SELECT p_name AS name, p_size AS size FROM part ORDER BY p_size DESC, p_partkey LIMIT 10 OFFSET 5",
    ),
    "g_distinct": (
        "MATCH (p:Part) RETURN DISTINCT p.brand AS brand ORDER BY brand",
        "SELECT DISTINCT p_brand AS brand FROM part",
    ),
    "g_union": (
        "MATCH (n:Nation) WHERE n.name STARTS WITH 'NATION_1' RETURN n.name AS name UNION MATCH (r:Region) RETURN r.name AS name",
        "SELECT n_name AS name FROM nation WHERE starts_with(n_name, 'NATION_1') UNION SELECT r_name FROM region",
    ),
    "g_union_all": (
        "MATCH (c:Customer) RETURN c.segment AS x UNION ALL MATCH (p:Part) RETURN p.brand AS x",
        "SELECT c_mktsegment AS x FROM customer UNION ALL SELECT p_brand FROM part",
    ),
    "g_varlen_1_2": (
        "MATCH (s:Supplier)-[path:IN_NATION|IN_REGION*1..2]->(x) RETURN s.name AS s, x.name AS x, size(path) AS hops",
        "SELECT s_name AS s, n_name AS x, 1 AS hops FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT s_name, r_name, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    ),
    "g_varlen_0_1": (
        "MATCH (n:Nation)-[:IN_REGION*0..1]->(x) RETURN n.name AS n, x.name AS x",
        "SELECT n_name AS n, n_name AS x FROM nation UNION ALL SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    ),
    "g_varlen_undirected": (
        "MATCH (r:Region {name: 'ASIA'})-[:IN_REGION*2..2]-(x) RETURN r.name AS r, count(x) AS n",
        "SELECT 'ASIA' AS r, count(*) AS n FROM (SELECT 1 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey JOIN region ON a.n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND false) HAVING count(*) > 0",
    ),
    "g_shortest": (
        "MATCH p = shortestPath((s:Supplier)-[:IN_NATION|IN_REGION*..3]->(r:Region)) RETURN s.name AS s, r.name AS r, length(p) AS hops",
        "SELECT s_name AS s, r_name AS r, 2 AS hops FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    ),
    "g_path_functions": (
        "MATCH p = (c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) WHERE c.balance > 9900 RETURN length(p) AS len, head(nodes(p)) AS first, last(nodes(p)) AS last, size(relationships(p)) AS edges",
        f"SELECT 2 AS len, {C} c_custkey AS first, {R} n_regionkey AS last, 2 AS edges FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9900",
    ),
    "g_list_exprs": (
        "MATCH (n:Nation) WITH n, [toLower(n.name), 'x', n.name] AS l RETURN n.name AS name, l[0] AS a, l[-1] AS z, size(l[1..3]) AS k, 'x' IN l AS has, [y IN l WHERE size(y) > 3 | size(y)][0] AS first_long, any(y IN l WHERE y = 'x') AS some, all(y IN l WHERE size(y) > 0) AS every, single(y IN l WHERE y = 'x') AS one, none(y IN l WHERE y = 'q') AS no",
        "SELECT n_name AS name, lower(n_name) AS a, n_name AS z, 2 AS k, true AS has, CASE WHEN length(n_name) > 3 THEN length(n_name) END AS first_long, true AS some, true AS every, true AS one, true AS no FROM nation",
    ),
    "g_string_preds": (
        "MATCH (n:Nation) WHERE n.name CONTAINS '_1' OR n.name ENDS WITH '0' XOR n.name STARTS WITH 'NATION_2' RETURN n.name AS name, toUpper(trim('  a ')) AS t, toInteger('42') AS i, toString(n.size) AS none, coalesce(n.size, 5) AS five",
        "SELECT n_name AS name, 'A' AS t, 42 AS i, CAST(NULL AS VARCHAR) AS none, 5 AS five FROM nation WHERE contains(n_name, '_1') OR (ends_with(n_name, '0') <> starts_with(n_name, 'NATION_2'))",
    ),
    "g_case_labels": (
        "MATCH (x)-[:IN_NATION]->(n:Nation {name: 'NATION_3'}) RETURN CASE WHEN x:Customer THEN 'c' WHEN x:Supplier THEN 's' END AS kind, labels(x)[0] AS label, count(*) AS n",
        "SELECT 'c' AS kind, 'Customer' AS label, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3' GROUP BY n_name UNION ALL SELECT 's', 'Supplier', count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_3' GROUP BY n_name",
    ),
    "g_aggregates": (
        "MATCH (:Customer)-[:PLACED]->(o:Order)-[e:CONTAINS]->(:Part) RETURN o.priority AS priority, sum(e.line) AS lines, min(o.total) AS lo, max(o.total) AS hi, count(DISTINCT o) AS orders",
        "SELECT o_orderpriority AS priority, CAST(sum(l_linenumber) AS BIGINT) AS lines, min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY o_orderpriority",
    ),
    "g_empty_aggregate": (
        "MATCH (x:Nothing) RETURN count(*) AS n, sum(x.size) AS s, size(collect(x.name)) AS c",
        "SELECT 0 AS n, 0 AS s, 0 AS c",
    ),
}
STATEMENTS["g_varlen_undirected"] = (
    "MATCH (r:Region {name: 'ASIA'})-[:IN_REGION*1..2]-(x) RETURN r.name AS r, x.name AS x",
    "SELECT r_name AS r, n_name AS x FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'",
)


def _statement(text: str):
    return lambda spark, sf_dir: star_graph(spark, sf_dir).query(text)


def g_table_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph rows joined with a table in SQL."""
    return graph_session(spark, sf_dir).sql(
        "SELECT g.nation, g.n, n.n_regionkey FROM GRAPH_TABLE(star, 'MATCH (s:Supplier)-[:IN_NATION]->(n:Nation) RETURN n.name AS nation, count(*) AS n' COLUMNS (nation VARCHAR2(40), n NUMBER)) g JOIN nation n ON n.n_name = g.nation"
    )


def g_create_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes: a node for every region that holds a nation, a relationship to it, a property, and a removal."""
    g = Graph.from_json(spark, [], [])
    g, _ = g.write("UNWIND [1, 1, 2, 1] AS k MERGE (n:Key {k: k}) ON CREATE SET n.hits = 0 ON MATCH SET n.hits = n.hits + 1")
    g, _ = g.write("MATCH (a:Key {k: 1}), (b:Key {k: 2}) CREATE (a)-[:NEXT {w: 5}]->(b)")
    g, _ = g.write("MATCH (a:Key {k: 2}) SET a.name = 'two', a:Last REMOVE a.hits")
    return g.query("MATCH (a:Key)-[e:NEXT]->(b:Last) RETURN a.k AS k, a.hits AS hits, e.w AS w, b.name AS name, b.hits IS NULL AS removed")


def g_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph.from_json(spark, [(1, ["A"], {"v": 1}), (2, ["A"], {"v": 2}), (3, ["B"], {})], [(1, 1, 2, "T", {}), (2, 2, 3, "T", {})])
    g, _ = g.write("MATCH (a:A {v: 2}) DETACH DELETE a")
    return g.query("MATCH (x) OPTIONAL MATCH (x)-[e]->(y) RETURN id(x) AS x, id(e) AS e, id(y) AS y")


def _after(text: str, read: str):
    """A writing query over the whole star graph, then a reading one."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g, _ = star_graph(spark, sf_dir).write(text)
        return g.query(read)

    return run


# name: (writing query, reading query, oracle)
WRITES: dict[str, tuple[str, str, str]] = {
    "g_delete_edges": (
        "MATCH (o:Order)-[e:CONTAINS]->(p:Part) WHERE e.qty > 45 DELETE e",
        "MATCH (o:Order)-[e]->(x) RETURN type(e) AS t, count(*) AS n",
        "SELECT 'CONTAINS' AS t, count(*) AS n FROM lineitem WHERE (l_orderkey, l_linenumber) NOT IN (SELECT (l_orderkey, l_linenumber) FROM lineitem WHERE l_quantity > 45) UNION ALL SELECT 'SHIPPED_BY', count(*) FROM lineitem",
    ),
    "g_detach_delete": (
        "MATCH (p:Part) WHERE p.size > 25 DETACH DELETE p",
        "MATCH (p:Part) OPTIONAL MATCH (p)<-[e:CONTAINS]-() RETURN p.name AS part, count(e) AS n",
        "SELECT p_name AS part, count(l_orderkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey WHERE p_size <= 25 GROUP BY p_name",
    ),
    "g_merge_nodes": (
        "MATCH (c:Customer) MERGE (m:Segment {name: c.segment}) ON CREATE SET m.status = 'new' ON MATCH SET m.status = 'met'",
        "MATCH (m:Segment) RETURN m.name AS name, m.status AS status",
        "SELECT c_mktsegment AS name, CASE WHEN count(*) > 1 THEN 'met' ELSE 'new' END AS status FROM customer GROUP BY c_mktsegment",
    ),
    "g_merge_paths": (
        "MATCH (c:Customer) WHERE c.balance > 5000 MERGE (c)-[:IN_SEGMENT]->(m:Segment {name: c.segment})",
        "MATCH (c:Customer)-[e:IN_SEGMENT]->(m:Segment) RETURN c.name AS customer, m.name AS segment, id(c) > 0 AS known",
        "SELECT c_name AS customer, c_mktsegment AS segment, true AS known FROM customer WHERE c_acctbal > 5000",
    ),
    "g_set_remove": (
        "MATCH (c:Customer) WHERE c.balance < 0 SET c.segment = 'DEBT', c:Debtor REMOVE c.name",
        "MATCH (c:Debtor) RETURN c.segment AS segment, c.name IS NULL AS nameless, count(*) AS n, sum(c.balance) < 0 AS below",
        "SELECT 'DEBT' AS segment, true AS nameless, count(*) AS n, true AS below FROM customer WHERE c_acctbal < 0 HAVING count(*) > 0",
    ),
    "g_create_edges": (
        "MATCH (s:Supplier)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) CREATE (s)-[:SERVES {line: 7}]->(r)",
        "MATCH (s:Supplier)-[e:SERVES]->(r:Region) RETURN s.name AS supplier, r.name AS region, e.line AS line",
        "SELECT s_name AS supplier, r_name AS region, 7 AS line FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    ),
}

STATEMENTS["g_arithmetic"] = (
    "MATCH (p:Part) RETURN p.name AS part, p.size * 2 + 1 - 3 AS a, -p.size AS b, p.size / 4 = p.size * 0.25 AS c",
    "SELECT p_name AS part, p_size * 2 - 2 AS a, -p_size AS b, true AS c FROM part",
)
STATEMENTS["g_reduce"] = (
    "MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r, collect(size(n.name)) AS sizes RETURN r.name AS region, reduce(s = 0, x IN sizes | s + x * x) AS total",
    "SELECT r_name AS region, sum(length(n_name) * length(n_name)) AS total FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
)
STATEMENTS["g_varlen_five"] = (
    "MATCH (o:Order)-[:SHIPPED_BY]->(s:Supplier) WHERE o.total > 450000 WITH DISTINCT s MATCH (s)-[path:IN_NATION|IN_REGION*1..5]->(x) RETURN s.name AS s, x.name AS x, size(path) AS hops",
    "WITH t AS (SELECT DISTINCT s_name, s_nationkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE o_totalprice > 450000) SELECT s_name AS s, n_name AS x, 1 AS hops FROM t JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT s_name, r_name, 2 FROM t JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
)
QUERIES = {name: _statement(text) for name, (text, _) in STATEMENTS.items()}
QUERIES |= {f.__name__: f for f in (g_table_join, g_create_set, g_delete)}
ORACLE_SQL = {name: oracle for name, (_, oracle) in STATEMENTS.items()} | {
    "g_table_join": "SELECT n_name AS nation, count(*) AS n, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name, n_regionkey",
    "g_create_set": "SELECT '1' AS k, '2' AS hits, '5' AS w, 'two' AS name, true AS removed",
    "g_delete": "SELECT * FROM (VALUES (1, NULL::BIGINT, NULL::BIGINT), (3, NULL, NULL)) t(x, e, y)",
}
QUERIES |= {name: _after(text, read) for name, (text, read, _) in WRITES.items()}
ORACLE_SQL |= {name: oracle for name, (_, _, oracle) in WRITES.items()}
