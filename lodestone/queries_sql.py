"""Queries of the SQL surface: each entry is a statement of the dialect and its DuckDB counterpart."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestone.session import Session
from lodestone.sources.scratch import cut

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "pages")


def session(spark: SparkSession, sf_dir: str, folder: str | None = None) -> Session:
    out = Session(spark, folder)
    for name in TABLES:
        out.register(name, lambda name=name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    return out


# name: (statement, oracle, parameters)
STATEMENTS: dict[str, tuple[str, str, dict]] = {
    "scan_project": (
        "SELECT n_nationkey, n_name, n_regionkey * 10 + 1 AS code FROM nation",
        "SELECT n_nationkey, n_name, CAST(n_regionkey * 10 + 1 AS DECIMAL(38,0)) AS code FROM nation",
        {},
    ),
    "flagship_sql": (
        "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS qty FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.08 GROUP BY l_returnflag HAVING count(*) > 10 ORDER BY l_returnflag LIMIT 10",
        "SELECT l_returnflag, count(*) AS n, sum(CAST(l_quantity AS DECIMAL(20,6))) AS qty FROM lineitem WHERE l_discount BETWEEN 0.02::DOUBLE AND 0.08::DOUBLE GROUP BY l_returnflag HAVING count(*) > 10 ORDER BY l_returnflag LIMIT 10",
        {},
    ),
    "filter_compare": (
        "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus <> 'F'",
        "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus <> 'F'",
        {},
    ),
    "filter_3vl": (
        "SELECT c_custkey FROM customer WHERE NOT (NULLIF(c_nationkey, 3) > 10 OR NULLIF(c_mktsegment, 'BUILDING') = 'MACHINERY')",
        "SELECT c_custkey FROM customer WHERE NOT (NULLIF(c_nationkey, 3) > 10 OR NULLIF(c_mktsegment, 'BUILDING') = 'MACHINERY')",
        {},
    ),
    "in_list": (
        "SELECT p_partkey, p_brand, p_size FROM part WHERE p_size IN (1, 5, 9, 13) AND p_partkey NOT IN (7, NULL, 8) IS NULL",
        "SELECT p_partkey, p_brand, p_size FROM part WHERE p_size IN (1, 5, 9, 13) AND (p_partkey NOT IN (7, NULL, 8)) IS NULL",
        {},
    ),
    "between": (
        "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20 AND p_partkey NOT BETWEEN 100 AND 900",
        "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20 AND p_partkey NOT BETWEEN 100 AND 900",
        {},
    ),
    "case_searched": (
        "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'rich' END AS band FROM customer",
        "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'rich' END AS band FROM customer",
        {},
    ),
    "case_simple": (
        "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 END AS code FROM orders",
        "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 END AS code FROM orders",
        {},
    ),
    "coalesce_nullif": (
        "SELECT n_nationkey, COALESCE(NULLIF(n_regionkey, 2), -1) AS r FROM nation",
        "SELECT n_nationkey, COALESCE(NULLIF(n_regionkey, 2), -1) AS r FROM nation",
        {},
    ),
    "cast_roundtrip": (
        "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR2(20)) AS t, CAST(CAST(o_orderkey AS VARCHAR2(20)) AS INTEGER) AS n, '12.50'::NUMBER AS d FROM orders",
        "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS t, CAST(o_orderkey AS DECIMAL(38,0)) AS n, CAST('12.50' AS DECIMAL(38,10)) AS d FROM orders",
        {},
    ),
    "decimal_arith": (
        "SELECT l_orderkey, l_linenumber, l_extendedprice - l_quantity AS a, -l_tax AS b, 0.1 + 0.2 = 0.3 AS exact FROM lineitem",
        "SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(20,6)) - CAST(l_quantity AS DECIMAL(20,6)) AS a, -CAST(l_tax AS DECIMAL(20,6)) AS b, true AS exact FROM lineitem",
        {},
    ),
    "revenue": (
        "SELECT l_returnflag, l_linestatus, CAST(CAST(sum(l_extendedprice * (1 - l_discount)) AS VARCHAR2(60)) AS NUMBER) AS revenue FROM lineitem GROUP BY l_returnflag, l_linestatus",
        "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_extendedprice AS DECIMAL(16,2)) * (1 - CAST(l_discount AS DECIMAL(6,2)))) AS DECIMAL(38,10)) AS revenue FROM lineitem GROUP BY l_returnflag, l_linestatus",
        {},
    ),
    "select_const": ("SELECT 1 AS one, 'x' AS t, TRUE AS b", "SELECT 1 AS one, 'x' AS t, TRUE AS b", {}),
    "param_filter": (
        "SELECT o_orderkey FROM orders WHERE o_orderpriority = :p AND o_custkey < :n",
        "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey < 500",
        {"p": "1-URGENT", "n": 500},
    ),
    "inner_join": (
        "SELECT c.c_custkey, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE c.c_acctbal > 9000",
        "SELECT c.c_custkey, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE c.c_acctbal > 9000",
        {},
    ),
    "theta_join": (
        "SELECT a.n_nationkey AS a, b.r_regionkey AS b FROM nation a JOIN region b ON a.n_regionkey < b.r_regionkey",
        "SELECT a.n_nationkey AS a, b.r_regionkey AS b FROM nation a JOIN region b ON a.n_regionkey < b.r_regionkey",
        {},
    ),
    "left_join": (
        "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000",
        "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000",
        {},
    ),
    "left_join_where": (
        "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderstatus = 'P'",
        "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderstatus = 'P'",
        {},
    ),
    "left_join_anti": (
        "SELECT c.c_custkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NULL",
        "SELECT c.c_custkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NULL",
        {},
    ),
    "comma_join": (
        "SELECT s_suppkey, n_name FROM supplier, nation WHERE s_nationkey = n_nationkey",
        "SELECT s_suppkey, n_name FROM supplier, nation WHERE s_nationkey = n_nationkey",
        {},
    ),
    "self_join": (
        "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
        "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
        {},
    ),
    "three_tables": (
        "SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
        "SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
        {},
    ),
    "scalar_agg": (
        "SELECT count(*) AS n, count(NULLIF(l_linenumber, 1)) AS c, sum(l_quantity) AS s, min(l_shipdate) AS lo, max(l_quantity) AS hi FROM lineitem",
        "SELECT count(*) AS n, count(NULLIF(l_linenumber, 1)) AS c, sum(CAST(l_quantity AS DECIMAL(20,6))) AS s, min(l_shipdate) AS lo, max(l_quantity) AS hi FROM lineitem",
        {},
    ),
    "scalar_agg_empty": (
        "SELECT count(*) AS n, sum(o_custkey) AS s, max(o_orderstatus) AS m FROM orders WHERE o_orderkey < 0",
        "SELECT count(*) AS n, CAST(sum(o_custkey) AS DECIMAL(30,0)) AS s, max(o_orderstatus) AS m FROM orders WHERE o_orderkey < 0",
        {},
    ),
    "group_agg": (
        "SELECT l_suppkey, count(*) AS n, sum(l_quantity) AS q, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY l_suppkey",
        "SELECT l_suppkey, count(*) AS n, sum(CAST(l_quantity AS DECIMAL(20,6))) AS q, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY l_suppkey",
        {},
    ),
    "group_empty": (
        "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey < 0 GROUP BY o_orderstatus",
        "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey < 0 GROUP BY o_orderstatus",
        {},
    ),
    "group_null_key": (
        "SELECT NULLIF(o_orderstatus, 'O') AS s, count(*) AS n FROM orders GROUP BY NULLIF(o_orderstatus, 'O')",
        "SELECT NULLIF(o_orderstatus, 'O') AS s, count(*) AS n FROM orders GROUP BY NULLIF(o_orderstatus, 'O')",
        {},
    ),
    "group_constant": ("SELECT count(*) AS n FROM orders GROUP BY 1", "SELECT count(*) AS n FROM orders", {}),
    "agg_distinct": (
        "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n, sum(DISTINCT l_quantity) AS s FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n, sum(DISTINCT CAST(l_quantity AS DECIMAL(20,6))) AS s FROM lineitem GROUP BY l_returnflag",
        {},
    ),
    "avg_exact": (
        "SELECT c_mktsegment, CAST(CAST(avg(c_custkey) * count(*) - sum(c_custkey) AS VARCHAR2(60)) AS INTEGER) AS zero FROM customer GROUP BY c_mktsegment HAVING avg(c_nationkey) > 1",
        "SELECT c_mktsegment, CAST(0 AS DECIMAL(38,0)) AS zero FROM customer GROUP BY c_mktsegment HAVING avg(c_nationkey) > 1",
        {},
    ),
    "min_max_text": (
        "SELECT n_regionkey, min(n_name) AS lo, max(n_name) AS hi FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, min(n_name) AS lo, max(n_name) AS hi FROM nation GROUP BY n_regionkey",
        {},
    ),
    "having": (
        "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
        "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
        {},
    ),
    "agg_expr": (
        "SELECT l_linestatus, sum(l_quantity) * 2 + count(*) AS x FROM lineitem GROUP BY l_linestatus HAVING max(l_tax) - min(l_tax) > 0",
        "SELECT l_linestatus, sum(CAST(l_quantity AS DECIMAL(20,6))) * 2 + count(*) AS x FROM lineitem GROUP BY l_linestatus",
        {},
    ),
    "order_nulls": (
        "SELECT n_nationkey, NULLIF(n_regionkey, 1) AS r FROM nation ORDER BY r DESC, n_nationkey LIMIT 7",
        "SELECT n_nationkey, NULLIF(n_regionkey, 1) AS r FROM nation ORDER BY r DESC NULLS FIRST, n_nationkey LIMIT 7",
        {},
    ),
    "topn": (
        "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
        "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
        {},
    ),
    "limit_offset": (
        "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 5 OFFSET 10",
        "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 5 OFFSET 10",
        {},
    ),
    "order_hidden_col": (
        "SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10",
        "SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10",
        {},
    ),
    "order_ordinal": (
        "SELECT n_regionkey, n_name FROM nation ORDER BY 1 DESC, 2 LIMIT 6",
        "SELECT n_regionkey, n_name FROM nation ORDER BY 1 DESC, 2 LIMIT 6",
        {},
    ),
    "order_by_aggregate": (
        "SELECT o_orderpriority FROM orders GROUP BY o_orderpriority ORDER BY count(*) DESC, o_orderpriority LIMIT 3",
        "SELECT o_orderpriority FROM orders GROUP BY o_orderpriority ORDER BY count(*) DESC, o_orderpriority LIMIT 3",
        {},
    ),
    "distinct": (
        "SELECT DISTINCT p_brand, p_size FROM part",
        "SELECT DISTINCT p_brand, p_size FROM part",
        {},
    ),
    "union_all": (
        "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
        "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
        {},
    ),
    "union": (
        "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
        "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
        {},
    ),
    "intersect": (
        "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
        "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
        {},
    ),
    "intersect_all": (
        "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
        "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
        {},
    ),
    "except": (
        "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders",
        "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders",
        {},
    ),
    "except_all": (
        "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
        "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
        {},
    ),
    "division": (
        "SELECT n_nationkey, CAST(CAST(n_nationkey / 8 AS VARCHAR2(60)) AS NUMBER) AS q, n_nationkey / 8 > 1.5 AS more FROM nation",
        "SELECT n_nationkey, CAST(n_nationkey / 8.0 AS DECIMAL(38,10)) AS q, n_nationkey / 8.0 > 1.5 AS more FROM nation",
        {},
    ),
    "left_join_anti_some": (
        "SELECT c.c_custkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 250000 WHERE o.o_orderkey IS NULL",
        "SELECT c.c_custkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 250000 WHERE o.o_orderkey IS NULL",
        {},
    ),
    "except_some": (
        "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey > 9",
        "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey > 9",
        {},
    ),
    "star_expansion": ("SELECT * FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey", "SELECT * FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey", {}),
    "setop_tail": (
        "SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region INTERSECT SELECT n_regionkey FROM nation ORDER BY k DESC LIMIT 9 OFFSET 2",
        "SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region INTERSECT SELECT n_regionkey FROM nation ORDER BY k DESC LIMIT 9 OFFSET 2",
        {},
    ),
}


def _statement(text: str, params: dict):
    return lambda spark, sf_dir: session(spark, sf_dir).sql(text, params)


def _stored(spark: SparkSession, sf_dir: str) -> Session:
    """A session whose folder lies beside other scratch tables."""
    cut(spark.range(1), "folder")
    out = session(spark, sf_dir, f"{spark.conf.get('spark.checkpoint.dir')}/lodestone/store-{uuid.uuid4().hex}")
    out.execute("CREATE TABLE t (id INTEGER NOT NULL, status VARCHAR2(4), price NUMBER)")
    out.execute("INSERT INTO t SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
    return out


def insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stored(spark, sf_dir)
    s.execute("INSERT INTO t (id, status) VALUES (-1, 'new'), (-2, NULL)")
    return s.sql("SELECT id, status, price FROM t")


def update_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stored(spark, sf_dir)
    s.execute("UPDATE t SET status = 'big', price = price * 2 WHERE price > 200000")
    return s.sql("SELECT id, status, CAST(CAST(price AS VARCHAR2(60)) AS NUMBER) AS price FROM t")


def delete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stored(spark, sf_dir)
    s.execute("DELETE FROM t WHERE status = 'O'")
    return s.sql("SELECT id, status FROM t")


def transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rolled-back and a committed change."""
    s = _stored(spark, sf_dir)
    s.execute("BEGIN; DELETE FROM t; ROLLBACK")
    s.execute("BEGIN; DELETE FROM t WHERE id < 100; COMMIT")
    return s.sql("SELECT count(*) AS n, min(id) AS lo FROM t")


def show_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir).sql("SHOW TABLES").select("table_name", "table_kind")


QUERIES = {name: _statement(text, params) for name, (text, _, params) in STATEMENTS.items()}
QUERIES |= {f.__name__: f for f in (insert_select, update_rows, delete_rows, transaction, show_tables)}

ORACLE_SQL = {name: oracle for name, (_, oracle, _) in STATEMENTS.items()} | {
    "insert_select": "SELECT CAST(o_orderkey AS DECIMAL(38,0)) AS id, o_orderstatus AS status, CAST(o_totalprice AS DECIMAL(38,10)) AS price FROM orders UNION ALL VALUES (-1, 'new', NULL), (-2, NULL, NULL)",
    "update_rows": "SELECT CAST(o_orderkey AS DECIMAL(38,0)) AS id, CASE WHEN o_totalprice > 200000 THEN 'big' ELSE o_orderstatus END AS status, CAST(CAST(o_totalprice AS DECIMAL(20,6)) * CASE WHEN o_totalprice > 200000 THEN 2 ELSE 1 END AS DECIMAL(38,10)) AS price FROM orders",
    "delete_rows": "SELECT CAST(o_orderkey AS DECIMAL(38,0)) AS id, o_orderstatus AS status FROM orders WHERE o_orderstatus <> 'O'",
    "transaction": "SELECT count(*) AS n, CAST(min(o_orderkey) AS DECIMAL(38,0)) AS lo FROM orders WHERE o_orderkey >= 100",
    "show_tables": f"SELECT unnest([{', '.join(repr(t) for t in TABLES)}]) AS table_name, 'view' AS table_kind UNION ALL SELECT unnest(['attachment$', 'col$', 'file$', 'ind$', 'obj$', 'recovery$']), 'dictionary'",
}
