"""The registered queries over the driver's tables, with the SQL that DuckDB runs on the same tables.

Money and quantities are stored as doubles; arithmetic and sums run in DECIMAL on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone import queries_graph, queries_other, queries_sql, queries_store, queries_text

MODULES = (queries_sql, queries_graph, queries_text, queries_other, queries_store)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries_text.flagship(spark, sf_dir)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in m.ORACLE_SQL.items()}
