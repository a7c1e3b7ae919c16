"""The driver's contract, and every query of the catalogue against DuckDB."""

import datetime
import decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from lodestone import catalogue

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        place = DATA / f"{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{place}{'/*.parquet' if place.is_dir() else ''}'")
    return c


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.queries()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_against_duckdb(spark, duck, name):
    df = catalogue.queries()[name](spark, str(DATA))
    found = duck.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    names = sorted(columns)
    want = sorted(repr([plain(r[columns.index(n)]) for n in names]) for r in found.fetchall())
    assert sorted(repr([plain(r[n]) for n in names]) for r in df.collect()) == want
