"""The SQL dialect: golden facts, named rejections, writes and transactions."""

from decimal import Decimal

import pytest
from conftest import rows

from lodestone.plans.lexer import SqlError
from lodestone.session import Session


@pytest.fixture
def db(spark, tmp_path):
    s = Session(spark, tmp_path.as_uri())
    s.register("diff", spark.createDataFrame([(i, f"t{i:02d}") for i in range(1, 21)], "id int, tag string"))
    s.register("agg", spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "a"), (6, "b"), (7, None)], "id int, tag string"))
    s.register("setops", spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c"), (5, "c"), (6, None)], "id int, tag string"))
    s.register("s", spark.createDataFrame([(1, "a", 10), (2, "a", 20), (3, "b", 5), (4, "b", None)], "id int, grp string, v int"))
    s.register("e", spark.createDataFrame([], "v int"))
    s.register("a", spark.createDataFrame([(1, "a1"), (2, "a2"), (3, "a3")], "id int, tag string"))
    s.register("b", spark.createDataFrame([(2, "b2"), (3, "b3"), (4, "b4")], "id int, note string"))
    return s


def test_filter_and_limit(db):
    assert [r[0] for r in db.sql("SELECT tag FROM diff WHERE id > 15 ORDER BY id LIMIT 2 OFFSET 1").collect()] == ["t17", "t18"]
    assert db.sql("SELECT tag FROM diff WHERE 't05' <> tag").count() == 19


def test_case_between(db):
    got = dict(db.sql("SELECT id, CASE WHEN id BETWEEN 3 AND 7 THEN id * 10 ELSE COALESCE(NULLIF(id, 1), -1) END AS x FROM diff WHERE id <= 10").collect())
    assert (got[10], got[5], got[1]) == (10, 50, -1)


def test_aggregates(db):
    assert rows(db.sql("SELECT tag, count(*) FROM agg GROUP BY tag")) == sorted([("a", 3), ("b", 2), (None, 2)], key=repr)
    r = db.sql("SELECT count(*), count(v), sum(v), min(v), max(v), avg(v) FROM s").first()
    assert tuple(r)[:5] == (4, 3, 35, 5, 20) and abs(r[5] - Decimal(35) / 3) < Decimal("1e-9")
    assert rows(db.sql("SELECT grp, count(*) AS n FROM s GROUP BY grp HAVING count(*) > 1")) == [("a", 2), ("b", 2)]
    assert db.sql("SELECT count(DISTINCT grp) FROM s").first()[0] == 2
    assert tuple(db.sql("SELECT count(*), sum(v) FROM e").first()) == (0, None)
    assert db.sql("SELECT count(*), sum(v) FROM e GROUP BY v").count() == 0
    assert db.sql("SELECT count(*) FROM s GROUP BY 1").collect()[0][0] == 4
    assert db.sql("SELECT count(*), grp FROM s GROUP BY grp").columns == ["count", "grp"]
    assert db.sql("SELECT id + 1 FROM s").columns == ["?column?"]


def test_null_order(db):
    up = [r[0] for r in db.sql("SELECT tag FROM agg ORDER BY tag, id").collect()]
    down = [r[0] for r in db.sql("SELECT tag FROM agg ORDER BY tag DESC, id").collect()]
    assert up[-2:] == [None, None] and down[:2] == [None, None]


def test_joins(db):
    assert rows(db.sql("SELECT a.id, note FROM a JOIN b ON a.id = b.id")) == [(2, "b2"), (3, "b3")]
    assert rows(db.sql("SELECT a.id, note FROM a LEFT JOIN b ON a.id = b.id")) == sorted([(1, None), (2, "b2"), (3, "b3")], key=repr)
    assert rows(db.sql("SELECT a.id FROM a, b WHERE a.id = b.id")) == [(2,), (3,)]
    assert db.sql("SELECT a.id FROM a JOIN b ON a.id < b.id").count() == 6


def test_set_operations(db):
    left, right = "SELECT tag FROM setops WHERE id <= 3", "SELECT tag FROM setops WHERE id >= 2"
    sizes = {op: db.sql(f"{left} {op} {right}").count() for op in ("UNION", "UNION ALL", "INTERSECT", "INTERSECT ALL", "EXCEPT ALL")}
    assert sizes == {"UNION": 4, "UNION ALL": 8, "INTERSECT": 1, "INTERSECT ALL": 2, "EXCEPT ALL": 1}
    assert db.sql(f"{left} EXCEPT {right}").count() == 1
    assert db.sql(f"{right} EXCEPT ALL {left}").count() == 3


def test_exact_numbers(db):
    assert db.sql("SELECT 0.1 + 0.2 = 0.3").first()[0] is True
    assert db.sql("SELECT CAST('1.50' AS NUMBER) = 1.5, CAST(12 AS VARCHAR2(5)) AS t").first()[1] == "12"
    with pytest.raises(Exception, match="(?i)divi"):
        db.sql("SELECT 1 / (id - id) FROM diff").collect()
    with pytest.raises(Exception, match="not a number"):
        db.sql("SELECT CAST(tag AS NUMBER) FROM diff").collect()


def test_parameters(db):
    assert rows(db.sql("SELECT id FROM diff WHERE id = :n AND tag = :t", {"n": 5, "t": "t05"})) == [(5,)]
    for params, message in (({}, "no value"), ({"n": 1, "x": 2}, "no statement uses"), ({"n": "5"}, "should be a number")):
        with pytest.raises(SqlError, match=message):
            db.sql("SELECT id FROM diff WHERE id = :n", params)
    with pytest.raises(SqlError, match="can't be told"):
        db.sql("SELECT :n", {"n": 1})


@pytest.mark.parametrize(
    "text",
    [
        "SELECT * FROM diff WHERE tag LIKE 't%'",
        "SELECT * FROM diff WHERE id IN (SELECT 1)",
        "SELECT * FROM (SELECT 1)",
        "SELECT * FROM a RIGHT JOIN b ON a.id = b.id",
        "SELECT * FROM a FULL JOIN b ON a.id = b.id",
        "SELECT * FROM a NATURAL JOIN b",
        "SELECT * FROM a JOIN b USING (id)",
        "WITH x AS (SELECT 1) SELECT * FROM x",
        "SELECT count(*) OVER (ORDER BY id) FROM diff",
        "SELECT upper(tag) FROM diff",
        "SELECT * FROM diff WHERE '10' = 10",
        "SELECT * FROM diff WHERE id",
        "SELECT a.* FROM a",
        "SELECT id, count(*) FROM diff",
        "SELECT id FROM diff HAVING id > 1",
        "SELECT id FROM diff WHERE count(*) > 1",
        "SELECT CASE WHEN id > 1 THEN 'x' ELSE 1 END FROM diff",
        "SELECT CAST(TRUE AS NUMBER)",
        "SELECT id FROM a, b",
        "SELECT x.id FROM a x JOIN b x ON x.id = x.id",
        "SELECT nothing FROM a",
        "SELECT id FROM a UNION SELECT id, note FROM b",
        "SELECT id FROM a ORDER BY id NULLS FIRST",
        "SELECT id FROM a ORDER BY 2",
        "SELECT DISTINCT tag FROM diff ORDER BY id",
        "VALUES (1)",
        "SELECT v <-> v FROM s",
        "CREATE TABLE z (d DATE)",
    ],
)
def test_rejections(db, text):
    with pytest.raises(SqlError):
        db.execute(text)


def test_writes(db):
    db.execute("CREATE TABLE t (id INTEGER NOT NULL, v NUMBER, name VARCHAR2(4))")
    assert db.execute("INSERT INTO t (id, v) VALUES (1, 10), (2, 20)")[0].affected == 2
    assert db.execute("INSERT INTO t (id, v) SELECT id + :delta, v FROM t WHERE id = :id", {"delta": 10, "id": 1})[0].affected == 1
    assert db.execute("UPDATE t SET v = v * 2, id = id + 100 WHERE id = 2")[0].affected == 1
    assert db.execute("DELETE FROM t WHERE id = 11")[0].affected == 1
    assert rows(db.sql("SELECT id, v FROM t")) == [(Decimal(1), Decimal(10)), (Decimal(102), Decimal(40))]
    for bad in ("INSERT INTO t (v) VALUES (1)", "INSERT INTO t (id, name) VALUES (5, 'too long')", "INSERT INTO t (id) VALUES ('x')", "UPDATE t SET id = NULL"):
        with pytest.raises(SqlError):
            db.execute(bad)
    assert db.sql("SELECT count(*) FROM t").first()[0] == 2


def test_unique_index_takes_nulls(db):
    db.execute("CREATE TABLE n (id INTEGER NOT NULL, code VARCHAR2(8)); CREATE UNIQUE INDEX nc ON n (code)")
    db.execute("INSERT INTO n VALUES (1, NULL), (2, NULL), (3, 'a')")
    with pytest.raises(SqlError, match="unique"):
        db.execute("INSERT INTO n VALUES (4, 'a')")
    assert db.sql("SELECT count(*) FROM n").first()[0] == 3


def test_transactions(db, spark, tmp_path):
    db.execute("CREATE TABLE t (id INTEGER)")
    db.execute("BEGIN; INSERT INTO t VALUES (1)")
    assert db.sql("SELECT count(*) FROM t").first()[0] == 1
    assert Session(spark, tmp_path.as_uri()).sql("SELECT count(*) FROM t").first()[0] == 0
    with pytest.raises(SqlError):
        db.execute("BEGIN")
    with pytest.raises(SqlError):
        db.execute("CREATE TABLE u (id INTEGER)")
    db.execute("ROLLBACK")
    assert db.sql("SELECT count(*) FROM t").first()[0] == 0
    db.execute("BEGIN; INSERT INTO t VALUES (1); COMMIT")
    assert Session(spark, tmp_path.as_uri()).sql("SELECT count(*) FROM t").first()[0] == 1


def test_concurrent_writers(spark, tmp_path):
    one, two = Session(spark, tmp_path.as_uri()), Session(spark, tmp_path.as_uri())
    one.execute("CREATE TABLE t (id INTEGER)")
    with pytest.raises(RuntimeError, match="another writer"):
        two.execute("CREATE TABLE u (id INTEGER)")


def test_dictionary(db):
    db.execute("CREATE TABLE t (id INTEGER NOT NULL, v NUMBER); CREATE INDEX ti ON t (id); CREATE GRAPH g")
    assert rows(db.sql("SELECT table_name, column_name, required FROM col$")) == [("t", "id", True), ("t", "v", False)]
    assert ("t", "table") in [(r[0], r[1]) for r in db.sql("SHOW TABLES").collect()]
    assert [r[0] for r in db.sql("SHOW GRAPHS").collect()] == ["g"]
    assert [tuple(r) for r in db.sql("DESCRIBE t").collect()] == [("id", "number"), ("v", "number")]
    db.execute("DROP TABLE t; DROP GRAPH g")
    assert db.sql("SELECT * FROM obj$").count() == 0


def test_filters_reach_the_scan(spark, tmp_path):
    place = f"{tmp_path.as_uri()}/x"
    spark.range(100).selectExpr("id", "id * 0.5D AS d", "cast(id AS string) AS t").write.parquet(place)
    s = Session(spark)
    s.register("x", spark.read.parquet(place))
    plan = s.sql("SELECT id FROM x WHERE d >= 0.05 AND id IN (1, 2, 3)")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(d,0.05)" in plan and "In(id" in plan and "ReadSchema: struct<id:bigint,d:double>" in plan


def test_attachments(spark):
    s = Session(spark)
    data = [("f1", "s1", "txt", 0, b"one needle\nand "), ("f1", "s1", "txt", 1, b"a needle more\nneedle"), ("f2", "s1", "png", 0, b"needle")]
    s.register("attachment$data", spark.createDataFrame(data, "attachment_id string, session_id string, format string, ordinal int, data binary"))
    got = rows(s.sql("SELECT attachment_id, line_number, byte_offset FROM attachment_grep('needle')"))
    assert got == [("f1", 1, 4), ("f1", 2, 17), ("f1", 3, 29)]
    assert s.sql("SELECT * FROM attachment_grep('needle', 's2')").count() == 0


def test_json_functions(spark):
    s = Session(spark)
    s.register("d", spark.createDataFrame([(1, '{"a": {"b": [1, null, "x"]}, "n": null}'), (2, "not json"), (3, None), (4, '{"a": 5}')], "k int, doc string"))
    got = rows(s.sql("SELECT k, json_get(doc, 'a.b[2]') AS g, json_get(doc, 'n') AS n, json_exists(doc, 'n') AS e, json_exists(doc, 'a.b[1]') AS f FROM d"))
    assert got == [(1, "x", None, True, True), (2, None, None, False, False), (3, None, None, None, None), (4, None, None, False, False)]
    import json

    set_ = dict(s.sql("SELECT k, json_set(doc, 'a.c', 7) AS t FROM d").collect())
    assert json.loads(set_[1]) == {"a": {"b": [1, None, "x"], "c": 7}, "n": None} and json.loads(set_[4]) == {"a": {"c": 7}} and set_[3] is None
    for bad in ("SELECT json_get(doc, 'a..b') AS x FROM d", "SELECT json_get(doc, '*') AS x FROM d", "SELECT json_get(k, 'a') AS x FROM d", "SELECT json_set(doc, 'a[0]', 1) AS x FROM d"):
        with pytest.raises(SqlError):
            s.sql(bad)


def test_changes_rewrite_parts_with_hits(spark, tmp_path):
    s = Session(spark, tmp_path.as_uri())
    s.execute("CREATE TABLE t (id INTEGER NOT NULL, x VARCHAR2(4)); CREATE UNIQUE INDEX u ON t (id)")
    for k in (1, 2, 3):
        s.execute(f"INSERT INTO t VALUES ({k}, 'a'), ({k + 10}, 'b')")
    before = s.catalogue["tables"]["t"]["places"]
    assert s.execute("UPDATE t SET x = 'c' WHERE id = 2")[0].affected == 1
    after = s.catalogue["tables"]["t"]["places"]
    assert len(after) == 3 and len(set(before) & set(after)) == 2
    assert s.execute("DELETE FROM t WHERE id > 100")[0].affected == 0 and s.catalogue["tables"]["t"]["places"] == after
    with pytest.raises(SqlError, match="unique"):
        s.execute("UPDATE t SET id = 11 WHERE id = 2")
    assert s.execute("DELETE FROM t WHERE x = 'b'")[0].affected == 3
    assert rows(s.sql("SELECT id, x FROM t")) == [(1, "a"), (2, "c"), (3, "a")]


def test_client(spark, tmp_path):
    from lodestone import client

    with client.connect(spark, tmp_path.as_uri()) as c:
        cur = c.cursor()
        cur.execute("CREATE TABLE t (id INTEGER, x VARCHAR2(9))")
        cur.executemany("INSERT INTO t VALUES (:id, :x)", [{"id": k, "x": f"r{k}"} for k in range(4)])
        assert cur.rowcount == 4
        assert client.connect(spark, tmp_path.as_uri()).cursor().execute("SELECT count(*) AS n FROM t").fetchone() == (0,)
        c.commit()
        cur.execute("SELECT id, x FROM t WHERE id >= :low ORDER BY id", {"low": 1})
        assert [d[0] for d in cur.description] == ["id", "x"] and cur.fetchone()[1] == "r1" and len(cur.fetchmany(1)) == 1 and [r[1] for r in cur] == ["r3"] and cur.fetchone() is None
        cur.execute("DELETE FROM t")
        c.rollback()
        assert cur.execute("SELECT count(*) AS n FROM t").fetchall() == [(4,)]
        with pytest.raises(client.ProgrammingError):
            cur.execute("SELECT nothing FROM t")
        with pytest.raises(client.ProgrammingError):
            cur.execute("INSERT INTO t VALUES (9, 'x')").fetchone()
        c.rollback()
    with pytest.raises(client.ProgrammingError):
        c.cursor()
