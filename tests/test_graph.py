"""The graph language against golden facts and a plain-Python model."""

import itertools
import random

import pytest
from conftest import rows

from lodestone.operators.graph import Graph
from lodestone.operators.graph.language import GraphError


@pytest.fixture(scope="module")
def harbour(spark):
    """Ships, berths and a crane; berth 12 is a number, another ship's a word."""
    nodes = [
        (1, ["Vessel", "Guest"], {"berth": 12, "name": "Marlin"}),
        (2, ["Crane"], {"name": "north crane", "lifts": ["steel", "timber"]}),
        (3, ["Depot"], {"name": "yard seven"}),
        (4, ["Vessel"], {"berth": "roads", "name": "Marlin"}),
    ]
    edges = [(1, 1, 2, "UNLOADS", {"tons": 2}), (2, 1, 2, "UNLOADS", {"tons": 3}), (3, 2, 3, "FEEDS", {}), (4, 3, 1, "SUPPLIES", {}), (5, 1, 1, "TURNS", {})]
    return Graph.from_json(spark, nodes, edges)


def one(df):
    return tuple(df.first())


def test_patterns(harbour):
    q = harbour.query
    assert q("MATCH (v {berth: 12})-[r:UNLOADS]-(c) RETURN id(r) AS r").count() == 2
    assert one(q("MATCH (v {berth: 12})-[r:TURNS]-(v) RETURN count(*) AS n")) == (1,)
    got = rows(q("MATCH (v:Vessel) OPTIONAL MATCH (v)-[r:UNLOADS]->(c) WHERE r.tons > 2 RETURN id(v) AS v, count(r) AS n, size(collect(c.name)) AS c"))
    assert got == [(1, 1, 1), (4, 0, 0)]
    assert rows(q("MATCH p = (v {berth: 12})-[:UNLOADS|FEEDS*2..2]->(d:Depot) RETURN length(p) AS n")) == [(2,), (2,)]
    assert rows(q("MATCH p = shortestPath((v {berth: 12})-[*..4]->(d:Depot)) RETURN length(p) AS n, relationships(p) AS e")) == [(2, [1, 3])]
    assert one(q("RETURN 9007199254740993 + 1 AS n")) == (9007199254740994,)
    assert one(q("MATCH (x:Lighthouse) RETURN count(*) AS n, collect(x.name) AS c")) == (0, [])


def test_walks_that_end_early(harbour):
    assert harbour.query("MATCH (v {berth: 'roads'})-[:UNLOADS*6..7]->(x) RETURN x.name AS n").count() == 0
    assert harbour.query("MATCH (v {berth: 12})-[path:UNLOADS|FEEDS|SUPPLIES*4..6]->(x) RETURN size(path) AS n").count() == 2


def test_lists_and_exists(harbour):
    q = harbour.query
    assert one(q("RETURN [w IN ['tug', 'x', 'barge'] WHERE size(w) > 2 | w] AS l")) == (["tug", "barge"],)
    assert one(q("RETURN toInteger(reduce(t = 10, x IN [4, 5] | t + x)) AS n")) == (19,)
    assert rows(q("MATCH (v:Vessel) WHERE NOT EXISTS { (v)-[:UNLOADS]->() } RETURN v.berth AS b")) == [("roads",)]
    assert q("RETURN 7 AS x UNION RETURN 7 AS x").count() == 1
    assert q("RETURN 7 AS x UNION ALL RETURN 7 AS x").count() == 2


def test_three_valued(harbour):
    q = harbour.query
    assert one(q("RETURN 5 IN [6, null] AS a, 5 IN [5, null] AS b, null = 5 AS c, any(x IN [null, 5] WHERE x = 6) AS d, all(x IN [] WHERE x = 5) AS e")) == (None, True, None, None, True)
    assert one(q("RETURN [4, 5, 6][-1] AS a, [4, 5, 6][5] AS b, [4, 5, 6][0..2] AS c, [4, 5, 6][2..1] AS d, head([]) AS e")) == (6, None, [4, 5], [], None)
    assert one(q("MATCH (v {berth: 'roads'}) RETURN v.berth = 12 AS a, v.none = 1 AS b, v.berth IS NOT NULL AS c")) == (False, None, True)


def test_functions(harbour):
    got = one(harbour.query("MATCH (v {berth: 12})-[r:FEEDS|TURNS]->() RETURN labels(v) AS l, type(r) AS t, keys(v) AS k, start_id(r) AS s, elementId(v) AS e, toString(v.berth) AS d, toInteger('x') AS n, toInteger(-1.7) AS m"))
    assert got == (["Guest", "Vessel"], "TURNS", ["berth", "name"], 1, "1:g1:n:1", "12", None, -1)


@pytest.mark.parametrize(
    "text",
    [
        "MATCH (a)-[*]->(b) RETURN a", "MATCH (a)-[*1..]->(b) RETURN a", "MATCH (a)-[*..65]->(b) RETURN a", "RETURN 1 % 2 AS x", "RETURN 'a' =~ 'b' AS x", "RETURN nothing(1) AS x",
        "RETURN x AS y", "MATCH (a) WITH a.name AS n RETURN a", "RETURN 1 AS x, 2 AS x", "MATCH (a) RETURN a RETURN a", "MATCH (a) RETURN count(count(a)) AS n", "MATCH (a)", "MATCH (a) RETURN a LIMIT a.x",
        "MATCH (a) CALL (a) { MATCH (a) } RETURN a", "MATCH (a) CALL (a) { RETURN 1 AS a } RETURN a", "RETURN 1 AS a UNION RETURN 1 AS b", "MATCH (a) SET a.x += 1", "MATCH (a) RETURN a.k AS k, a.name + count(*) AS x", "FOREACH (x IN [1] | CREATE (a))", "RETURN 'a' < 1 AS x",
    ],
)
def test_rejections(harbour, text):
    with pytest.raises(GraphError):
        harbour.query(text).collect()


def test_budgets(harbour):
    with pytest.raises(GraphError, match="budget"):
        harbour.query("MATCH (a) RETURN a.name AS n", budgets={"max_rows": 2})
    with pytest.raises(GraphError, match="tighten"):
        harbour.query("MATCH (a) RETURN a.name AS n", budgets={"max_rows": 10**9})
    assert harbour.query("MATCH (a) RETURN a.name AS n", budgets={"max_rows": 4}).count() == 4
    q = "MATCH (a)-[e]->(b) RETURN b.name AS n"
    for good, bad in (({"max_nodes": 4}, {"max_nodes": 3}), ({"max_edges": 5}, {"max_edges": 4}), ({"max_expansions": 5}, {"max_expansions": 4}), ({"max_text_bytes": 44}, {"max_text_bytes": 43})):
        assert harbour.query(q, budgets=good).count() == 5
        with pytest.raises(GraphError, match="budget"):
            harbour.query(q, budgets=bad)
    with pytest.raises(GraphError, match="budget of 1 ms"):
        harbour.query("MATCH (a)-[e]->(b), (c)-[f]->(d) RETURN count(*) AS n", budgets={"max_millis": 1})
    with pytest.raises(GraphError, match="budget"):
        harbour.write("CREATE (:X)", budgets={"max_nodes": 3})


def trails(edges, start, low, high, both):
    """All trails from start as lists of edge ids, by plain recursion."""
    out = []

    def walk(at, used):
        if low <= len(used) <= high:
            out.append((at, tuple(used)))
        if len(used) == high:
            return
        for i, a, b in edges:
            if i in used:
                continue
            for x, y in {(a, b), (b, a)} if both else {(a, b)}:
                if x == at:
                    walk(y, [*used, i])

    walk(start, [])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_trails_match_a_plain_model(spark, seed):
    draw = random.Random(seed)
    edges = [(i, draw.randrange(5), draw.randrange(5)) for i in range(1, 9)]
    g = Graph.from_json(spark, [(i, ["N"], {"k": i}) for i in range(5)], [(i, a, b, "T", {}) for i, a, b in edges])
    for arrow, both in (("->", False), ("-", True)):
        got = sorted(tuple(r) for r in g.query(f"MATCH p = (a)-[:T*1..3]{arrow}(b) RETURN id(a) AS a, id(b) AS b, relationships(p) AS e").collect())
        want = sorted((s, end, list(used)) for s in range(5) for end, used in trails(edges, s, 1, 3, both))
        assert got == want
    bound = sorted(tuple(r) for r in g.query("MATCH (b {k: 2}) MATCH p = (a)-[:T*1..2]->(b) RETURN id(a) AS a, relationships(p) AS e, nodes(p)[0] AS first, last(nodes(p)) AS last").collect())
    assert bound == sorted((s, list(used), s, 2) for s in range(5) for end, used in trails(edges, s, 1, 2, False) if end == 2)
    short = {(r[0], r[1]): r[2] for r in g.query("MATCH p = shortestPath((a)-[:T*..4]->(b)) RETURN id(a) AS a, id(b) AS b, relationships(p) AS e").collect()}
    for s, end in itertools.product(range(5), range(5)):
        walks = [list(u) for e, u in trails(edges, s, 1, 4, False) if e == end]
        best = min(walks, key=lambda u: (len(u), u), default=None)
        if s != end:
            assert short.get((s, end)) == best


def test_merge(spark):
    g, n = Graph.empty(spark).write("UNWIND [1, 1, 2, 1] AS k MERGE (n:K {k: k}) ON MATCH SET n.hits = n.hits + 1 ON CREATE SET n.hits = 0")
    assert rows(g.query("MATCH (n:K) RETURN n.k AS k, n.hits AS h")) == [("1", "2"), ("2", "0")]
    g, _ = g.write("MATCH (a:K {k: 1}), (b:K {k: 2}) MERGE (a)-[r:T {w: 1}]->(b) MERGE (a)-[s:T {w: 1}]->(b)")
    assert one(g.query("MATCH ()-[r:T]->() RETURN count(r) AS n")) == (1,)
    with pytest.raises(GraphError, match="null"):
        g.write("MERGE (n:K {k: null})")


def test_merge_paths(spark):
    """Whole paths: one that is there matches, of equal ones the first is created and the others match it."""
    g = Graph.from_json(spark, [(1, ["City"], {"name": "Ghent"}), (2, ["River"], {"name": "Lys"})], [(1, 1, 2, "ON", {})])
    after, n = g.write("UNWIND ['Ghent', 'Namur', 'Namur'] AS c MERGE (x:City {name: c})-[:ON]->(r:River {name: 'Lys'}) ON CREATE SET x.new = true ON MATCH SET x.seen = 1")
    got = rows(after.query("MATCH (x:City)-[:ON]->(r:River) RETURN id(r) AS r, x.name AS c, x.new AS n, x.seen AS s"))
    assert sorted(r[1:] for r in got) == [("Ghent", None, "1"), ("Namur", "true", "1")] and after.nodes.count() == 4
    again, n = after.write("MATCH (x:City {name: 'Ghent'}) MERGE (x)-[:ON]->(:River {name: 'Leie'})-[:INTO]->(:Sea {name: 'North'}) MERGE (x)-[:ON]->(:River {name: 'Leie'})-[:INTO]->(:Sea {name: 'North'})")
    assert (again.nodes.count(), again.edges.count()) == (6, 4)
    both, _ = again.write("MATCH (s:Sea) MERGE (s)-[:INTO]-(r:River) SET r.mouth = s.name")
    assert both.edges.count() == 4 and rows(both.query("MATCH (r:River) WHERE r.mouth = 'North' RETURN r.name AS n")) == [("Leie",)]
    with pytest.raises(GraphError, match="null"):
        g.write("MERGE (:City {name: null})-[:ON]->(:River)")
    many, _ = Graph.empty(spark).write("UNWIND [1, 1, 1, 1, 1, 1, 1, 1] AS k MERGE (n:K {k: k}) ON MATCH SET n.last = 'x'")
    assert rows(many.query("MATCH (n:K) RETURN n.k AS k, n.last AS l")) == [("1", "x")]


def test_graphs_are_stored_and_obey_transactions(spark, tmp_path):
    from lodestone.plans.lexer import SqlError
    from lodestone.session import Session

    s = Session(spark, tmp_path.as_uri())
    s.execute("CREATE GRAPH docks")
    s.execute("CYPHER docks 'CREATE (:Dock {name: \"east\"})'")
    count = "SELECT n FROM GRAPH_TABLE(docks, 'MATCH (d:Dock) RETURN count(*) AS n' COLUMNS (n INTEGER))"
    s.execute("BEGIN; CYPHER docks 'CREATE (:Dock {name: \"west\"})'")
    assert s.sql(count).first()[0] == 2
    assert Session(spark, tmp_path.as_uri()).sql(count).first()[0] == 1
    s.execute("ROLLBACK")
    assert s.sql(count).first()[0] == 1
    s.execute("BEGIN; CYPHER docks 'CREATE (:Dock {name: \"west\"})'; CYPHER docks 'MATCH (d:Dock {name: \"east\"}) SET d.open = true'; COMMIT")
    s.execute("CREATE UNIQUE GRAPH INDEX u ON docks NODES LABEL \"Dock\" (name)")
    s.execute("CREATE FULLTEXT GRAPH INDEX t ON docks NODES LABEL (\"Dock\") (name)")
    again = Session(spark, tmp_path.as_uri())
    assert rows(again.sql("SHOW GRAPHS").select("graph_name")) == [("docks",)] and again.sql(count).first()[0] == 2
    assert again.sql("SHOW GRAPH INDEXES ON docks").count() == 1 and again.sql("SHOW FULLTEXT GRAPH INDEXES ON docks").count() == 1
    with pytest.raises(GraphError, match="unique"):
        again.execute("CYPHER docks 'CREATE (:Dock {name: \"west\"})'")
    with pytest.raises(SqlError, match="transaction"):
        again.execute("BEGIN; CREATE GRAPH other")
    again.execute("ROLLBACK; DROP GRAPH docks")
    assert Session(spark, tmp_path.as_uri()).sql("SHOW GRAPHS").count() == 0
    # A registered graph, which isn't stored, is rolled back too; two writers of one version don't both win.
    s = Session(spark, tmp_path.as_uri())
    s.register_graph("loose", Graph.empty(spark))
    s.execute("BEGIN; CYPHER loose 'CREATE (:A)'; ROLLBACK")
    assert s.graph("loose").nodes.count() == 0
    s.execute("CREATE GRAPH twice")
    a, b = Session(spark, tmp_path.as_uri()), Session(spark, tmp_path.as_uri())
    a.execute("CYPHER twice 'CREATE (:A)'")
    with pytest.raises(RuntimeError):
        b.execute("CYPHER twice 'CREATE (:B)'")


def test_graph_table_budgets(spark, harbour):
    from lodestone.session import Session

    s = Session(spark)
    s.register_graph("h", harbour)
    text = "SELECT n FROM GRAPH_TABLE(h, 'MATCH (a)-[e]->(b) RETURN id(a) AS n' BUDGETS '{\"max_expansions\": %d}' COLUMNS (n INTEGER))"
    assert s.sql(text % 5).count() == 5
    with pytest.raises(GraphError, match="expansions"):
        s.sql(text % 4)


def test_deletes(spark):
    g = Graph.from_json(spark, [(1, ["A"], {}), (2, ["A"], {}), (3, ["B"], {})], [(1, 1, 2, "T", {})])
    with pytest.raises(GraphError, match="DETACH"):
        g.write("MATCH (a:A) DELETE a")
    after, _ = g.write("MATCH (a:A)-[e]->() DELETE e")
    assert (after.nodes.count(), after.edges.count()) == (3, 0)
    after, _ = g.write("MATCH (a:A) DETACH DELETE a")
    assert (after.nodes.count(), after.edges.count()) == (1, 0)
    assert g.nodes.count() == 3


def test_unique_property_index(spark):
    g = Graph.from_json(spark, [(1, ["E"], {"k": 1}), (2, ["E"], {"k": 2}), (3, ["E"], {})], [])
    g.add_property_index("i", "E", ["k"], unique=True)
    with pytest.raises(GraphError, match="unique"):
        g.write("CREATE (:E {k: 1})")
    g.write("CREATE (:E)")


def test_snapshot(spark, harbour, tmp_path):
    harbour.save(tmp_path.as_uri())
    again = Graph.load(spark, tmp_path.as_uri())
    assert (again.nodes.count(), again.edges.count()) == (4, 5)
    harbour.save(tmp_path.as_uri() + "/empty", definition_only=True)
    assert Graph.load(spark, tmp_path.as_uri() + "/empty").nodes.count() == 0


def test_profile(harbour):
    assert harbour.profile(harbour.query("MATCH (a)-[e]->(b) RETURN id(a) AS a")).first()["rows_returned"] == 5


def test_arms_are_counted_without_their_pairs(spark):
    """Counts by a node that parts the pattern: against the bindings themselves, with edges that both arms could take."""
    nodes = [(k, ["H"] if k < 4 else ["A", "B"] if k % 2 else ["A"], {"name": f"n{k % 3}"}) for k in range(1, 20)]
    links = [(k, k + 4, 1 + k % 3, "T" if k % 4 else "U", {"w": k}) for k in range(15)] + [(90, 1, 2, "T", {"w": 1}), (91, 2, 2, "T", {"w": 1})]
    g = Graph.from_json(spark, nodes, links)
    for pattern in ("(a:A)-[:T]->(h:H), (b:B)-[:T]->(h)", "(a:A)-[:T]->(h:H)<-[:U]-(b)", "(a)-[x]-(h:H), (h)-[y:T]-(b)", "(a)-[x:T]->(h)<-[y:T]-(b) WHERE x.w <> 3 AND b.name <> 'n1'", "(a:A)-[x:T]->(h:H), (b:B)-[y:T]->(h) WHERE x.w <> y.w"):
        whole = g.query(f"MATCH {pattern} WITH h, id(a) AS a, id(b) AS b RETURN h.name AS name, count(*) AS n")
        assert rows(g.query(f"MATCH {pattern} RETURN h.name AS name, count(*) AS n")) == rows(whole)
    plan = g.query("MATCH (a:A)-[:T]->(h:H), (b:B)-[:T]->(h) RETURN h.name AS name, count(*) AS n")._jdf.queryExecution().optimizedPlan().toString()
    assert "bindings" in plan
