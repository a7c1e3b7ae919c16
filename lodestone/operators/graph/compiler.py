"""Compiles the graph language to one DataFrame plan: every clause maps bindings to bindings.

A node or edge variable is a set of flat columns (`<prefix>__id`, ...), so that Catalyst prunes the fields that a
query doesn't use down to the scans.  Patterns are joins; optional and correlated parts are compiled over the
distinct values that they import, and joined back on them.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.operators.graph import language as L
from lodestone.operators.graph import values as V
from lodestone.operators.graph.language import GraphError
from lodestone.operators.graph.values import Value
from lodestone.sources.scratch import cut

#: Hops that are unrolled into one plan; longer walks are cut into written frontiers.
UNROLLED = 4


@dataclass
class State:
    """Bindings: df is None for the one row without columns that a query starts from."""

    df: DataFrame | None
    scope: dict[str, Value] = field(default_factory=dict)


class Compiler:
    def __init__(self, graph, parameters: dict | None = None, session=None, budgets: dict | None = None):
        self.graph, self.parameters, self.session = graph, parameters or {}, session
        self.budgets = budgets or {}
        self.numbers = itertools.count()
        self.carried: list[str] = []  # columns of the rows that a correlated query belongs to
        self.outer: DataFrame | None = None
        self.weight: str | None = None  # the column that says how many bindings a row stands for
        self.expanded: list[DataFrame] | None = None  # the rows of each MATCH, where a budget asks for them

    def fresh(self, stem: str) -> str:
        return f"{stem}_{next(self.numbers)}"

    def flat(self, prefix: str, schema, var: str | None = None) -> Value:
        return schema.value(lambda f: F.col(f"{prefix}__{f}"), var)

    # Queries

    def run(self, query: L.GraphQuery, start: State | None = None) -> State:
        start = start or State(None)
        state = State(start.df, dict(start.scope))
        counted = False
        for k, clause in enumerate(query.clauses):
            if isinstance(clause, L.Project) and clause.final and k != len(query.clauses) - 1:
                raise GraphError("RETURN is the last clause")
            if counted:
                self.weight, counted = "bindings", False
                state = self.project(clause, state)
                self.weight = None
                continue
            after = query.clauses[k + 1] if k + 1 < len(query.clauses) else None
            if isinstance(clause, L.Match) and isinstance(after, L.Project) and (arms := self.counted_arms(clause, after, state)):
                state, counted = arms, True
                continue
            state = self.clause(clause, state)
        last = query.clauses[-1]
        if not (isinstance(last, L.Project) and last.final) and not isinstance(last, L.Procedure):
            raise GraphError("a reading query ends in RETURN")
        if query.union is not None:
            other = self.run(query.union, start)
            state = self.united(state, other, query.union_all)
        return state

    def united(self, a: State, b: State, keep: bool) -> State:
        if list(a.scope) != list(b.scope):
            raise GraphError("the branches of UNION name different columns")
        names = list(a.scope)
        kinds = {n: a.scope[n] if a.scope[n].kind != "null" else b.scope[n] for n in names}

        def shown(state: State) -> DataFrame:
            return state.df.select(*self.carried, *[(V.to_variant(v) if self.mixed(a, b, n) else V.plain(v)).alias(f"u_{i}") for i, (n, v) in enumerate(state.scope.items())])

        df = shown(a).union(shown(b))
        scope = {}
        for i, n in enumerate(names):
            k = kinds[n]
            scope[n] = V.variant(F.col(f"u_{i}")) if self.mixed(a, b, n) else V.element(V.list_of(F.lit(None), replace(k, col=None, get=None)), F.col(f"u_{i}"))
        state = State(df, scope)
        return state if keep else self.distinct(state)

    @staticmethod
    def mixed(a: State, b: State, name: str) -> bool:
        kinds = {a.scope[name].kind, b.scope[name].kind} - {"null"}
        return len(kinds) > 1

    def clause(self, clause, state: State) -> State:
        if isinstance(clause, L.Match):
            state = self.optional(clause, state) if clause.optional else self.match(clause, state)
            if self.expanded is not None and self.outer is None:
                self.expanded.append(state.df)
            return state
        if isinstance(clause, L.Unwind):
            return self.unwind(clause, state)
        if isinstance(clause, L.Project):
            return self.project(clause, state)
        if isinstance(clause, L.SubQuery):
            return self.subquery(clause, state)
        if isinstance(clause, L.Procedure):
            return self.procedure(clause, state)
        raise GraphError(f"{type(clause).__name__} writes; this is a reading query")

    def rows(self, state: State) -> DataFrame:
        if state.df is not None:
            return state.df
        if self.outer is not None:
            return self.outer
        return self.graph.spark.range(1).select(F.lit(True).alias("one"))

    # MATCH

    def match(self, clause: L.Match, state: State) -> State:
        scope, used = dict(state.scope), []
        df = state.df if state.df is not None else self.outer
        for pattern in clause.patterns:
            df, scope = self.path(pattern, df, scope, used)
        state = State(df, scope)
        if clause.where is not None:
            state = self.filtered(state, clause.where)
        return state

    def counted_arms(self, clause: L.Match, after: L.Project, state: State) -> State | None:
        """A MATCH whose bindings are only counted by one of its nodes: that node's rows, each with its `bindings`.

        Without the node the pattern falls into arms. Each arm is counted by the node and the counts are multiplied,
        so that the pairs of arms are never rows. Two arms of one edge each may meet in the same edge, which a MATCH
        doesn't repeat; those pairs are counted and taken off. None where the pattern or what follows asks for more.
        """
        shown, tests = [e for e, _ in after.items] + [e for e, _ in after.order], _conjuncts(clause.where) if clause.where is not None else []
        if clause.optional or state.df is not None or state.scope or self.outer is not None or self.carried or self.budgets or self.expanded is not None or after.star:
            return None
        if not any(L.has_aggregate(e) for e, _ in after.items) or any(_find(e, L.Exists) for e in [*shown, *tests]) or after.where is not None and _find(after.where, L.Exists):
            return None
        if any(not f.star for e in shown for f in _find(e, L.Fn) if f.name in L.AGGREGATES):
            return None
        keys = set().union(*[L.free(e) for e, _ in after.items])
        parts = [p for pattern in clause.patterns for p in (*pattern.nodes, *pattern.edges)]
        named = {p.var for p in parts if p.var}
        if len(keys) != 1 or any(L.free(e) - keys & named for e in shown) or any(p.var or p.shortest or not p.edges for p in clause.patterns) or any(L.free(x) for p in parts for _, x in p.props):
            return None
        hub, nodes, links = next(iter(keys)), {}, []
        for pattern in clause.patterns:
            if any(e.high is not None for e in pattern.edges):
                return None
            names = []
            for n in pattern.nodes:
                name = n.var or self.fresh("unnamed")
                old = nodes.get(name)
                nodes[name] = L.NodePattern(name, tuple(dict.fromkeys((old.labels if old else ()) + n.labels)), (old.props if old else ()) + n.props)
                names.append(name)
            links += [(a, replace(e, var=e.var or self.fresh("unnamed")), b) for a, e, b in zip(names, pattern.edges, names[1:])]
        edge_names = [e.var for _, e, _ in links]
        if hub not in nodes or len(set(edge_names)) < len(edge_names) or set(edge_names) & set(nodes):
            return None
        arms, todo = [], list(links)
        while todo:
            first = next((x for x in todo if hub in (x[0], x[2])), None)
            if first is None or first[0] == first[2]:
                return None
            todo.remove(first)
            arm, met = [first], {first[0], first[2]} - {hub}
            while more := next((x for x in todo if {x[0], x[2]} & met), None):
                todo.remove(more)
                arm.append(more)
                met |= {more[0], more[2]} - {hub}
            arms.append((arm, met | {e.var for _, e, _ in arm}))
        if len(arms) < 2:
            return None
        wheres = [[] for _ in arms]
        for test in tests:
            home = next((i for i, (_, own) in enumerate(arms) if L.free(test) <= own | {hub}), None)
            if home is None:
                return None
            wheres[home].append(test)
        shared = any(not a.types or not b.types or set(a.types) & set(b.types) for i, (x, _) in enumerate(arms) for y, _ in arms[i + 1 :] for _, a, _ in x for _, b, _ in y)
        if shared and (len(arms) > 2 or any(len(arm) > 1 for arm, _ in arms)):
            return None
        found = []
        for (arm, _), own in zip(arms, wheres):
            test = None
            for t in own:
                test = t if test is None else L.Op("and", test, t)
            found.append(self.match(L.Match([L.PathPattern(None, (nodes[a], nodes[b]), (e,)) for a, e, b in arm], test), State(None)))
        prefix = self.fresh(hub)
        df, product = self.node_scan(prefix), F.lit(1).cast("bigint")
        for state in found:
            at, n = self.fresh("hub"), self.fresh("n")
            df = df.join(state.df.groupBy(state.scope[hub].get("id").alias(at)).agg(F.count(F.lit(1)).alias(n)), F.col(f"{prefix}__id") == F.col(at))
            product = product * F.col(n)
        if shared:
            at, n = self.fresh("hub"), self.fresh("n")
            ends = [x.df.select(x.scope[hub].get("id").alias(at), x.scope[arm[0][1].var].get("id").alias("edge")) for x, (arm, _) in zip(found, arms)]
            df = df.join(ends[0].join(ends[1], [at, "edge"]).groupBy(at).agg(F.count(F.lit(1)).alias(n)), F.col(f"{prefix}__id") == F.col(at), "left")
            product = product - F.coalesce(F.col(n), F.lit(0))
        df = df.withColumn("bindings", product).where("bindings > 0")
        return State(df, {hub: self.flat(prefix, self.graph.node_schema, hub)})

    def filtered(self, state: State, test) -> State:
        """Rows where test is true; EXISTS in conjunctions becomes a semi or anti join."""
        plain = []
        for part in _conjuncts(test):
            if isinstance(part, L.Exists):
                state = self.exists(part.query, state, True)
            elif isinstance(part, L.Op) and part.name == "not" and isinstance(part.left, L.Exists):
                state = self.exists(part.left.query, state, False)
            else:
                plain.append(part)
        for part in plain:
            state = self.with_exists(part, state)
            state = State(state.df.where(V.as_bool(self.value(part, state.scope))), state.scope)
        return state

    def element_filter(self, df: DataFrame, v: Value, props: tuple, scope: dict) -> DataFrame:
        for name, e in props:
            df = df.where(V.equal(V.prop(v, name), self.value(e, scope)))
        return df

    def node_scan(self, prefix: str) -> DataFrame:
        nodes = self.graph.nodes
        return nodes.select(*[F.col(f).alias(f"{prefix}__{f}") for f in self.graph.node_schema.fields])

    def edge_scan(self, prefix: str, pattern: L.EdgePattern, flipped: bool) -> DataFrame:
        """Edges with the ends to join as <prefix>__from and <prefix>__to; undirected ones stand both ways, a loop once."""
        edges = self.graph.edges
        if pattern.types:
            edges = edges.where(F.col("type").isin(*pattern.types))
        shown = [F.col(f).alias(f"{prefix}__{f}") for f in self.graph.edge_schema.fields]
        ahead = edges.select(*shown, F.col("src").alias(f"{prefix}__from"), F.col("dst").alias(f"{prefix}__to"))
        back = edges.select(*shown, F.col("dst").alias(f"{prefix}__from"), F.col("src").alias(f"{prefix}__to"))
        if pattern.direction == "both":
            return ahead.union(back.where(f"`{prefix}__from` <> `{prefix}__to`"))
        return ahead if (pattern.direction == "out") != flipped else back

    def path(self, pattern: L.PathPattern, df, scope: dict, used: list) -> tuple[DataFrame, dict]:
        """used: (column of an edge id or of an array of them, is array, types) of this MATCH, for edges don't repeat in it."""
        places: list[Value | None] = [None] * len(pattern.nodes)
        for i, node in enumerate(pattern.nodes):
            if node.var in scope:
                if scope[node.var].kind == "null":
                    scope[node.var] = self.null_element(self.graph.node_schema)
                if scope[node.var].kind != "node":
                    raise GraphError(f"{node.var} isn't a node")
                places[i] = scope[node.var]
        if not any(places):
            df, places[0] = self.scan_node(pattern.nodes[0], df, scope)
        for i, v in enumerate(places):
            if v is not None and pattern.nodes[i].var in scope:
                df = self.check_node(df, v, pattern.nodes[i], scope)
        if pattern.shortest:
            return self.shortest(pattern, df, scope, places)
        pieces: list = [None] * len(pattern.edges)
        todo = set(range(len(pattern.edges)))
        while todo:
            ready = [k for k in sorted(todo) if places[k] is not None or places[k + 1] is not None]
            k = next((k for k in ready if places[k] is not None and places[k + 1] is not None), ready[0] if ready else None)
            if k is None:
                raise GraphError("a pattern fell apart")
            todo.discard(k)
            flipped = places[k] is None
            df = self.hop(pattern, k, flipped, df, scope, places, pieces, used)
        if pattern.var:
            if pattern.var in scope:
                raise GraphError(f"{pattern.var} is bound already")
            nodes, edges = [F.array(places[0].get("id"))], [F.array().cast("array<bigint>")]
            for k, piece in enumerate(pieces):
                nodes.append(piece["nodes"] if piece["list"] else F.array(places[k + 1].get("id")))
                edges.append(piece["edges"] if piece["list"] else F.array(piece["edges"]))
            name = self.fresh("path")
            df = df.withColumn(name, F.struct(F.concat(*nodes).alias("nodes"), F.concat(*edges).alias("edges")))
            scope[pattern.var] = Value("path", F.col(name))
        return df, scope

    def null_element(self, schema) -> Value:
        kinds = {"id": "bigint", "labels": "array<string>", "src": "bigint", "dst": "bigint", "type": "string"}
        return schema.value(lambda f: F.lit(None).cast(kinds.get(f, "string")))

    def check_node(self, df, v: Value, node: L.NodePattern, scope: dict) -> DataFrame:
        for label in node.labels:
            df = df.where(F.array_contains(v.get("labels"), label))
        return self.element_filter(df.where(v.get("id").isNotNull()), v, node.props, scope)

    def scan_node(self, node: L.NodePattern, df, scope: dict) -> tuple[DataFrame, Value]:
        prefix = self.fresh(node.var or "n")
        v = self.flat(prefix, self.graph.node_schema, node.var)
        found = self.node_scan(prefix)
        for label in node.labels:
            found = found.where(F.array_contains(F.col(f"{prefix}__labels"), label))
        alone = [(n, e) for n, e in node.props if not L.free(e) & set(scope)]
        found = self.element_filter(found, v, alone, scope)
        keyed = [(n, e) for n, e in node.props if L.free(e) & set(scope)]
        if df is None:
            out = found
        elif keyed:
            test = F.lit(True)
            for n, e in keyed:
                test = test & V.equal(V.prop(v, n), self.value(e, scope))
            out = df.join(found, test)
        else:
            out = df.join(found)  # patterns that share nothing; WHERE may still tie them
        if node.var:
            scope[node.var] = v
        return out, v

    def hop(self, pattern, k: int, flipped: bool, df, scope, places, pieces, used) -> DataFrame:
        edge = pattern.edges[k]
        near, far = (k + 1, k) if flipped else (k, k + 1)
        if edge.high is not None:
            df, piece, end = self.walk(edge, flipped, df, scope, places[near], used)
        else:
            df, piece, end = self.step(edge, flipped, df, scope, places[near], used, places[far])
        pieces[k] = piece
        node = pattern.nodes[far]
        if places[far] is not None:
            return df.where(F.col(end) == places[far].get("id"))
        if node.var in scope:
            places[far] = scope[node.var]
            return self.check_node(df.where(F.col(end) == places[far].get("id")), places[far], node, scope)
        later = [j for j in range(len(pattern.nodes)) if j != far and node.var and pattern.nodes[j].var == node.var]
        if not node.var and not node.labels and not node.props:
            places[far] = Value("node", get=lambda f: F.col(end), schema=self.graph.node_schema)
            return df
        prefix = self.fresh(node.var or "n")
        v = self.flat(prefix, self.graph.node_schema, node.var)
        found = self.node_scan(prefix)
        for label in node.labels:
            found = found.where(F.array_contains(F.col(f"{prefix}__labels"), label))
        df = df.join(found, F.col(end) == F.col(f"{prefix}__id"))
        places[far] = v
        if node.var:
            scope[node.var] = v
            for j in later:
                places[j] = v
        return self.element_filter(df, v, node.props, scope)

    def unrepeated(self, df, ids: Column, is_list: bool, types: tuple, used: list, name: str) -> DataFrame:
        for other, other_list, other_types in used:
            if types and other_types and not set(types) & set(other_types):
                continue
            if is_list and other_list:
                df = df.where(~F.arrays_overlap(ids, F.col(other)))
            elif is_list or other_list:
                whole, one = (ids, F.col(other)) if is_list else (F.col(other), ids)
                df = df.where(~F.array_contains(whole, one))
            else:
                df = df.where(ids != F.col(other))
        used.append((name, is_list, types))
        return df

    def step(self, edge: L.EdgePattern, flipped: bool, df, scope, near: Value, used, far: Value | None) -> tuple[DataFrame, dict, str]:
        prefix = self.fresh(edge.var or "e")
        v = self.flat(prefix, self.graph.edge_schema, edge.var)
        found = self.edge_scan(prefix, edge, flipped)
        test = near.get("id") == F.col(f"{prefix}__from")
        if far is not None:
            test = test & (far.get("id") == F.col(f"{prefix}__to"))
        if edge.var in scope:
            test = test & (scope[edge.var].get("id") == F.col(f"{prefix}__id"))
        df = df.join(found, test)
        if edge.var and edge.var not in scope:
            scope[edge.var] = v
        df = self.element_filter(df, v, edge.props, scope)
        df = self.unrepeated(df, F.col(f"{prefix}__id"), False, edge.types, used, f"{prefix}__id")
        return df, {"list": False, "edges": F.col(f"{prefix}__id")}, f"{prefix}__to"

    def walk(self, edge: L.EdgePattern, flipped: bool, df, scope, near: Value, used) -> tuple[DataFrame, dict, str]:
        """A bounded trail: unrolled joins, unioned over the lengths."""
        if edge.var in scope:
            raise GraphError(f"{edge.var} is bound already")
        schema = self.graph.edge_schema
        end, ids, nodes, edges = (self.fresh(s) for s in ("end", "ids", "visited", "edges"))
        shape = self.graph.edges.select(F.struct(*[F.col(f) for f in schema.fields]).alias("s")).schema["s"].dataType
        keep = list(df.columns)
        now = df.select(*keep, near.get("id").alias(end), F.array().cast("array<bigint>").alias(ids), F.array().cast("array<bigint>").alias(nodes), F.array().cast(f"array<{shape.simpleString()}>").alias(edges))
        found, length = [now] if edge.low == 0 else [], edge.high
        for k in range(1, length + 1):
            prefix = self.fresh("w")
            v = self.flat(prefix, schema)
            links = self.edge_scan(prefix, edge, flipped)
            now = now.join(links, F.col(end) == F.col(f"{prefix}__from")).where(~F.array_contains(ids, F.col(f"{prefix}__id")))
            now = self.element_filter(now, v, edge.props, scope)
            now = now.select(*keep, F.col(f"{prefix}__to").alias(end), F.array_append(ids, F.col(f"{prefix}__id")).alias(ids), F.array_append(nodes, F.col(f"{prefix}__to")).alias(nodes), F.array_append(edges, schema.struct(v.get)).alias(edges))
            if k % UNROLLED == 0 and k < length:
                now = cut(now, "walk")
                if now.isEmpty():
                    break
            if k >= edge.low:
                found.append(now)
        found = found or [now]  # the walk ended before the least length: no rows
        out = found[0]
        for more in found[1:]:
            out = out.unionAll(more)
        out = self.unrepeated(out, F.col(ids), True, edge.types, used, ids)
        trail, seen = F.col(edges), F.col(nodes)
        if flipped:  # walked from the right end
            trail = F.reverse(edges)
            seen = F.when(F.size(nodes) > 0, F.concat(F.reverse(F.slice(F.col(nodes), F.lit(1), F.greatest(F.size(nodes) - 1, F.lit(0)))), F.array(near.get("id")))).otherwise(F.col(nodes))
        if edge.var:
            name = self.fresh("trail")
            out = out.withColumn(name, trail)
            scope[edge.var] = V.list_of(F.col(name), Value("edge", schema=schema))
        order = F.reverse(ids) if flipped else F.col(ids)
        return out, {"list": True, "edges": order, "nodes": seen}, end

    def shortest(self, pattern, df, scope, places) -> tuple[DataFrame, dict]:
        """One minimal walk for each pair of ends; among equals the one whose edge ids come first."""
        edge = pattern.edges[0]
        left = places[0]
        if left is None:
            df, left = self.scan_node(pattern.nodes[0], df, scope)
        start, end = self.fresh("s"), self.fresh("t")
        frontier = df.select(left.get("id").alias(start)).distinct()
        empty = F.array().cast("array<bigint>")
        frontier = cut(frontier.select(start, F.col(start).alias(end), empty.alias("sp_edges"), F.array(F.col(start)).alias("sp_nodes")), "bfs")
        seen, found = frontier, [frontier] if edge.low == 0 else []
        for k in range(1, edge.high + 1):
            prefix = self.fresh("b")
            v = self.flat(prefix, self.graph.edge_schema)
            links = self.element_filter(self.edge_scan(prefix, edge, False), v, edge.props, {})
            grown = frontier.join(links, F.col(end) == F.col(f"{prefix}__from"))
            grown = grown.select(start, F.col(f"{prefix}__to").alias(end), F.array_append("sp_edges", F.col(f"{prefix}__id")).alias("sp_edges"), F.array_append("sp_nodes", F.col(f"{prefix}__to")).alias("sp_nodes"))
            grown = grown.join(seen.select(start, end), [start, end], "left_anti")
            frontier = cut(grown.groupBy(start, end).agg(F.min(F.struct("sp_edges", "sp_nodes")).alias("m")).select(start, end, "m.sp_edges", "m.sp_nodes"), "bfs")
            if frontier.isEmpty():
                break
            seen = seen.unionAll(frontier)
            if k >= edge.low:
                found.append(frontier)
        if not found:
            found = [frontier.limit(0)]
        out = found[0]
        for more in found[1:]:
            out = out.unionAll(more)
        path = self.fresh("path")
        out = out.select(start, end, F.struct(F.col("sp_nodes").alias("nodes"), F.col("sp_edges").alias("edges")).alias(path))
        df = df.join(out, left.get("id") == F.col(start))
        node = pattern.nodes[1]
        if places[1] is not None:
            df = df.where(F.col(end) == places[1].get("id"))
        elif node.var or node.labels or node.props:
            prefix = self.fresh(node.var or "n")
            v = self.flat(prefix, self.graph.node_schema, node.var)
            df = df.join(self.node_scan(prefix), F.col(end) == F.col(f"{prefix}__id"))
            if node.var:
                scope[node.var] = v
            df = self.check_node(df, v, node, scope)
        if edge.var:
            raise GraphError("shortestPath binds a path, not its relationships")
        if pattern.var:
            scope[pattern.var] = Value("path", F.col(path))
        return df, scope

    # Correlated parts

    def imports(self, state: State, names: set[str]) -> tuple[list[tuple[str, Column]], DataFrame, dict]:
        """Columns that tell the outer rows apart for the inner part, its distinct outer rows, and its scope."""
        df, scope, keys, first = state.df, {}, [], []
        for c in self.carried:
            keys.append((c, F.col(c)))
        for n in sorted(names & set(state.scope)):
            v = state.scope[n]
            if v.kind in ("node", "edge"):
                prefix = self.fresh(n)
                keys.append((f"{prefix}__id", v.get("id")))
                first += [F.first(v.get(f)).alias(f"{prefix}__{f}") for f in v.schema.fields if f != "id"]
                scope[n] = self.flat(prefix, v.schema, n)
            else:
                name = self.fresh(n)
                if v.kind == "any":
                    keys.append((f"{name}_k", F.to_json(v.col)))
                    first.append(F.first(v.col).alias(name))
                elif v.kind == "map":
                    keys.append((f"{name}_k", F.to_json(v.col)))
                    first.append(F.first(v.col).alias(name))
                else:
                    keys.append((name, v.col))
                scope[n] = replace(V.element(V.list_of(F.lit(None), replace(v, col=None, get=None)), F.col(name)))
        if not keys:
            return keys, None, scope
        grouped = df.groupBy(*[c.alias(n) for n, c in keys])
        rows = grouped.agg(*first) if first else grouped.agg(F.lit(1).alias(self.fresh("one")))
        return keys, rows, scope

    def inner(self, state: State, names: set[str], build) -> tuple[list, State]:
        """Run build(state) over the distinct imports; its rows carry the keys."""
        keys, rows, scope = self.imports(state, names)
        saved = self.carried, self.outer
        self.carried, self.outer = [n for n, _ in keys], rows
        try:
            return keys, build(State(rows, scope))
        finally:
            self.carried, self.outer = saved

    def join_back(self, state: State, keys: list, inner: DataFrame, how: str) -> DataFrame:
        renamed = {n: self.fresh("k") for n, _ in keys}
        inner = inner.withColumnsRenamed(renamed)
        left = self.rows(state)
        test = F.lit(True)
        for n, c in keys:
            test = test & c.eqNullSafe(F.col(renamed[n]))
        return left.join(inner, test, how)

    def exists(self, query: L.GraphQuery, state: State, wanted: bool) -> State:
        keys, inner = self.inner(state, L.free(query), lambda s: self.existing(query, s))
        found = self.rows(inner).select(*[n for n, _ in keys]).distinct() if keys else self.rows(inner).limit(1).select(F.lit(1).alias(self.fresh("one")))
        return State(self.join_back(state, keys, found, "left_semi" if wanted else "left_anti"), state.scope)

    def existing(self, query: L.GraphQuery, start: State) -> State:
        """EXISTS needs no RETURN."""
        last = query.clauses[-1]
        if isinstance(last, L.Project) and last.final:
            return self.run(query, start)
        state = start
        for clause in query.clauses:
            state = self.clause(clause, state)
        return state

    def with_exists(self, e, state: State) -> State:
        """EXISTS inside other expressions becomes a flag column."""
        for x in _find(e, L.Exists):
            keys, inner = self.inner(state, L.free(x.query), lambda s, q=x.query: self.existing(q, s))
            name = self.fresh("exists")
            found = self.rows(inner).select(*[n for n, _ in keys]).distinct() if keys else self.rows(inner).limit(1).select(F.lit(1).alias(self.fresh("one")))
            df = self.join_back(state, keys, found.withColumn(name, F.lit(True)), "left")
            df = df.withColumn(name, F.coalesce(F.col(name), F.lit(False)))
            self.flags = getattr(self, "flags", {}) | {id(x): name}
            state = State(df, state.scope)
        return state

    def optional(self, clause: L.Match, state: State) -> State:
        names = L.free(clause)
        keys, inner = self.inner(state, names, lambda s: self.match(L.Match(clause.patterns, clause.where), s))
        new = {n: v for n, v in inner.scope.items() if n not in state.scope}
        columns, scope = [], {}
        for n, v in new.items():
            shown, scope[n] = self.stored(n, v)
            columns += shown
        df = self.join_back(state, keys, inner.df.select(*[n for n, _ in keys], *columns), "left")
        return State(df, state.scope | scope)

    def stored(self, name: str, v: Value) -> tuple[list[Column], Value]:
        """v as columns of its own, and the value that reads them."""
        prefix = self.fresh(name)
        if v.kind in ("node", "edge"):
            return [v.get(f).alias(f"{prefix}__{f}") for f in v.schema.fields], self.flat(prefix, v.schema, name)
        return [v.col.alias(prefix)], V.element(V.list_of(F.lit(None), replace(v, col=None, get=None)), F.col(prefix))

    def subquery(self, clause: L.SubQuery, state: State) -> State:
        if unknown := set(clause.imports) - set(state.scope):
            raise GraphError(f"{sorted(unknown)[0]} isn't bound")
        last = clause.query.clauses[-1]
        if not (isinstance(last, L.Project) and last.final):
            raise GraphError("CALL needs RETURN at its end")
        keys, inner = self.inner(state, set(clause.imports), lambda s: self.run(clause.query, s))
        columns, scope = [], {}
        for n, v in inner.scope.items():
            if n in state.scope:
                raise GraphError(f"CALL would shadow {n}")
            shown, scope[n] = self.stored(n, v)
            columns += shown
        df = self.join_back(state, keys, inner.df.select(*[n for n, _ in keys], *columns), "inner")
        return State(df, state.scope | scope)

    def procedure(self, clause: L.Procedure, state: State) -> State:
        df, scope = self.graph.procedure(self, clause, state)
        for _, alias in clause.yields:
            if alias in state.scope:
                raise GraphError(f"YIELD would shadow {alias}")
        out = State(df, state.scope | scope)
        return self.filtered(out, clause.where) if clause.where is not None else out

    def unwind(self, clause: L.Unwind, state: State) -> State:
        if clause.var in state.scope:
            raise GraphError(f"{clause.var} is bound already")
        items = V.as_list(self.value(clause.value, state.scope))
        name = self.fresh(clause.var)
        df = self.rows(state).withColumn(name, F.explode(items.col))
        return State(df, state.scope | {clause.var: V.element(items, F.col(name))})

    # WITH and RETURN

    def project(self, clause: L.Project, state: State) -> State:
        items = list(clause.items)
        if clause.star:
            items = [(L.Var(n), n) for n in sorted(state.scope)] + items
        named = [(e, alias or _name(e, i)) for i, (e, alias) in enumerate(items, 1)]
        if len({n for _, n in named}) < len(named):
            raise GraphError("two columns have one name")
        for e, alias in items:
            if not clause.final and alias is None and not isinstance(e, L.Var):
                raise GraphError("WITH needs AS for an expression")
        order = list(clause.order)
        for e, _ in named + order:
            state = self.with_exists(e, State(self.rows(state), state.scope) if _find(e, L.Exists) else state)
        if any(L.has_aggregate(e) for e, _ in named):
            out, orders = self.aggregated(named, order, state)
        else:
            df, scope, columns = self.rows(state), {}, []
            for e, n in named:
                v = self.value(e, state.scope)
                shown, scope[n] = self.stored(n, v)
                columns += shown
            sort, orders = [], []
            both = state.scope | scope
            for e, down in order:
                name = self.fresh("o")
                hit = next((scope[n] for x, n in named if x == e or isinstance(e, L.Var) and e.name == n), None)
                source = self.value(e, state.scope) if hit is None and not (L.free(e) & set(scope) - set(state.scope)) else None
                if source is not None:
                    sort.append(source.key.alias(name))
                    orders.append((F.col(name), down))
                elif hit is not None:
                    orders.append((hit.key, down))
                else:
                    # Names of both sides: projected ones win, over the columns made here.
                    orders.append((e, down, both))
            df = df.select(*self.carried, *columns, *sort)
            out = State(df, scope)
            orders = [(self.value(o[0], out.scope).key, o[1]) if len(o) == 3 else o for o in orders]
        if clause.where is not None:
            out = self.filtered(out, clause.where)
        if clause.distinct:
            out = self.distinct(out)
            # After DISTINCT only what is selected can be sorted by.
            orders = [(next((v.key for x, n in named if (x == e or isinstance(e, L.Var) and e.name == n) and (v := out.scope[n])), None), down) for e, down in order]
            if any(o[0] is None for o in orders):
                raise GraphError("after DISTINCT, ORDER BY takes what is selected")
        return self.sliced(out, orders, self.count(clause.skip), self.count(clause.limit))

    def count(self, e) -> int | None:
        if e is None:
            return None
        if L.free(e):
            raise GraphError("SKIP and LIMIT see no variables")
        n = _constant(e, self.parameters)
        if not isinstance(n, int) or isinstance(n, bool) or n < 0:
            raise GraphError("SKIP and LIMIT need a whole number")
        return n

    def sliced(self, state: State, orders: list, skip: int | None, limit: int | None) -> State:
        keys = [c.desc_nulls_first() if down else c.asc_nulls_last() for c, down in orders]
        df = state.df
        if self.carried and (skip or limit is not None):
            name = self.fresh("row")
            place = F.row_number().over(W.partitionBy(*self.carried).orderBy(*(keys or [F.lit(0)])))
            df = df.withColumn(name, place).where(F.col(name) > (skip or 0))
            return State(df.where(F.col(name) <= (skip or 0) + limit) if limit is not None else df, state.scope)
        if keys and not self.carried:
            df = df.orderBy(*keys)
        if skip:
            df = df.offset(skip)
        if limit is not None:
            df = df.limit(limit)
        return State(df, state.scope)

    def grouped(self, scope_items: list[tuple[str, Value]]) -> tuple[list[Column], list[Column], dict]:
        """Group columns, further aggregates that restore the values, and the scope over them."""
        keys, rest, scope = [F.col(c) for c in self.carried], [], {}
        for n, v in scope_items:
            prefix = self.fresh(n)
            if v.kind in ("node", "edge"):
                keys.append(v.get("id").alias(f"{prefix}__id"))
                rest += [F.first(v.get(f)).alias(f"{prefix}__{f}") for f in v.schema.fields if f != "id"]
                scope[n] = self.flat(prefix, v.schema, n)
            elif v.kind in ("any", "map") or v.kind == "list" and v.item.kind in ("any", "map"):
                keys.append(F.to_json(v.col).alias(f"{prefix}_k"))
                rest.append(F.first(v.col).alias(prefix))
                scope[n] = V.element(V.list_of(F.lit(None), replace(v, col=None, get=None)), F.col(prefix))
            else:
                keys.append(v.col.alias(prefix))
                scope[n] = V.element(V.list_of(F.lit(None), replace(v, col=None, get=None)), F.col(prefix))
        return keys, rest, scope

    def distinct(self, state: State) -> State:
        keys, rest, scope = self.grouped(list(state.scope.items()))
        rest = rest or [F.lit(1).alias(self.fresh("one"))]
        return State(state.df.groupBy(*keys).agg(*rest), scope)

    def aggregated(self, named: list, order: list, state: State) -> tuple[State, list]:
        plain = [(e, n) for e, n in named if not L.has_aggregate(e)]
        keys, rest, scope = self.grouped([(n, self.value(e, state.scope)) for e, n in plain])
        # Variables that stand beside aggregates must be group keys.
        known = {e: n for e, n in plain}
        aggregates, values, defaults = [], {}, {}

        def collect(e):
            if isinstance(e, L.Fn) and e.name in L.AGGREGATES:
                if e not in values:
                    name = self.fresh("agg")
                    column, shape, default = self.aggregate(e, state.scope)
                    aggregates.append(column.alias(name))
                    values[e] = V.element(V.list_of(F.lit(None), shape), F.col(name))
                    defaults[name] = default
                return
            if e in known:
                return
            if isinstance(e, L.Var):
                raise GraphError(f"{e.name} stands beside an aggregate but isn't a group key")
            for c in L.children(e):
                collect(c)

        for e, _ in named:
            if L.has_aggregate(e):
                collect(e)
        for e, _ in order:
            if L.has_aggregate(e):
                collect(e)
        df = self.rows(state)
        made = df.groupBy(*keys).agg(*aggregates, *rest)
        if not plain and self.carried:  # an aggregate of nothing is a row, too
            outer = self.outer.select(*[F.col(c).alias(f"{c}_o") for c in self.carried])
            test = F.lit(True)
            for c in self.carried:
                test = test & F.col(f"{c}_o").eqNullSafe(F.col(c))
            made = outer.join(made, test, "left").select(*[F.col(f"{c}_o").alias(c) for c in self.carried], *[(F.coalesce(F.col(n), d) if d is not None else F.col(n)).alias(n) for n, d in defaults.items()])
        out_scope, columns = {}, []
        lookup = {e: scope[n] for e, n in known.items()} | values
        for e, n in named:
            v = scope[n] if not L.has_aggregate(e) else self.value(e, scope, lookup)
            shown, out_scope[n] = self.stored(n, v)
            columns += shown
        orders, sort = [], []
        for e, down in order:
            name = self.fresh("o")
            hit = next((n for x, n in named if x == e or isinstance(e, L.Var) and e.name == n), None)
            if hit is not None:
                orders.append((out_scope[hit].key, down))
            elif L.free(e) <= set(out_scope) and not L.has_aggregate(e):
                orders.append((self.value(e, out_scope).key, down))
            else:
                sort.append(self.value(e, scope, lookup).key.alias(name))
                orders.append((F.col(name), down))
        return State(made.select(*self.carried, *columns, *sort), out_scope), orders

    def aggregate(self, e: L.Fn, scope: dict) -> tuple[Column, Value, Column | None]:
        """Column, shape of the value, and the value for no rows."""
        if e.star:
            count = F.count(F.lit(1)) if self.weight is None else F.coalesce(F.sum(self.weight), F.lit(0))
            return count, Value("num"), F.lit(0).cast("bigint")
        if L.has_aggregate(e.args[0]):
            raise GraphError("aggregates don't nest")
        v = self.value(e.args[0], scope)
        if e.name == "count":
            return (F.count_distinct(v.key) if e.distinct else F.count(v.key)), Value("num"), F.lit(0).cast("bigint")
        if e.name == "collect":
            shape = replace(v, col=None, get=None, var=None)
            if v.kind in ("node", "edge"):
                whole = F.when(v.key.isNotNull(), v.schema.struct(v.get) if v.col is None else v.col)
                column = F.collect_list(whole)
                if e.distinct:
                    column = F.collect_set(whole) if v.schema.props is not None else F.collect_list(whole)
            else:
                column = F.collect_set(v.key) if e.distinct else F.collect_list(v.col)
                if e.distinct and v.kind == "any":
                    column = F.transform(column, lambda x: F.parse_json(x))
            return column, Value("list", item=shape), None if v.kind == "null" else F.array()
        if e.name in ("sum", "avg"):
            if v.kind not in ("num", "any", "null"):
                raise GraphError(f"{e.name} needs numbers")
            x = V.as_num(v)
            if v.kind == "any":
                x = F.when(v.col.isNotNull() & x.isNull(), F.raise_error(F.lit(f"{e.name} needs numbers")).cast(V.EXACT)).otherwise(x)
            if e.name == "avg":
                x = x.cast("decimal(28,10)")
                return (F.sum_distinct(x) / F.count_distinct(x) if e.distinct else F.avg(x)), Value("num"), None
            total = F.sum_distinct(x) if e.distinct else F.sum(x)
            return F.coalesce(total, F.lit(0)), Value("num"), F.lit(0)
        if v.kind == "any":
            return (F.min if e.name == "min" else F.max)(F.struct(V.as_num(v).alias("n"), V.as_text(v).alias("t"), F.to_json(v.col).alias("j")))["j"], Value("str"), None
        return (F.min(v.key) if e.name == "min" else F.max(v.key)), replace(v, get=None, kind="num" if v.kind in ("node", "edge") else v.kind), None

    # Expressions

    def value(self, e, scope: dict, known: dict | None = None) -> Value:
        if known and e in known:
            return known[e]
        return getattr(self, "v_" + type(e).__name__.lower())(e, scope, known)

    def v_const(self, e, scope, known) -> Value:
        return V.constant(e.value)

    def v_argument(self, e, scope, known) -> Value:
        if e.name not in self.parameters:
            raise GraphError(f"no value for parameter ${e.name}")
        return V.constant(self.parameters[e.name])

    def v_var(self, e, scope, known) -> Value:
        if e.name not in scope:
            raise GraphError(f"{e.name} isn't bound")
        return scope[e.name]

    def v_listof(self, e, scope, known) -> Value:
        return V.make_list([self.value(x, scope, known) for x in e.items])

    def v_mapof(self, e, scope, known) -> Value:
        return V.make_map({n: self.value(x, scope, known) for n, x in e.items})

    def v_prop(self, e, scope, known) -> Value:
        return V.prop(self.value(e.base, scope, known), e.name)

    def v_at(self, e, scope, known) -> Value:
        base, index = self.value(e.base, scope, known), self.value(e.index, scope, known)
        if isinstance(e.index, L.Const) and isinstance(e.index.value, str) and base.kind in ("map", "node", "edge", "any"):
            return V.prop(base, e.index.value)
        if base.kind in ("node", "edge", "map") and index.kind == "str":
            name = _constant(e.index, self.parameters)
            return V.prop(base, name)
        items = V.as_list(base)
        if index.kind not in ("num", "any", "null"):
            raise GraphError("a list is indexed by a number")
        at = V.as_num(index).cast("int")
        return V.element(items, F.when(at >= 0, F.get(items.col, at)).otherwise(F.get(items.col, F.size(items.col) + at)))

    def v_part(self, e, scope, known) -> Value:
        items = V.as_list(self.value(e.base, scope, known))
        size = F.size(items.col)

        def bound(x, default):
            if x is None:
                return default
            at = V.as_num(self.value(x, scope, known)).cast("int")
            return F.greatest(F.lit(0), F.least(size, F.when(at < 0, size + at).otherwise(at)))

        low, high = bound(e.low, F.lit(0)), bound(e.high, size)
        unknown = F.lit(False)
        for x in (e.low, e.high):
            if x is not None:
                unknown = unknown | V.as_num(self.value(x, scope, known)).isNull()
        return V.list_of(F.when(unknown, F.lit(None)).otherwise(F.slice(items.col, low + 1, F.greatest(high - low, F.lit(0)))), items.item)

    def v_haslabels(self, e, scope, known) -> Value:
        v = self.value(e.base, scope, known)
        test = F.lit(True)
        for label in e.labels:
            test = test & (F.array_contains(v.get("labels"), label) if v.kind == "node" else v.get("type") == label)
        return V.truth(test)

    def v_op(self, e, scope, known) -> Value:
        a = self.value(e.left, scope, known)
        if e.name == "is null":
            return V.truth(a.key.isNull())
        if e.name == "is not null":
            return V.truth(a.key.isNotNull())
        if e.name == "not":
            return V.truth(~V.as_bool(a))
        if e.name == "neg":
            return V.arithmetic("-", V.num(F.lit(0)), a)
        b = self.value(e.right, scope, known)
        if e.name in ("and", "or", "xor"):
            x, y = V.as_bool(a), V.as_bool(b)
            return V.truth(x & y if e.name == "and" else x | y if e.name == "or" else x != y)
        if e.name == "=":
            return V.truth(V.equal(a, b))
        if e.name == "<>":
            return V.truth(~V.equal(a, b))
        if e.name in ("<", "<=", ">", ">="):
            return V.truth(V.compare(e.name, a, b))
        if e.name == "in":
            return V.truth(V.within(a, b))
        if e.name in ("contains", "starts", "ends"):
            for v in (a, b):
                if v.kind not in ("str", "any", "null"):
                    raise GraphError(f"{e.name.upper()} needs texts, not {v.kind}")
            x, y = V.as_text(a), V.as_text(b)
            return V.truth({"contains": F.contains, "starts": F.startswith, "ends": F.endswith}[e.name](x, y))
        return V.arithmetic(e.name, a, b)

    def v_when(self, e, scope, known) -> Value:
        tests = [V.equal(self.value(e.operand, scope, known), self.value(t, scope, known)) if e.operand is not None else V.as_bool(self.value(t, scope, known)) for t, _ in e.branches]
        parts = [self.value(v, scope, known) for _, v in e.branches] + [self.value(e.default, scope, known) if e.default is not None else V.null()]
        kinds = {p.kind for p in parts} - {"null"}
        mixed = len(kinds) > 1
        shown = [V.to_variant(p) if mixed else V.plain(p) for p in parts]
        out = None
        for t, c in zip(tests, shown, strict=False):
            out = F.when(t, c) if out is None else out.when(t, c)
        out = out.otherwise(shown[-1])
        shape = Value("any") if mixed else replace(next((p for p in parts if p.kind != "null"), V.null()), col=None, get=None)
        return V.element(V.list_of(F.lit(None), shape), out)

    def v_comprehension(self, e, scope, known) -> Value:
        items = V.as_list(self.value(e.source, scope, known))
        out = items.col
        if e.test is not None:
            out = F.filter(out, lambda x: V.as_bool(self.value(e.test, scope | {e.var: V.element(items, x)}, known)))
        if e.value is None:
            return V.list_of(out, items.item)
        shape: list[Value] = []

        def apply(x):
            v = self.value(e.value, scope | {e.var: V.element(items, x)}, known)
            shape.append(replace(v, col=None, get=None))
            return V.plain(v)

        made = F.transform(out, apply)
        return V.list_of(made, shape[0])

    def v_quantifier(self, e, scope, known) -> Value:
        items = V.as_list(self.value(e.source, scope, known))

        def test(x):
            return V.as_bool(self.value(e.test, scope | {e.var: V.element(items, x)}, known))

        if e.kind == "any":
            return V.truth(F.exists(items.col, test))
        if e.kind == "all":
            return V.truth(F.forall(items.col, test))
        if e.kind == "none":
            return V.truth(~F.exists(items.col, test))
        sure = F.size(F.filter(items.col, test))
        open_ = F.size(F.filter(items.col, lambda x: test(x).isNull()))
        return V.truth(F.when(items.col.isNull(), F.lit(None)).when(sure > 1, F.lit(False)).when(open_ > 0, F.lit(None)).otherwise(sure == 1))

    def v_reduce(self, e, scope, known) -> Value:
        items, start = V.as_list(self.value(e.source, scope, known)), self.value(e.start, scope, known)
        first = start.col.cast(V.EXACT) if start.kind == "num" else start.col

        def fold(total, x):
            inner = scope | {e.total: replace(start, col=total), e.var: V.element(items, x)}
            out = self.value(e.value, inner, known)
            return out.col.cast(V.EXACT) if start.kind == "num" else out.col

        return replace(start, col=F.aggregate(items.col, first, fold))

    def v_exists(self, e, scope, known) -> Value:
        name = getattr(self, "flags", {}).get(id(e))
        if name is None:
            raise GraphError("EXISTS isn't supported here")
        return V.truth(F.col(name))

    def v_fn(self, e, scope, known) -> Value:
        if e.name in L.AGGREGATES:
            raise GraphError(f"{e.name} isn't allowed here")
        args = [self.value(a, scope, known) for a in e.args]
        return self.function(e.name, args)

    def function(self, name: str, args: list[Value]) -> Value:
        v = args[0]
        if name == "coalesce":
            parts = [a for a in args if a.kind != "null"]
            if not parts:
                return V.null()
            if len({p.kind for p in parts}) > 1:
                return V.variant(F.coalesce(*[V.to_variant(p) for p in parts]))
            return V.element(V.list_of(F.lit(None), replace(parts[0], col=None, get=None)), F.coalesce(*[V.plain(p) for p in parts]))
        if name == "exists":
            return V.truth(v.key.isNotNull())
        if v.kind == "null":
            return V.null()
        if name in ("id", "elementid", "labels", "type", "properties", "startnode", "endnode", "start_id", "end_id"):
            if v.kind not in ("node", "edge") or name == "labels" and v.kind != "node" or name in ("type", "startnode", "endnode", "start_id", "end_id") and v.kind != "edge":
                raise GraphError(f"{name} doesn't take {v.kind}")
            if name == "id":
                return V.num(v.get("id"))
            if name == "elementid":
                return V.text(F.concat(F.lit(f"{self.graph.workspace:x}:g{self.graph.number}:{v.kind[0]}:"), v.get("id").cast("string")))
            if name == "labels":
                return V.list_of(F.array_sort(v.get("labels")), Value("str"))
            if name == "type":
                return V.text(v.get("type"))
            if name == "properties":
                return V.properties(v)
            return V.num(v.get("src" if name in ("startnode", "start_id") else "dst"))
        if name == "keys":
            if v.kind not in ("node", "edge", "map", "any"):
                raise GraphError(f"keys doesn't take {v.kind}")
            return V.list_of(V.keys(v), Value("str"))
        if name in ("nodes", "relationships", "length"):
            if v.kind != "path":
                raise GraphError(f"{name} takes a path")
            if name == "length":
                return V.num(F.size(v.col["edges"]).cast("bigint"))
            return V.list_of(v.col["nodes" if name == "nodes" else "edges"], Value("num"))
        if name in ("head", "last", "tail"):
            items = V.as_list(v)
            if name == "tail":
                return V.list_of(F.slice(items.col, F.lit(2), F.greatest(F.size(items.col) - 1, F.lit(0))), items.item)
            return V.element(items, F.get(items.col, F.lit(0) if name == "head" else F.size(items.col) - 1))
        if name == "size":
            if v.kind == "str":
                return V.num(F.char_length(v.col).cast("bigint"))
            if v.kind == "any":
                return V.num(F.coalesce(F.char_length(V.as_text(v)), F.size(F.try_variant_get(v.col, "$", "array<variant>"))).cast("bigint"))
            return V.num(F.size(V.as_list(v).col).cast("bigint"))
        if name in ("tolower", "toupper", "trim"):
            if v.kind not in ("str", "any"):
                raise GraphError(f"{name} takes a text")
            return V.text({"tolower": F.lower, "toupper": F.upper, "trim": F.trim}[name](V.as_text(v)))
        if name == "tostring":
            return V.text(V.to_text(v))
        if name == "tointeger":
            taken = V.as_num(v) if v.kind == "num" else F.coalesce(V.as_num(v), V.as_text(v).try_cast(V.EXACT))
            return V.num(F.when(taken >= 0, F.floor(taken)).otherwise(F.ceil(taken)).cast("bigint"))
        raise GraphError(f"there is no function {name}")


def _conjuncts(e) -> list:
    if isinstance(e, L.Op) and e.name == "and":
        return _conjuncts(e.left) + _conjuncts(e.right)
    return [e]


def _find(e, kind) -> list:
    if isinstance(e, kind):
        return [e]
    return [x for c in L.children(e) for x in _find(c, kind)]


def _name(e, place: int) -> str:
    if isinstance(e, L.Var):
        return e.name
    return e.name if isinstance(e, L.Prop) else f"column_{place}"


def _constant(e, parameters: dict) -> Any:
    """The value of an expression without variables that SKIP, LIMIT and subscripts take."""
    if isinstance(e, L.Const):
        return int(e.value[1]) if isinstance(e.value, tuple) and e.value[1].isdigit() else e.value
    if isinstance(e, L.Argument):
        if e.name not in parameters:
            raise GraphError(f"no value for parameter ${e.name}")
        return parameters[e.name]
    if isinstance(e, L.Op) and e.name in "+-*":
        a, b = _constant(e.left, parameters), _constant(e.right, parameters)
        return a + b if e.name == "+" else a - b if e.name == "-" else a * b
    raise GraphError("a constant is needed")
