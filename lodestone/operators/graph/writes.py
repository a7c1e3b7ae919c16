"""CREATE, MERGE, SET, REMOVE and DELETE as new versions of a graph's DataFrames.

A statement sees the graph as it was before it, except that MERGE sees what its own earlier rows created.  Every
step is written out, so ids are given once; an error leaves the old graph untouched, since it is never changed.
"""

from __future__ import annotations

import dataclasses
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.operators.graph import language as L
from lodestone.operators.graph import values as V
from lodestone.operators.graph.compiler import Compiler, State
from lodestone.operators.graph.language import GraphError
from lodestone.sources.scratch import cut

WRITES = (L.Create, L.Merge, L.SetItems, L.Remove, L.Delete)


def is_write(query: L.GraphQuery) -> bool:
    return any(isinstance(c, WRITES) for c in query.clauses) or (query.union is not None and is_write(query.union))


class Writer:
    def __init__(self, graph, parameters: dict):
        self.graph, self.parameters, self.affected = graph, parameters, 0

    def run(self, query: L.GraphQuery):
        if query.union is not None:
            raise GraphError("UNION doesn't write")
        compiler = Compiler(self.graph, self.parameters)
        state = State(None)
        for clause in query.clauses:
            if isinstance(clause, L.Create):
                for pattern in clause.patterns:
                    state = self.create(pattern, compiler, self.settled(state, compiler))
            elif isinstance(clause, L.Merge):
                state = self.merge(clause, compiler, self.settled(state, compiler))
            elif isinstance(clause, (L.SetItems, L.Remove)):
                state = self.settled(state, compiler)
                self.change([i if isinstance(clause, L.SetItems) else (*i, L.Const(None)) if i[0] == "prop" else ("unlabel", *i[1:]) for i in clause.items], compiler, state)
            elif isinstance(clause, L.Delete):
                self.delete(clause, compiler, self.settled(state, compiler))
            else:
                compiler.graph = self.graph
                state = compiler.clause(clause, state)
            compiler.graph = self.graph
        for name, index in self.graph.property_indexes.items():
            self.graph.check_unique(name, index)
        return self.graph, self.affected

    def settled(self, state: State, compiler: Compiler) -> State:
        return State(cut(compiler.rows(state), "rows"), state.scope)

    def next_id(self, df: DataFrame) -> int:
        return (df.agg(F.max("id")).first()[0] or 0) + 1

    # Properties

    def props(self, schema, items: dict[str, V.Value]):
        """Columns for a new element's properties; nulls aren't stored."""
        if schema.props is not None:
            if unknown := set(items) - set(schema.props):
                raise GraphError(f"this graph has no property {sorted(unknown)[0]}")
            return None
        pairs = [x for n, v in items.items() for x in (F.lit(n), V.to_variant(v))]
        if not pairs:
            return F.parse_json(F.lit("{}"))
        shown = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull() & ~F.is_variant_null(v))
        return F.to_variant_object(shown)

    def element(self, schema, frame: DataFrame, fixed: dict, items: dict[str, V.Value]) -> DataFrame:
        whole = self.props(schema, items)
        columns = [c.alias(n) for n, c in fixed.items()]
        target = self.graph.nodes if schema.kind == "node" else self.graph.edges
        if whole is not None:
            columns.append(whole.alias("props"))
        else:
            columns += [(V.plain(items[n]) if n in items else F.lit(None)).cast(target.schema[f"p_{n}"].dataType).alias(f"p_{n}") for n in schema.props]
        return frame.select(*columns)

    # CREATE

    def create(self, pattern: L.PathPattern, compiler: Compiler, state: State) -> State:
        """Each row gets its own new nodes and edges."""
        df, scope = state.df, dict(state.scope)
        ends = []
        for node in pattern.nodes:
            if node.var in scope:
                if node.labels or node.props:
                    raise GraphError(f"{node.var} is bound already")
                ends.append(scope[node.var])
                continue
            name = compiler.fresh("new")
            df = cut(df.withColumn(name, F.lit(self.next_id(self.graph.nodes)) + F.monotonically_increasing_id()), "new")
            items = {n: compiler.value(e, scope) for n, e in node.props}
            fixed = {"id": F.col(name), "labels": F.array(*[F.lit(x) for x in sorted(set(node.labels))]).cast("array<string>")}
            added = cut(self.element(self.graph.node_schema, df, fixed, items), "nodes")
            self.graph = self.graph.replaced(self.graph.nodes.unionByName(added), self.graph.edges)
            self.affected += added.count()
            df, v = self.rejoin(df, added, name, self.graph.node_schema, compiler, node.var)
            ends.append(v)
            if node.var:
                scope[node.var] = v
        for k, edge in enumerate(pattern.edges):
            if edge.direction == "both" or len(edge.types) != 1 or edge.high is not None:
                raise GraphError("CREATE needs directed relationships of one type")
            a, b = (ends[k], ends[k + 1]) if edge.direction == "out" else (ends[k + 1], ends[k])
            name = compiler.fresh("new")
            df = cut(df.withColumn(name, F.lit(self.next_id(self.graph.edges)) + F.monotonically_increasing_id()), "new")
            items = {n: compiler.value(e, scope) for n, e in edge.props}
            fixed = {"id": F.col(name), "src": a.get("id"), "dst": b.get("id"), "type": F.lit(edge.types[0])}
            added = cut(self.element(self.graph.edge_schema, df, fixed, items), "edges")
            self.graph = self.graph.replaced(self.graph.nodes, self.graph.edges.unionByName(added))
            self.affected += added.count()
            if edge.var:
                df, scope[edge.var] = self.rejoin(df, added, name, self.graph.edge_schema, compiler, edge.var)
        return State(df, scope)

    def rejoin(self, df: DataFrame, added: DataFrame, name: str, schema, compiler: Compiler, var: str | None):
        prefix = compiler.fresh(var or "n")
        shown = added.select(*[F.col(f).alias(f"{prefix}__{f}") for f in schema.fields])
        return df.join(shown, F.col(name) == F.col(f"{prefix}__id")).drop(name), compiler.flat(prefix, schema, var)

    # MERGE

    def merge(self, clause: L.Merge, compiler: Compiler, state: State) -> State:
        """Match or create, row by row: rows with equal keys create once, and the later ones of them match."""
        pattern = clause.pattern
        df = state.df.withColumn("merge_row", F.monotonically_increasing_id())
        state = State(cut(df, "merge"), state.scope)
        if not pattern.edges:
            return self.merge_element(pattern.nodes[0], clause, compiler, state)
        if len(pattern.edges) > 1 or any(node.var not in state.scope for node in pattern.nodes):
            return self.merge_path(clause, compiler, state)
        return self.merge_element(pattern.edges[0], clause, compiler, state, [state.scope[n.var] for n in pattern.nodes])

    def merge_path(self, clause: L.Merge, compiler: Compiler, state: State) -> State:
        """A whole path matches, or is created as a whole but for its bound nodes.

        Of rows without a match the first of each key (bound ends and property values) creates; then every such row
        matches what is there.  Rows that matched before see none of the new elements.
        """
        if any(len(e.types) != 1 or e.high is not None for e in clause.pattern.edges):
            raise GraphError("MERGE needs relationships of one type")
        named = {k: tuple(x if x.var else replace(x, var=compiler.fresh("merged")) for x in getattr(clause.pattern, k)) for k in ("nodes", "edges")}
        pattern, given = replace(clause.pattern, **named), dict(state.scope)
        keys = {f"mk_{k}": given[n.var].get("id") for k, n in enumerate(pattern.nodes) if n.var in given}
        for k, part in enumerate((*pattern.nodes, *pattern.edges)):
            keys |= {f"mk_{k}_{n}": _storable(compiler.value(e, given)) for n, e in part.props}
        df = cut(state.df.withColumns(keys), "merge") if keys else state.df
        if keys and not df.where(" or ".join(f"`{k}` is null" for k in keys)).isEmpty():
            raise GraphError("MERGE on a null property")
        compiler.graph = self.graph
        met = cut(compiler.match(L.Match([pattern]), State(df, given)).df.select("merge_row").distinct(), "merge")
        first = {"node": self.next_id(self.graph.nodes), "edge": self.next_id(self.graph.edges)}
        turn = F.row_number().over(W.partitionBy(*keys or [F.lit(1)]).orderBy("merge_row"))
        makers = cut(df.join(met, "merge_row", "left_anti").withColumn("mk_turn", turn).where("mk_turn = 1").drop("mk_turn"), "merge")
        made = replace(pattern, nodes=tuple(replace(n, labels=(), props=()) if n.var in given else n for n in pattern.nodes), edges=tuple(replace(e, direction="out") if e.direction == "both" else e for e in pattern.edges))
        self.create(made, compiler, State(makers, given))
        flagged = df.join(met.withColumn("mk_met", F.lit(True)), "merge_row", "left").join(makers.select("merge_row", F.lit(True).alias("mk_maker")), "merge_row", "left")
        flagged = cut(flagged, "merge")

        def bound() -> State:
            compiler.graph = self.graph
            out = compiler.match(L.Match([pattern]), State(flagged, given))
            new = F.lit(False)
            for x in (*pattern.nodes, *pattern.edges):
                if x.var not in given:
                    v = out.scope[x.var]
                    new = new | (v.get("id") >= first[v.kind])
            return State(cut(out.df.where(F.col("mk_met").isNull() | ~new), "merge"), out.scope)

        for made_here, sets in ((True, clause.on_create), (False, clause.on_match)):
            if sets:
                now = bound()
                self.change(list(sets), compiler, State(now.df.where(F.col("mk_maker").isNotNull() == made_here), now.scope))
        out = bound()
        own = {x.var for k in ("nodes", "edges") for x in getattr(clause.pattern, k)}
        return State(out.df.drop("merge_row", "mk_met", "mk_maker", *keys), {n: v for n, v in out.scope.items() if n in given or n in own})

    def merge_element(self, wanted, clause: L.Merge, compiler: Compiler, state: State, ends: list | None = None) -> State:
        is_edge = ends is not None
        schema = self.graph.edge_schema if is_edge else self.graph.node_schema
        items = {n: compiler.value(e, state.scope) for n, e in wanted.props}
        keys = {f"mk_{n}": _storable(v) for n, v in items.items()}
        df = state.df
        for name, column in keys.items():
            df = df.withColumn(name, column)
        if not df.where(" or ".join(f"`{k}` is null" for k in keys) or "false").isEmpty():
            raise GraphError("MERGE on a null property")
        if is_edge:
            if len(wanted.types) != 1:
                raise GraphError("MERGE needs one relationship type")
            a, b = ends if wanted.direction != "in" else ends[::-1]
            df = df.withColumn("mk_src", a.get("id")).withColumn("mk_dst", b.get("id"))
        group = [c for c in df.columns if c.startswith("mk_")]
        df = cut(df, "merge")
        there = self.graph.edges if is_edge else self.graph.nodes
        v = schema.value(lambda f: F.col(f"x__{f}"))
        shown = there.select(*[F.col(f).alias(f"x__{f}") for f in schema.fields])
        test = F.lit(True)
        if is_edge:
            shown = shown.where(F.col("x__type") == wanted.types[0]).withColumns({"x_from": F.col("x__src"), "x_to": F.col("x__dst")})
            if wanted.direction == "both":  # either way round, a loop once
                shown = shown.union(shown.where("x__src <> x__dst").withColumns({"x_from": F.col("x__dst"), "x_to": F.col("x__src")}))
            test = test & (F.col("x_from") == F.col("mk_src")) & (F.col("x_to") == F.col("mk_dst"))
        else:
            for label in wanted.labels:
                shown = shown.where(F.array_contains("x__labels", label))
        stored = {n: _stored_key(V.prop(v, n)) for n in items}
        for n, c in stored.items():
            test = test & (c == F.col(f"mk_{n}"))
        matched = df.join(shown, test, "left").select("merge_row", *group, "x__id")
        matched = cut(matched, "merge")
        # Rows without a match: the first of each key creates; the others then match what it made.
        missing = matched.where("x__id is null").select("merge_row", *group)
        numbered = missing.withColumn("mk_n", F.row_number().over(W.partitionBy(*group or [F.lit(1)]).orderBy("merge_row")))
        first = cut(numbered.where("mk_n = 1").withColumn("new_id", F.lit(self.next_id(there)) + F.monotonically_increasing_id()), "merge")
        source = first.join(state.df, "merge_row")
        fixed = {"id": F.col("new_id")}
        if is_edge:
            fixed |= {"src": F.col("mk_src"), "dst": F.col("mk_dst"), "type": F.lit(wanted.types[0])}
        else:
            fixed |= {"labels": F.array(*[F.lit(x) for x in sorted(set(wanted.labels))]).cast("array<string>")}
        added = cut(self.element(schema, source, fixed, items), "merged")
        self.affected += added.count()
        nodes, edges = self.graph.nodes, self.graph.edges
        self.graph = self.graph.replaced(nodes if is_edge else nodes.unionByName(added), edges.unionByName(added) if is_edge else edges)
        test = F.lit(True)
        for c in group:
            test = test & F.col(c).eqNullSafe(F.col(f"f_{c}"))
        created = first.select(F.col("new_id"), F.col("merge_row").alias("first_row"), *[F.col(c).alias(f"f_{c}") for c in group])
        resolved = numbered.join(created, test).select("merge_row", F.col("new_id").alias("target"), (F.col("merge_row") == F.col("first_row")).alias("created"))
        resolved = resolved.union(matched.where("x__id is not null").select("merge_row", "x__id", F.lit(False)))
        rows = state.df.join(resolved, "merge_row")
        prefix = compiler.fresh(wanted.var or "m")
        compiler.graph = self.graph

        def bound(rows: DataFrame) -> State:
            place = self.graph.edges if is_edge else self.graph.nodes
            shown = place.select(*[F.col(f).alias(f"{prefix}__{f}") for f in schema.fields])
            scope = dict(state.scope)
            if wanted.var:
                scope[wanted.var] = compiler.flat(prefix, schema, wanted.var)
            return State(rows.join(shown, F.col("target") == F.col(f"{prefix}__id")), scope)

        rows = cut(rows, "merge")
        for flag, sets in ((True, clause.on_create), (False, clause.on_match)):
            if not sets:
                continue
            picked = rows.where(F.col("created") == flag)
            # Rows that match one element change it one after another; if no value depends on the element, the last one decides.
            alone = not any(_mentions(item[3:], wanted.var) for item in sets)
            order = F.col("merge_row").desc() if alone else F.col("merge_row")
            turns = picked.withColumn("turn", F.row_number().over(W.partitionBy("target").orderBy(order)))
            turns = cut(turns.where("turn = 1") if alone else turns, "turns")
            for turn in range(1, (turns.agg(F.max("turn")).first()[0] or 0) + 1):
                one = bound(turns.where(F.col("turn") == turn).drop("turn"))
                self.change(list(sets), compiler, self.settled(one, compiler))
                compiler.graph = self.graph
        out = bound(rows)
        return State(out.df.drop("merge_row", "target", "created"), out.scope)

    # SET and REMOVE

    def change(self, items: list, compiler: Compiler, state: State) -> None:
        """Items in order; of several rows that set one property the last wins, by the greatest value among equals."""
        for kind, var, what, *rest in items:
            v = state.scope.get(var)
            if v is None:
                raise GraphError(f"{var} isn't bound")
            if v.kind not in ("node", "edge"):
                raise GraphError(f"{var} has no properties")
            schema = v.schema
            target = self.graph.nodes if v.kind == "node" else self.graph.edges
            if kind == "prop":
                new = compiler.value(rest[0], self.current(state, var, v, compiler))
                if schema.props is not None and what not in schema.props:
                    raise GraphError(f"this graph has no property {what}")
                shown = F.to_json(V.to_variant(new)) if schema.props is None else V.plain(new).cast(target.schema[f"p_{what}"].dataType)
                rows = self.fresh_rows(state, var, v, compiler).where(v.get("id").isNotNull())
                changes = rows.groupBy(v.get("id").alias("c_id")).agg(F.max(F.struct(shown.alias("x"))).alias("c"))
                joined = target.join(changes, F.col("id") == F.col("c_id"), "left")
                if schema.props is None:
                    members = F.coalesce(F.try_variant_get("props", "$", "map<string,variant>"), F.try_variant_get(F.parse_json(F.lit("{}")), "$", "map<string,variant>"))
                    without = F.map_filter(members, lambda k, _: k != what)
                    value = F.parse_json(F.col("c.x"))
                    full = F.when(F.col("c.x").isNull() | (F.col("c.x") == "null"), without).otherwise(F.map_concat(without, F.create_map(F.lit(what), value)))
                    joined = joined.withColumn("props", F.when(F.col("c_id").isNotNull(), F.to_variant_object(full)).otherwise(F.col("props")))
                else:
                    joined = joined.withColumn(f"p_{what}", F.when(F.col("c_id").isNotNull(), F.col("c.x")).otherwise(F.col(f"p_{what}")))
            else:
                if v.kind != "node":
                    raise GraphError("only nodes have labels")
                changes = state.df.where(v.get("id").isNotNull()).select(v.get("id").alias("c_id")).distinct()
                joined = target.join(changes, F.col("id") == F.col("c_id"), "left")
                names = F.array(*[F.lit(x) for x in what])
                full = F.array_sort(F.array_union("labels", names) if kind == "label" else F.array_except("labels", names))
                joined = joined.withColumn("labels", F.when(F.col("c_id").isNotNull(), full).otherwise(F.col("labels")))
            self.affected += changes.count()
            written = cut(joined.select(*target.columns), "set")
            self.graph = self.graph.replaced(written, self.graph.edges) if v.kind == "node" else self.graph.replaced(self.graph.nodes, written)

    def current(self, state: State, var: str, v, compiler: Compiler) -> dict:
        """The scope with var's element as earlier items left it."""
        name = f"now_{var}"
        return state.scope | {var: compiler.flat(name, v.schema, var)}

    def fresh_rows(self, state: State, var: str, v, compiler: Compiler) -> DataFrame:
        target = self.graph.nodes if v.kind == "node" else self.graph.edges
        name = f"now_{var}"
        shown = target.select(*[F.col(f).alias(f"{name}__{f}") for f in v.schema.fields])
        return state.df.join(shown, v.get("id") == F.col(f"{name}__id"))

    # DELETE

    def delete(self, clause: L.Delete, compiler: Compiler, state: State) -> None:
        nodes, edges = [], []
        for e in clause.values:
            v = compiler.value(e, state.scope)
            if v.kind not in ("node", "edge"):
                raise GraphError("DELETE takes nodes and relationships")
            (nodes if v.kind == "node" else edges).append(state.df.where(v.get("id").isNotNull()).select(v.get("id").alias("id")).distinct())
        kept_nodes, kept_edges = self.graph.nodes, self.graph.edges
        for gone in edges:
            kept_edges = kept_edges.join(gone, "id", "left_anti")
            self.affected += gone.count()
        for gone in nodes:
            ends = gone.withColumnRenamed("id", "gone")
            if clause.detach:
                kept_edges = kept_edges.join(ends, F.col("src") == F.col("gone"), "left_anti").join(ends, F.col("dst") == F.col("gone"), "left_anti")
            elif any(not kept_edges.join(ends, F.col(end) == F.col("gone"), "left_semi").isEmpty() for end in ("src", "dst")):
                raise GraphError("a node with relationships needs DETACH DELETE")
            kept_nodes = kept_nodes.join(gone, "id", "left_anti")
            self.affected += gone.count()
        if clause.detach:
            self.affected += self.graph.edges.count() - kept_edges.count()
        self.graph = self.graph.replaced(cut(kept_nodes.select(*self.graph.nodes.columns), "nodes"), cut(kept_edges.select(*self.graph.edges.columns), "edges"))


def _mentions(node, var: str | None) -> bool:
    """Whether an expression names a variable."""
    if isinstance(node, (list, tuple)):
        return any(_mentions(x, var) for x in node)
    if dataclasses.is_dataclass(node):
        return any(_mentions(getattr(node, f.name), var) for f in dataclasses.fields(node))
    return var is not None and node == var


def _storable(v: V.Value):
    """A key column that equal property values share."""
    if v.kind == "num":
        return V.to_text(v)
    return F.to_json(V.to_variant(v)) if v.kind in ("any", "list", "map") else v.col.cast("string")


def _stored_key(v: V.Value):
    if v.kind == "any":
        return F.coalesce(V.as_text(v), V.to_text(V.num(V.as_num(v))), F.to_json(v.col))
    return V.to_text(v) if v.kind == "num" else v.key.cast("string")
