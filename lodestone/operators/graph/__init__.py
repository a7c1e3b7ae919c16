"""Property graphs as two DataFrames, and the graph language over them."""

from __future__ import annotations

import json
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.graph import language as L
from lodestone.operators.graph import values as V
from lodestone.operators.graph.compiler import Compiler, State
from lodestone.operators.graph.language import GraphError
from lodestone.operators.graph.values import ElementSchema, Value
from lodestone.operators.graph.writes import Writer, is_write
from lodestone.sources.scratch import cut

#: Limits that a request may tighten; going beyond one is an error, never a shorter answer.
LIMITS = {"max_rows": 10_000, "max_depth": 16, "max_millis": 60_000, "max_expansions": 100_000, "max_nodes": 100_000, "max_edges": 500_000, "max_text_bytes": 100 << 20}


#: The columns of a profile.
PROFILED = (
    "access string, index_name string, seeks bigint, entries_read bigint, candidates bigint, rows_returned bigint, graph_nodes_loaded bigint, graph_edges_loaded bigint, fulltext_source_checks bigint, "
    "fulltext_documents_loaded bigint, fulltext_statistics_records_loaded bigint, edge_expansions bigint, work_units bigint, elapsed_ms bigint"
)


def _operators(plan):
    """(name, output rows, is a scan) of every operator of an executed plan."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from _operators(plan.executedPlan())
        return
    if name.endswith("QueryStageExec"):
        yield from _operators(plan.plan())
        return
    metrics, children = plan.metrics(), plan.children()
    made = metrics.apply("numOutputRows").value() if metrics.contains("numOutputRows") else 0
    yield name, max(0, made), children.size() == 0
    for k in range(children.size()):
        yield from _operators(children.apply(k))


def _kind(of: T.DataType):
    if isinstance(of, T.ArrayType):
        return "list", _kind(of.elementType)
    if isinstance(of, T.BooleanType):
        return "bool"
    return "num" if isinstance(of, T.NumericType) else "str"


class Graph:
    """nodes(id, labels, props... ) and edges(id, src, dst, type, props...).

    Properties are typed columns p_<name>, or one VARIANT column props for graphs without a schema.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, number: int = 1, workspace: int = 1):
        self.spark = nodes.sparkSession
        self.nodes, self.edges, self.number, self.workspace = nodes, edges, number, workspace
        self.node_schema, self.edge_schema = self._schema("node", nodes), self._schema("edge", edges)
        self.fulltext: dict = {}
        self.property_indexes: dict[str, dict] = {}

    @staticmethod
    def _schema(kind: str, df: DataFrame) -> ElementSchema:
        if "props" in df.columns:
            return ElementSchema(kind, None)
        return ElementSchema(kind, {f.name[2:]: _kind(f.dataType) for f in df.schema.fields if f.name.startswith("p_")})

    @classmethod
    def from_json(cls, spark: SparkSession, nodes: list[tuple], edges: list[tuple], **options) -> Graph:
        """From small lists: (id, labels, properties) and (id, source, target, type, properties)."""
        n = spark.createDataFrame([(i, list(labels), json.dumps(p)) for i, labels, p in nodes], "id bigint, labels array<string>, j string")
        e = spark.createDataFrame([(i, a, b, t, json.dumps(p)) for i, a, b, t, p in edges], "id bigint, src bigint, dst bigint, type string, j string")
        return cls(n.select("id", "labels", F.parse_json("j").alias("props")), e.select("id", "src", "dst", "type", F.parse_json("j").alias("props")), **options)

    @classmethod
    def empty(cls, spark: SparkSession) -> Graph:
        return cls.from_json(spark, [], [])

    def replaced(self, nodes: DataFrame, edges: DataFrame) -> Graph:
        out = Graph(nodes, edges, self.number, self.workspace)
        out.fulltext, out.property_indexes = dict(self.fulltext), dict(self.property_indexes)
        return out

    # Reading

    @staticmethod
    def is_write(text: str) -> bool:
        return is_write(L.parse(text))

    def compile(self, text: str, parameters: dict | None = None, session=None) -> State:
        query = L.parse(text)
        if is_write(query):
            raise GraphError("this query writes")
        return Compiler(self, parameters, session).run(query)

    def query(self, text: str, parameters: dict | None = None, budgets: dict | None = None, session=None, elements: bool = False) -> DataFrame:
        """Rows of a reading query, lazily. elements: nodes and edges as handles (graph, kind, id) rather than whole."""
        budget = self._budget(budgets)
        _check_depth(L.parse(text), budget["max_depth"])
        if not set(budgets or {}) - {"max_depth"}:
            return self._rows(self.compile(text, parameters, session), elements)
        return _timed(self.spark, budget["max_millis"], lambda: self._bounded(text, parameters, budgets, session, elements))

    def _rows(self, state: State, elements: bool) -> DataFrame:
        return state.df.select(*[self._shown(v, elements).alias(n) for n, v in state.scope.items()])

    def _bounded(self, text: str, parameters: dict | None, budgets: dict, session, elements: bool) -> DataFrame:
        """The rows, computed, if every budget that is asked for holds: of the graph's size, the rows of all MATCHes
        together, the result's rows and the bytes of its texts."""
        for name, df in (("max_nodes", self.nodes), ("max_edges", self.edges)):
            if name in budgets:
                self._within(df, budgets[name], name[4:])
        query = L.parse(text)
        if is_write(query):
            raise GraphError("this query writes")
        compiler = Compiler(self, parameters, session)
        compiler.expanded = [] if "max_expansions" in budgets else None
        state = compiler.run(query)
        left = budgets.get("max_expansions", 0)
        for df in compiler.expanded or []:
            left -= df.limit(left + 1).count()
            if left < 0:
                raise GraphError(f"the budget of {budgets['max_expansions']} expansions is exceeded")
        rows = self._rows(state, elements)
        if "max_rows" in budgets:
            rows = self._within(rows, budgets["max_rows"], "rows")
        rows = cut(rows, "bounded")
        texts = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in rows.schema.fields if isinstance(f.dataType, T.StringType)]
        if "max_text_bytes" in budgets and texts:
            size = rows.agg(F.sum(sum(texts[1:], texts[0]))).first()[0] or 0
            if size > budgets["max_text_bytes"]:
                raise GraphError(f"the budget of {budgets['max_text_bytes']} text bytes is exceeded")
        return rows

    def _shown(self, v: Value, elements: bool):
        if v.kind in ("node", "edge"):
            if elements:
                return F.when(v.get("id").isNotNull(), F.struct(F.lit(self.number).alias("graph"), F.lit(v.kind).alias("kind"), v.get("id").alias("id")))
            return F.when(v.get("id").isNotNull(), v.schema.struct(v.get) if v.col is None else v.col)
        return V.to_text(v) if v.kind == "any" else v.col

    @staticmethod
    def _budget(request: dict | None) -> dict:
        request = request or {}
        if unknown := set(request) - set(LIMITS):
            raise GraphError(f"there is no budget {sorted(unknown)[0]}")
        for name, value in request.items():
            if not isinstance(value, int) or not 0 < value <= LIMITS[name]:
                raise GraphError(f"{name} may only tighten {LIMITS[name]}")
        return LIMITS | request

    @staticmethod
    def _within(rows: DataFrame, most: int, of: str) -> DataFrame:
        """An error if there are more rows; one more than the limit is enough to tell."""
        if rows.limit(most + 1).count() > most:
            raise GraphError(f"the budget of {most} {of} is exceeded")
        return rows

    def profile(self, rows: DataFrame) -> DataFrame:
        """One row: how the query runs, what its operators put out, and how long it took.

        entries_read counts the rows that scans give, work_units those of all operators; Spark keeps no counters of
        seeks or of loaded documents, so these are null.
        """
        begun, run = time.time(), rows._jdf.queryExecution()
        count = run.toRdd().count()
        took, read, work, joined = int(1000 * (time.time() - begun)), 0, 0, 0
        for name, made, leaf in _operators(run.executedPlan()):
            read, work, joined = read + made * leaf, work + made, joined + made * ("Join" in name)
        row = ("scan", None, None, read, joined, count, None, None, None, None, None, joined, work, took)
        return self.spark.createDataFrame([row], PROFILED)

    # Writing

    def write(self, text: str, parameters: dict | None = None, budgets: dict | None = None) -> tuple[Graph, int]:
        """The graph after a writing query, and the number of affected elements; this graph stays as it is."""
        budget = self._budget(budgets)
        for name, df in (("max_nodes", self.nodes), ("max_edges", self.edges)):
            if budgets and name in budgets:
                self._within(df, budget[name], name[4:])
        write = lambda: Writer(self, parameters or {}).run(L.parse(text))
        return _timed(self.spark, budget["max_millis"], write) if budgets and "max_millis" in budgets else write()

    # Indexes and procedures

    def add_property_index(self, name: str, label: str | None, paths: list[str], unique: bool = False) -> None:
        """A declaration: filters reach the Parquet scan by themselves; unique keys are verified, nulls are distinct."""
        if not 0 <= len(paths) <= 8:
            raise GraphError("an index has at most 8 paths")
        index = {"label": label, "paths": list(paths), "unique": unique}
        self.check_unique(name, index)
        self.property_indexes[name] = index

    def check_unique(self, name: str, index: dict) -> None:
        if not index["unique"]:
            return
        v = self.node_schema.value(lambda f: F.col(f))
        nodes = self.nodes.where(F.array_contains("labels", index["label"])) if index["label"] else self.nodes
        keys = []
        for k, path in enumerate(index["paths"]):
            x = v
            for part in path.split("."):
                x = V.prop(x, part)
            keys.append(x.key.alias(f"k{k}"))
        keyed = nodes.select(*keys)
        for k in range(len(keys)):
            keyed = keyed.where(F.col(f"k{k}").isNotNull())
        if not keyed.groupBy(*keyed.columns).count().where("count > 1").isEmpty():
            raise GraphError(f"unique index {name} is violated")

    def procedure(self, compiler: Compiler, clause: L.Procedure, state: State) -> tuple[DataFrame, dict]:
        """CALL ... YIELD: full-text and scan searches, joined to the bindings."""
        from lodestone.operators.text import procedures

        return procedures.call(self, compiler, clause, state)

    # Snapshots

    def save(self, folder: str, definition_only: bool = False) -> None:
        nodes, edges = (self.nodes.limit(0), self.edges.limit(0)) if definition_only else (self.nodes, self.edges)
        nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
        edges.write.mode("overwrite").parquet(f"{folder}/edges")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Graph:
        return cls(spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges"))


def _timed(spark: SparkSession, millis: int, work):
    """work(), whose Spark jobs are ended once the time is up."""
    tag, fired = f"budget-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        fired.set()
        spark.interruptTag(tag)

    begun, timer = time.monotonic(), threading.Timer(millis / 1000, stop)
    timer.daemon = True
    spark.addTag(tag)
    timer.start()
    try:
        out = work()
    except GraphError:
        raise
    except Exception as e:
        if fired.is_set():
            raise GraphError(f"the budget of {millis} ms is exceeded") from e
        raise
    finally:
        timer.cancel()
        spark.removeTag(tag)
    if time.monotonic() - begun > millis / 1000:
        raise GraphError(f"the budget of {millis} ms is exceeded")
    return out


def _check_depth(query: L.GraphQuery, most: int) -> None:
    for clause in query.clauses:
        if isinstance(clause, L.Match):
            for e in (e for p in clause.patterns for e in p.edges):
                if e.high is not None and e.high > most:
                    raise GraphError(f"the budget of depth {most} is exceeded")
        if isinstance(clause, L.SubQuery):
            _check_depth(clause.query, most)
    if query.union is not None:
        _check_depth(query.union, most)
