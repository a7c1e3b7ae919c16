"""Values of the graph language as Spark columns.

A value has a kind: null, bool, num, str, list, map, node, edge, path, or `any` for a VARIANT out of schemaless
properties.  Typed graphs never meet `any`; where it is met, an operation first extracts what it needs and keeps the
language's rules (unknown propagates, values of different kinds are unequal, ordering them is an error).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.operators.graph import language as L
from lodestone.operators.graph.language import GraphError

EXACT = "decimal(38,10)"


@dataclass
class Value:
    kind: str
    col: Column | None = None
    item: Value | None = None  # the kind of a list's elements; col unused
    fields: dict[str, Value] = field(default_factory=dict)  # of maps
    get: Any = None  # of nodes and edges: field name -> Column
    schema: Any = None  # of nodes and edges: ElementSchema
    var: str | None = None

    @property
    def key(self) -> Column:
        """What equality, grouping and joins use."""
        if self.kind in ("node", "edge"):
            return self.get("id")
        return F.to_json(self.col) if self.kind == "any" else self.col


@dataclass(frozen=True)
class ElementSchema:
    """Fields of nodes or edges. props: name -> kind (num, str, bool or a Value for lists); None means a VARIANT column `props`."""

    kind: str
    props: dict | None

    @property
    def fields(self) -> list[str]:
        fixed = ["id", "labels"] if self.kind == "node" else ["id", "src", "dst", "type"]
        return fixed + (["props"] if self.props is None else [f"p_{n}" for n in self.props])

    def value(self, get, var: str | None = None) -> Value:
        return Value(self.kind, get=get, schema=self, var=var)

    def struct(self, get) -> Column:
        return F.struct(*[get(f).alias(f) for f in self.fields])


def num(c: Column) -> Value:
    return Value("num", c)


def text(c: Column) -> Value:
    return Value("str", c)


def truth(c: Column) -> Value:
    return Value("bool", c)


def list_of(c: Column, item: Value) -> Value:
    return Value("list", c, item=item)


def null() -> Value:
    return Value("null", F.lit(None))


def variant(c: Column) -> Value:
    return Value("any", c)


def constant(x: Any) -> Value:
    """A literal, or a parameter's value out of JSON."""
    if x is None:
        return null()
    if isinstance(x, bool):
        return truth(F.lit(x))
    if isinstance(x, tuple) and x[0] == "number":
        return number(x[1])
    if isinstance(x, (int, Decimal)):
        return number(str(x))
    if isinstance(x, float):
        return number(repr(x))
    if isinstance(x, str):
        return text(F.lit(x))
    if isinstance(x, (list, tuple)):
        return make_list([constant(y) for y in x])
    if isinstance(x, dict):
        return make_map({k: constant(v) for k, v in x.items()})
    raise GraphError(f"a parameter can't be a {type(x).__name__}")


def number(shown: str) -> Value:
    exact = Decimal(shown)
    if exact == exact.to_integral_value() and abs(exact) < 2**63 and "." not in shown:
        return num(F.lit(int(exact)).cast("bigint"))
    plain = format(exact, "f")
    digits, _, scale = plain.lstrip("-").partition(".")
    if len(digits) + len(scale) > 38:
        raise GraphError(f"{shown} has too many digits")
    return num(F.lit(plain).cast(f"decimal({max(len(digits.lstrip('0')) + len(scale), 1)},{len(scale)})"))


def make_list(items: list[Value]) -> Value:
    kinds = {v.kind for v in items} - {"null"}
    if not items:
        return list_of(F.array().cast("array<string>"), null())
    if kinds <= {"node"} or kinds <= {"edge"}:
        if kinds:
            first = next(v for v in items if v.kind != "null")
            return list_of(F.array(*[first.schema.struct(v.get) if v.kind != "null" else F.lit(None) for v in items]), Value(first.kind, schema=first.schema))
    if len(kinds) > 1:
        return list_of(F.array(*[to_variant(v) for v in items]), Value("any"))
    if not kinds:
        return list_of(F.array(*[F.lit(None).cast("string") for _ in items]), null())
    first = next(v for v in items if v.kind != "null")
    return list_of(F.array(*[v.col for v in items]), Value(first.kind, item=first.item, fields=first.fields, schema=first.schema))


def make_map(items: dict[str, Value]) -> Value:
    return Value("map", F.struct(*[plain(v).alias(k) for k, v in items.items()]) if items else F.lit("{}"), fields=items)


def plain(v: Value) -> Column:
    """A column that holds the value whole."""
    return v.schema.struct(v.get) if v.kind in ("node", "edge") and v.col is None else v.col


def to_variant(v: Value) -> Column:
    if v.kind == "any":
        return v.col
    if v.kind == "null":
        return F.parse_json(F.lit(None).cast("string"))
    if v.kind in ("node", "edge"):
        return F.parse_json(F.to_json(v.schema.struct(v.get)))
    if v.kind == "str":
        return F.parse_json(F.to_json(F.array(v.col)).substr(F.lit(2), F.length(F.to_json(F.array(v.col))) - 2))
    if v.kind == "num":
        return F.parse_json(_plain_number(v.col))
    if v.kind == "bool":
        return F.parse_json(v.col.cast("string"))
    return F.parse_json(F.to_json(v.col))


def _plain_number(c: Column) -> Column:
    shown = c.cast("string")
    return F.when(F.instr(shown, ".") > 0, F.regexp_replace(F.regexp_replace(shown, "0+$", ""), "[.]$", "")).otherwise(shown)


def _form(c: Column) -> Column:
    return F.schema_of_variant(c)


def as_num(v: Value) -> Column:
    """The number, or null if the value is something else."""
    if v.kind == "any":
        return F.when(_form(v.col).rlike("^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$"), F.try_variant_get(v.col, "$", EXACT))
    return v.col if v.kind == "num" else F.lit(None).cast(EXACT)


def as_text(v: Value) -> Column:
    if v.kind == "any":
        return F.when(_form(v.col) == "STRING", F.try_variant_get(v.col, "$", "string"))
    return v.col if v.kind == "str" else F.lit(None).cast("string")


def as_bool(v: Value) -> Column:
    if v.kind == "any":
        return F.when(_form(v.col) == "BOOLEAN", F.try_variant_get(v.col, "$", "boolean"))
    if v.kind in ("bool", "null"):
        return v.col.cast("boolean")
    raise GraphError(f"a boolean is needed, not {v.kind}")


def as_list(v: Value) -> Value:
    if v.kind == "any":
        return list_of(F.when(_form(v.col).startswith("ARRAY"), F.try_variant_get(v.col, "$", "array<variant>")).when(v.col.isNotNull(), F.raise_error(F.lit("a list is needed"))), Value("any"))
    if v.kind == "null":
        return list_of(F.lit(None).cast("array<string>"), null())
    if v.kind != "list":
        raise GraphError(f"a list is needed, not {v.kind}")
    return v


def element(of: Value, col: Column) -> Value:
    """An element of list `of` in a lambda or after an index."""
    i = of.item
    if i.kind in ("node", "edge"):
        return Value(i.kind, col, get=lambda f: col.getField(f), schema=i.schema)
    return Value(i.kind, col, item=i.item, fields={k: _field(x, col, k) for k, x in i.fields.items()}, schema=i.schema)


def _field(shape: Value, col: Column, name: str) -> Value:
    inner = col.getField(name)
    if shape.kind in ("node", "edge"):
        return Value(shape.kind, inner, get=lambda f: inner.getField(f), schema=shape.schema)
    return Value(shape.kind, inner, item=shape.item, fields={k: _field(x, inner, k) for k, x in shape.fields.items()}, schema=shape.schema)


def equal(a: Value, b: Value) -> Column:
    """Deep equality: unknown if a side is null, false between kinds."""
    if "null" in (a.kind, b.kind):
        return F.lit(None).cast("boolean")
    if "any" in (a.kind, b.kind):
        if a.kind == b.kind:
            x, y = as_num(a), as_num(b)
            return F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(F.to_json(a.col) == F.to_json(b.col))
        a, b = (a, b) if a.kind == "any" else (b, a)
        if b.kind in ("num", "str", "bool"):
            mine = {"num": as_num, "str": as_text, "bool": as_bool}[b.kind](a)
            return F.when(a.col.isNull() | b.col.isNull(), F.lit(None)).otherwise(F.coalesce(mine == b.col, F.lit(False)))
        return F.to_json(a.col) == F.to_json(to_variant(b))
    if a.kind != b.kind:
        return F.when(a.key.isNull() | b.key.isNull(), F.lit(None)).otherwise(F.lit(False))
    if a.kind == "list":
        if a.item.kind != b.item.kind:
            return F.when(a.col.isNull() | b.col.isNull(), F.lit(None)).otherwise((F.size(a.col) == 0) & (F.size(b.col) == 0))
        if a.item.kind in ("node", "edge"):
            return F.transform(a.col, lambda x: x.getField("id")) == F.transform(b.col, lambda x: x.getField("id"))
        unknown = F.exists(a.col, lambda x: x.isNull()) | F.exists(b.col, lambda x: x.isNull())
        return F.when(F.size(a.col) != F.size(b.col), F.lit(False)).when(unknown, F.lit(None)).otherwise(a.col == b.col)
    if a.kind == "map" and set(a.fields) != set(b.fields):
        return F.lit(False)
    return a.key == b.key


def compare(op: str, a: Value, b: Value) -> Column:
    """< <= > >=: same kind or an error."""
    if "null" in (a.kind, b.kind):
        return F.lit(None).cast("boolean")
    if "any" in (a.kind, b.kind):
        if a.kind == b.kind:
            raise GraphError("ordering two untyped values: convert one of them")
        known = b if a.kind == "any" else a
        if known.kind not in ("num", "str"):
            raise GraphError(f"{known.kind} values have no order")
        take = as_num if known.kind == "num" else as_text
        x, y = take(a), take(b)
        odd = (a.col.isNotNull() & x.isNull()) | (b.col.isNotNull() & y.isNull())
        return F.when(odd, F.raise_error(F.lit("values of different kinds have no order")).cast("boolean")).otherwise(_ordered(op, x, y))
    if a.kind != b.kind or a.kind not in ("num", "str", "bool"):
        raise GraphError(f"{a.kind} and {b.kind} have no order")
    return _ordered(op, a.col, b.col)


def _ordered(op: str, x: Column, y: Column) -> Column:
    return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def arithmetic(op: str, a: Value, b: Value) -> Value:
    if op == "+" and (a.kind == "list" or b.kind == "list"):
        if a.kind == b.kind:
            if "null" in (a.item.kind, b.item.kind) and a.item.kind != b.item.kind:
                known, other = (a, b) if a.item.kind != "null" else (b, a)
                filled = F.transform(other.col, lambda _: F.lit(None))
                parts = (known.col, filled) if known is a else (filled, known.col)
                return list_of(F.concat(*parts), known.item)
            if a.item.kind != b.item.kind:
                raise GraphError("lists of different kinds don't add")
            return list_of(F.concat(a.col, b.col), a.item)
        whole, single = (a, b) if a.kind == "list" else (b, a)
        one = F.array(plain(single))
        return list_of(F.concat(a.col, one) if whole is a else F.concat(one, b.col), whole.item if whole.item.kind != "null" else Value(single.kind, schema=single.schema))
    if op == "+" and ("str" in (a.kind, b.kind)) and {a.kind, b.kind} <= {"str", "any", "null"}:
        return text(F.concat(as_text(a), as_text(b)))
    for v in (a, b):
        if v.kind not in ("num", "any", "null"):
            raise GraphError(f"{op} needs numbers, not {v.kind}")
    x, y = as_num(a), as_num(b)
    for v, taken in ((a, x), (b, y)):
        if v.kind == "any":
            checked = F.when(v.col.isNotNull() & taken.isNull(), F.raise_error(F.lit(f"{op} needs numbers")).cast(EXACT)).otherwise(taken)
            x, y = (checked, y) if v is a else (x, checked)
    if op == "/":
        return num(x.cast("decimal(28,10)") / y.cast("decimal(28,10)"))
    return num({"+": x + y, "-": x - y, "*": x * y}[op])


def within(v: Value, items: Value) -> Column:
    """IN: true beats unknown beats false."""
    items = as_list(items)
    if items.item.kind == "null":
        return F.when(F.size(items.col) == 0, F.lit(False)).otherwise(F.lit(None))
    return F.exists(items.col, lambda x: equal(v, element(items, x)))


def to_text(v: Value) -> Column:
    if v.kind == "num":
        return _plain_number(v.col)
    if v.kind in ("str", "bool"):
        return v.col.cast("string")
    if v.kind == "any":
        return F.coalesce(as_text(v), F.when(_form(v.col) != "VOID", F.to_json(v.col)))
    if v.kind == "null":
        return F.lit(None).cast("string")
    raise GraphError(f"toString doesn't take {v.kind}")


def prop(base: Value, name: str) -> Value:
    if base.kind == "null":
        return null()
    if base.kind == "any":
        return variant(F.try_variant_get(base.col, _json_path(name), "variant"))
    if base.kind == "map":
        return _field(base.fields[name], base.col, name) if name in base.fields else null()
    if base.kind not in ("node", "edge"):
        raise GraphError(f"{base.kind} has no properties")
    props = base.schema.props
    if props is None:
        return variant(F.try_variant_get(base.get("props"), _json_path(name), "variant"))
    if name not in props:
        return null()
    kind = props[name]
    column = base.get(f"p_{name}")
    return list_of(column, Value(kind[1])) if isinstance(kind, tuple) else Value(kind, column)


def _json_path(name: str) -> str:
    return "$['" + name.replace("'", "\\'") + "']"


def properties(v: Value) -> Value:
    if v.schema.props is None:
        return variant(v.get("props"))
    return make_map({n: prop(v, n) for n in v.schema.props})


def keys(v: Value) -> Column:
    if v.kind == "map":
        return F.array(*[F.lit(k) for k in sorted(v.fields)])
    if v.kind == "any":
        return F.array_sort(F.map_keys(F.try_variant_get(v.col, "$", "map<string,variant>")))
    if v.schema.props is None:
        return F.array_sort(F.map_keys(F.try_variant_get(v.get("props"), "$", "map<string,variant>")))
    return F.array_compact(F.array(*[F.when(plain(prop(v, n)).isNotNull(), F.lit(n)) for n in sorted(v.schema.props)]))


def hits(e, test) -> bool:
    return test(e) or any(hits(c, test) for c in L.children(e))
