"""Expressions: small immutable trees over bindings, built into Spark columns when a query is lowered."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import CastError, CompileError, QueryError
from tessera.functions import types

_COMPARISONS = ("==", "!=", "<", "<=", ">", ">=")


def _no_null(value, op: str):
    if value is None or (isinstance(value, (Lit, Param)) and value.value is None):
        raise CompileError(f"null in {op!r} is never true; use is_nil()")
    return value


class Expr:
    """Operators build trees; ``build`` gives the column."""

    __hash__ = object.__hash__

    def build(self, ctx) -> Column:
        raise NotImplementedError

    def children(self) -> Iterable[Expr]:
        return ()

    def type(self, ctx) -> Any:
        return "any"

    def has_aggregate(self) -> bool:
        return any(c.has_aggregate() for c in self.children())

    def __eq__(self, other):
        return Compare("==", self, wrap(_no_null(other, "==")))

    def __ne__(self, other):
        return Compare("!=", self, wrap(_no_null(other, "!=")))

    def __lt__(self, other):
        return Compare("<", self, wrap(_no_null(other, "<")))

    def __le__(self, other):
        return Compare("<=", self, wrap(_no_null(other, "<=")))

    def __gt__(self, other):
        return Compare(">", self, wrap(_no_null(other, ">")))

    def __ge__(self, other):
        return Compare(">=", self, wrap(_no_null(other, ">=")))

    def __add__(self, other):
        return Arithmetic("+", self, wrap(other))

    def __radd__(self, other):
        return Arithmetic("+", wrap(other), self)

    def __sub__(self, other):
        return Arithmetic("-", self, wrap(other))

    def __rsub__(self, other):
        return Arithmetic("-", wrap(other), self)

    def __mul__(self, other):
        return Arithmetic("*", self, wrap(other))

    def __rmul__(self, other):
        return Arithmetic("*", wrap(other), self)

    def __truediv__(self, other):
        return Arithmetic("/", self, wrap(other))

    def __rtruediv__(self, other):
        return Arithmetic("/", wrap(other), self)

    def __neg__(self):
        return Function("negate", lambda c: -c, (self,))

    def __and__(self, other):
        return Logic("and", self, wrap(other))

    def __or__(self, other):
        return Logic("or", self, wrap(other))

    def __rand__(self, other):
        return Logic("and", wrap(other), self)

    def __ror__(self, other):
        return Logic("or", wrap(other), self)

    def __invert__(self):
        return Function("not", lambda c: ~c, (self,), "boolean")

    def __bool__(self):
        raise CompileError("an expression has no truth value; use &, | and ~")

    def __getitem__(self, key):
        return JsonPath(self, (key,))

    def in_(self, values):
        return Member(self, values)

    def like(self, pattern):
        return Function("like", lambda c, p: F.like(c, p), (self, wrap(pattern)), "boolean")

    def ilike(self, pattern):
        return Function("ilike", lambda c, p: F.ilike(c, p), (self, wrap(pattern)), "boolean")

    def is_nil(self):
        return Function("is_nil", lambda c: c.isNull(), (self,), "boolean")

    def as_(self, name: str):
        return SelectedAs(self, name)

    def over(self, window=None, **spec):
        return Over(self, window if window is not None else spec)

    def filter(self, condition):
        """FILTER (WHERE condition) of an aggregate."""
        raise CompileError("only an aggregate has a filter")


@dataclass(eq=False, frozen=True)
class Lit(Expr):
    value: Any

    def build(self, ctx):
        v = self.value
        if isinstance(v, (list, tuple)):
            return F.array(*[wrap(x).build(ctx) for x in v])
        if isinstance(v, dict):
            return F.create_map(*[x for k, e in v.items() for x in (F.lit(k), wrap(e).build(ctx))])
        if isinstance(v, dt.datetime) and v.tzinfo is None:
            return F.lit(v.isoformat(sep=" ")).cast("timestamp_ntz")
        return F.lit(v)

    def type(self, ctx):
        return types.infer(self.value)


@dataclass(eq=False, frozen=True)
class Param(Expr):
    """A value from outside, cast to a type or to that of the other operand."""

    value: Any
    as_type: Any = None

    def build(self, ctx):
        value = types.dump(self.as_type, types.cast(self.as_type, self.value)) if self.as_type else self.value
        return Lit(value).build(ctx)

    def type(self, ctx):
        return self.as_type or "any"


def wrap(value) -> Expr:
    from tessera.plans.query import Query

    if isinstance(value, Expr):
        return value
    if isinstance(value, Query):
        return Sub(value)
    return Lit(value)


def _fit(ctx, value: Expr, other: Expr) -> Column:
    """A value's column, as the type of what it is compared with."""
    if isinstance(value, (Lit, Param)) and isinstance(other, (Ref, ParentRef)):
        kind = other.type(ctx)
        if kind != "any" and not (isinstance(value, Param) and value.as_type):
            try:
                stored = Lit(types.dump(kind, types.cast(kind, value.value))).build(ctx)
                # columns of such types hold inside values
                return types.load(kind, stored) if isinstance(kind, types.CustomType) else stored
            except CastError as e:
                raise QueryError(f"value {value.value!r} in comparison with {other.label()}: {e}") from e
    return value.build(ctx)


@dataclass(eq=False, frozen=True)
class Ref(Expr):
    """A field of a binding."""

    binding: Any
    name: str

    def build(self, ctx):
        return ctx.column(self.binding, self.name)

    def type(self, ctx):
        return ctx.field_type(self.binding, self.name)

    def label(self):
        return f"{self.binding._name or self.binding._index}.{self.name}"


@dataclass(eq=False, frozen=True)
class ParentRef(Expr):
    """A field of a named binding of a query further out."""

    parent: str
    name: str

    def build(self, ctx):
        return ctx.parent_column(self.parent, self.name)

    def type(self, ctx):
        return ctx.parent_type(self.parent, self.name)

    def label(self):
        return f"parent {self.parent}.{self.name}"


@dataclass(eq=False, frozen=True)
class Whole(Expr):
    """A binding's record; null where an outer join found none."""

    binding: Any
    fields: tuple[str, ...] | None = None

    def build(self, ctx):
        names = self.fields or ctx.fields(self.binding)
        columns = [ctx.column(self.binding, n).alias(n) for n in names]
        record = F.struct(*columns)
        if not ctx.joined(self.binding):
            return record
        return F.when(F.coalesce(*[ctx.column(self.binding, n).cast("string") for n in names]).isNotNull(), record)


class Parent:
    """as in parent_as(:x): fields of an outer query's binding."""

    def __init__(self, name: str):
        self._name = name

    def __getattr__(self, field_name: str) -> ParentRef:
        if field_name.startswith("__"):
            raise AttributeError(field_name)
        return ParentRef(self._name, field_name)

    def __getitem__(self, field_name: str) -> ParentRef:
        return ParentRef(self._name, field_name)


def parent_as(name: str) -> Parent:
    return Parent(name)


@dataclass(eq=False, frozen=True)
class Compare(Expr):
    op: str
    left: Expr
    right: Expr

    def children(self):
        return (self.left, self.right)

    def type(self, ctx):
        return "boolean"

    def build(self, ctx):
        if isinstance(self.right, Quantified):
            return self.right.compare(ctx, self.op, self.left)
        if isinstance(self.left, TupleOf) and isinstance(self.right, TupleOf):
            if len(self.left.items) != len(self.right.items):
                raise CompileError("tuples of different sizes can't be compared")
        a, b = _fit(ctx, self.left, self.right), _fit(ctx, self.right, self.left)
        return compare(self.op, a, b)


def compare(op: str, a: Column, b: Column) -> Column:
    return {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


@dataclass(eq=False, frozen=True)
class Arithmetic(Expr):
    op: str
    left: Expr
    right: Expr

    def children(self):
        return (self.left, self.right)

    def type(self, ctx):
        a, b = self.left.type(ctx), self.right.type(ctx)
        return a if a == b else "any"

    def build(self, ctx):
        a, b = _fit(ctx, self.left, self.right), _fit(ctx, self.right, self.left)
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b}[self.op]()


@dataclass(eq=False, frozen=True)
class Logic(Expr):
    op: str
    left: Expr
    right: Expr

    def children(self):
        return (self.left, self.right)

    def type(self, ctx):
        return "boolean"

    def build(self, ctx):
        a, b = self.left.build(ctx), self.right.build(ctx)
        return a & b if self.op == "and" else a | b


@dataclass(eq=False, frozen=True)
class Function(Expr):
    name: str
    apply: Any
    args: tuple
    result: Any = "any"

    def children(self):
        return self.args

    def type(self, ctx):
        return self.result

    def build(self, ctx):
        return self.apply(*[a.build(ctx) for a in self.args])


@dataclass(eq=False, frozen=True)
class TupleOf(Expr):
    items: tuple

    def children(self):
        return self.items

    def build(self, ctx):
        return F.struct(*[x.build(ctx).alias(f"_{i}") for i, x in enumerate(self.items)])


def row(*items) -> TupleOf:
    """A tuple to be compared as a whole."""
    return TupleOf(tuple(wrap(x) for x in items))


@dataclass(eq=False, frozen=True)
class Member(Expr):
    item: Expr
    values: Any

    def children(self):
        return (self.item,)

    def type(self, ctx):
        return "boolean"

    def build(self, ctx):
        from tessera.plans.query import Query

        values = self.values
        if isinstance(values, (Query, Sub)):
            query = values if isinstance(values, Query) else values.query
            return self.item.build(ctx).isin(ctx.single_column(query))
        if isinstance(values, Param):
            values = values.value
        if isinstance(values, Expr):
            kind, item = values.type(ctx), self.item
            if isinstance(item, Lit) and isinstance(kind, tuple):
                item = Param(item.value, kind[1])
            return F.array_contains(values.build(ctx), item.build(ctx))
        if values is None or isinstance(values, str) or not isinstance(values, Iterable):
            raise QueryError(f"in needs a list, not {values!r}")
        values = [wrap(tuple_or(v)) for v in values]
        if isinstance(self.item, TupleOf) and any(len(v.items) != len(self.item.items) for v in values):
            raise CompileError("tuples of different sizes can't be compared")
        return self.item.build(ctx).isin(*[_fit(ctx, v, self.item) for v in values])


def tuple_or(value):
    return row(*value) if isinstance(value, tuple) else value


@dataclass(eq=False, frozen=True)
class Aggregate(Expr):
    name: str
    arg: Expr | None = None
    distinct: bool = False
    condition: Expr | None = None

    def has_aggregate(self):
        return True

    def children(self):
        return tuple(x for x in (self.arg, self.condition) if x is not None)

    def type(self, ctx):
        return "integer" if self.name == "count" else ("try", self.arg.type(ctx) if isinstance(self.arg, Ref) else "any")

    def filter(self, condition):
        return Aggregate(self.name, self.arg, self.distinct, wrap(condition))

    def build(self, ctx, over: bool = False):
        value = F.lit(1) if self.arg is None else self.arg.build(ctx)
        if self.condition is not None:
            value = F.when(self.condition.build(ctx), value)
        if self.distinct:
            return F.collect_set(value) if over else F.count_distinct(value)
        return {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[self.name](value)


def count(arg=None, distinct: bool = False):
    if distinct and arg is None:
        raise CompileError("count of distinct needs an argument")
    return Aggregate("count", None if arg is None else wrap(arg), distinct)


def sum_(arg):
    return Aggregate("sum", wrap(arg))


def avg(arg):
    return Aggregate("avg", wrap(arg))


def min_(arg):
    return Aggregate("min", wrap(arg))


def max_(arg):
    return Aggregate("max", wrap(arg))


def filter_(aggregate: Expr, condition) -> Expr:
    return aggregate.filter(condition)


def coalesce(a, b) -> Expr:
    return Function("coalesce", F.coalesce, (wrap(a), wrap(b)))


@dataclass(eq=False, frozen=True)
class WindowFunction(Expr):
    name: str
    args: tuple = ()

    def children(self):
        return tuple(a for a in self.args if isinstance(a, Expr))

    def type(self, ctx):
        return "integer" if self.name in ("row_number", "rank", "dense_rank", "ntile") else "any"

    def build(self, ctx):
        raise CompileError(f"{self.name} needs over()")


def _ranking(name):
    return lambda: WindowFunction(name)


row_number, rank, dense_rank = _ranking("row_number"), _ranking("rank"), _ranking("dense_rank")
percent_rank, cume_dist = _ranking("percent_rank"), _ranking("cume_dist")


def ntile(n: int):
    return WindowFunction("ntile", (n,))


def first_value(x):
    return WindowFunction("first_value", (wrap(x),))


def last_value(x):
    return WindowFunction("last_value", (wrap(x),))


def nth_value(x, n: int):
    return WindowFunction("nth_value", (wrap(x), n))


def lag(x, offset=1, default=None):
    return WindowFunction("lag", (wrap(x), offset, None if default is None else wrap(default)))


def lead(x, offset=1, default=None):
    return WindowFunction("lead", (wrap(x), offset, None if default is None else wrap(default)))


@dataclass(eq=False, frozen=True)
class Over(Expr):
    function: Expr
    window: Any

    def has_aggregate(self):
        # the function itself is a window function here; what it is applied to may be an aggregate
        return any(c.has_aggregate() for c in self.function.children())

    def children(self):
        return self.function.children()

    def type(self, ctx):
        return self.function.type(ctx)

    def build(self, ctx):
        from tessera.plans.windows import build_over

        return build_over(ctx, self.function, self.window)


@dataclass(eq=False, frozen=True)
class SelectedAs(Expr):
    expr: Expr
    name: str

    def children(self):
        return (self.expr,)

    def type(self, ctx):
        return self.expr.type(ctx)

    def build(self, ctx):
        return self.expr.build(ctx)


@dataclass(eq=False, frozen=True)
class AliasRef(Expr):
    """The select's expression of that name."""

    name: str

    def has_aggregate(self):
        return False

    def build(self, ctx):
        return ctx.selected(self.name).build(ctx)

    def type(self, ctx):
        return ctx.selected(self.name).type(ctx)


def selected_as(expr_or_name, name: str | None = None) -> Expr:
    return AliasRef(expr_or_name) if name is None else SelectedAs(wrap(expr_or_name), name)


@dataclass(eq=False, frozen=True)
class Typed(Expr):
    expr: Expr
    as_type: Any

    def children(self):
        return (self.expr,)

    def type(self, ctx):
        return self.as_type

    def build(self, ctx):
        if isinstance(self.expr, (Lit, Param)):
            value = types.dump(self.as_type, types.cast(self.as_type, self.expr.value))
            column = Lit(value).build(ctx)
        else:
            column = self.expr.build(ctx)
        kind = types.spark_type(self.as_type)
        return column if kind is None else column.cast(kind)


def type_(expr, as_type) -> Expr:
    return Typed(wrap(expr), as_type)


@dataclass(eq=False, frozen=True)
class Identifier:
    name: str


@dataclass(eq=False, frozen=True)
class Splice:
    values: tuple


def identifier(name: str) -> Identifier:
    """A quoted name inside a fragment."""
    return Identifier(name)


def constant(value) -> Lit:
    return Lit(value)


def splice(values) -> Splice:
    """As many arguments of a fragment as there are values."""
    return Splice(tuple(values))


@dataclass(eq=False, frozen=True)
class Fragment(Expr):
    """SQL text with a ? for each argument; \\? is a plain question mark."""

    sql: str
    args: tuple
    aggregate: bool = False

    def children(self):
        return tuple(a for a in self.args if isinstance(a, Expr))

    def has_aggregate(self):
        return self.aggregate or super().has_aggregate()

    def parts(self) -> list[str]:
        return [p.replace("\\?", "?") for p in re.split(r"(?<!\\)\?", self.sql)]

    def build(self, ctx):
        return ctx.sql_expression(self)


def fragment(sql: str, *args, aggregate: bool = False) -> Fragment:
    if not isinstance(sql, str):
        raise CompileError("a fragment's text is plain text")
    held = tuple(a if isinstance(a, (Identifier, Splice)) else wrap(a) for a in args)
    out = Fragment(sql, held, aggregate)
    if len(out.parts()) - 1 != len(held):
        raise CompileError(f"fragment {sql!r} has {len(out.parts()) - 1} places for {len(held)} arguments")
    return out


@dataclass(eq=False, frozen=True)
class JsonPath(Expr):
    expr: Expr
    path: tuple

    def children(self):
        return (self.expr,)

    def __getitem__(self, key):
        return JsonPath(self.expr, (*self.path, key))

    def is_nil(self):
        """Whether there is nothing: a JSON null is something."""
        return JsonMissing(self)

    def build(self, ctx):
        base, keys = self.expr.build(ctx), [k.value if isinstance(k, (Lit, Param)) else k for k in self.path]
        kind = ctx.json_kind(self.expr)
        if kind == "nested":
            for k in keys:
                base = F.get(base, F.lit(k)) if isinstance(k, int) else base.getField(k)
            return base
        if any(isinstance(k, Expr) for k in keys):
            if kind == "variant":
                base = F.to_json(base)
            parts = [F.lit("$")]
            for k in keys:
                parts.append(k.build(ctx) if isinstance(k, Expr) else F.lit(_step(k)))
                if isinstance(k, Expr):
                    parts[-1] = F.concat(F.lit("."), parts[-1].cast("string"))
            return ctx.sql_function("get_json_object", base, F.concat(*parts))
        path = "$" + "".join(_step(k) for k in keys)
        return F.try_variant_get(base, path, "string") if kind == "variant" else F.get_json_object(base, path)


@dataclass(eq=False, frozen=True)
class JsonMissing(Expr):
    at: JsonPath

    def children(self):
        return (self.at,)

    def type(self, ctx):
        return "boolean"

    def build(self, ctx):
        path = [k.value if isinstance(k, (Lit, Param)) else k for k in self.at.path]
        kind = ctx.json_kind(self.at.expr)
        if kind == "nested" or any(isinstance(k, Expr) for k in path):
            return self.at.build(ctx).isNull()
        base = self.at.expr.build(ctx)
        base = base if kind == "variant" else F.try_parse_json(base)
        return F.try_variant_get(base, "$" + "".join(_step(k) for k in path), "variant").isNull()


def _step(key) -> str:
    return f"[{key}]" if isinstance(key, int) else f"['{key}']" if not key.isidentifier() else f".{key}"


def json_extract_path(expr, path) -> Expr:
    return JsonPath(wrap(expr), tuple(path))


_SECONDS = {"hour": 3600, "minute": 60, "second": 1, "millisecond": 0.001, "microsecond": 0.000001}
UNITS = ("year", "month", "week", "day", *_SECONDS)


def interval(ctx, n, unit: str) -> Column:
    """A calendar interval; years and months whole, weeks, days and less may be broken."""
    if unit not in UNITS:
        raise CompileError(f"unknown unit {unit!r}, expected one of {UNITS}")
    zero = F.lit(0)
    value = n.build(ctx) if isinstance(n, Expr) and not isinstance(n, (Lit, Param)) else None
    plain = None if value is not None else (n.value if isinstance(n, (Lit, Param)) else n)
    if unit in ("year", "month"):
        if plain is not None and float(plain) != int(plain):
            raise QueryError(f"{plain} {unit}s is no whole number of months")
        months = (F.lit(int(plain)) if plain is not None else value).cast("int")
        return F.make_interval(months if unit == "year" else zero, months if unit == "month" else zero)
    if unit in ("week", "day"):
        days = (F.lit(float(plain)) if plain is not None else value.cast("double")) * (7 if unit == "week" else 1)
        whole = F.floor(days).cast("int")
        rest = ((days - whole) * 86400).cast("decimal(18,6)")
        return F.make_interval(zero, zero, zero, whole, zero, zero, rest)
    seconds = F.lit(float(plain)) if plain is not None else value.cast("double")
    return F.make_interval(zero, zero, zero, zero, zero, zero, (seconds * _SECONDS[unit]).cast("decimal(18,6)"))


@dataclass(eq=False, frozen=True)
class IntervalAdd(Expr):
    expr: Expr
    n: Any
    unit: str
    to: str

    def children(self):
        return (self.expr,)

    def type(self, ctx):
        return "date" if self.to == "date" else "naive_datetime"

    def build(self, ctx):
        moved = self.expr.build(ctx).cast("timestamp_ntz") + interval(ctx, self.n, self.unit)
        return moved.cast("date") if self.to == "date" else moved


def datetime_add(expr, n, unit: str) -> Expr:
    return IntervalAdd(wrap(expr), n, unit, "datetime")


def date_add(expr, n, unit: str) -> Expr:
    return IntervalAdd(wrap(expr), n, unit, "date")


def from_now(n, unit: str, now: dt.datetime | None = None) -> Expr:
    """The client's time in UTC, bound once, plus n units."""
    now = now or dt.datetime.now(dt.UTC).replace(tzinfo=None)
    return IntervalAdd(Lit(now), n, unit, "datetime")


def ago(n, unit: str, now: dt.datetime | None = None) -> Expr:
    return from_now(-n, unit, now)


@dataclass(eq=False, frozen=True)
class Sub(Expr):
    """A query of one column and at most one row."""

    query: Any

    def build(self, ctx):
        return ctx.scalar(self.query)


@dataclass(eq=False, frozen=True)
class Exists(Expr):
    query: Any

    def type(self, ctx):
        return "boolean"

    def build(self, ctx):
        return ctx.lower(self.query).exists()


def exists(query) -> Expr:
    return Exists(query)


@dataclass(eq=False, frozen=True)
class Quantified(Expr):
    """Right side of a comparison with any or all rows of a query; exact as a filter."""

    kind: str
    query: Any

    def compare(self, ctx, op: str, left: Expr) -> Column:
        return ctx.quantified(self.kind, op, left, self.query)

    def build(self, ctx):
        raise CompileError(f"{self.kind} stands on the right of a comparison")


def any_(query) -> Expr:
    return Quantified("any", query)


def all_(query) -> Expr:
    return Quantified("all", query)


@dataclass(frozen=True)
class Order:
    expr: Expr
    direction: str = "asc"

    def column(self, ctx) -> Column:
        return ordered(self.expr.build(ctx), self.direction)

    def reversed(self) -> Order:
        return Order(self.expr, _REVERSED[self.direction])


_REVERSED = {
    "asc": "desc",
    "desc": "asc",
    "asc_nulls_first": "desc_nulls_last",
    "asc_nulls_last": "desc_nulls_first",
    "desc_nulls_first": "asc_nulls_last",
    "desc_nulls_last": "asc_nulls_first",
}


def ordered(column: Column, direction: str) -> Column:
    """Plain asc puts nulls last and plain desc first, so each is the other reversed."""
    try:
        name = {"asc": "asc_nulls_last", "desc": "desc_nulls_first"}.get(direction, direction)
        return {
            "asc_nulls_first": column.asc_nulls_first,
            "asc_nulls_last": column.asc_nulls_last,
            "desc_nulls_first": column.desc_nulls_first,
            "desc_nulls_last": column.desc_nulls_last,
        }[name]()
    except KeyError:
        raise CompileError(f"unknown direction {direction!r}") from None


def asc(expr, nulls: str | None = None) -> Order:
    return Order(wrap(expr), f"asc_nulls_{nulls}" if nulls else "asc")


def desc(expr, nulls: str | None = None) -> Order:
    return Order(wrap(expr), f"desc_nulls_{nulls}" if nulls else "desc")


@dataclass(eq=False, frozen=True)
class Merge(Expr):
    """Fields of the left side, overridden by the right's."""

    left: Any
    right: Any


def merge(left, right) -> Merge:
    return Merge(left, right)


def struct(binding, fields) -> Whole:
    return Whole(binding, tuple(fields))


@dataclass(eq=False, frozen=True)
class Updated(Expr):
    """A record with some of its fields replaced."""

    base: Any
    changes: dict = field(default_factory=dict)


@dataclass(eq=False, frozen=True)
class NewRecord(Expr):
    """A record of a schema from some of its fields; the others have their defaults."""

    schema: Any
    values: dict = field(default_factory=dict)


def record(schema, **values) -> NewRecord:
    if unknown := values.keys() - schema.fields.keys():
        raise CompileError(f"{sorted(unknown)} aren't fields of {schema.name}")
    return NewRecord(schema, values)


def update(base, **changes) -> Updated:
    return Updated(base, changes)
