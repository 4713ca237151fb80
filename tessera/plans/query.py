"""The query value: immutable, composed clause by clause, lowered to a DataFrame when it is run.

Clauses take plain values, expressions, or functions of bindings: positional parameters get the bindings in order,
a starred one the rest, and keyword-only ones the bindings of these names.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame

from tessera.errors import CompileError, QueryError
from tessera.functions import types
from tessera.plans.expr import Expr, Fragment, Logic, Order, Ref, Whole, wrap
from tessera.plans.schema import Schema
from tessera.plans.windows import orders

JOINS = ("inner", "left", "right", "full", "cross", "inner_lateral", "left_lateral", "cross_lateral")
PARTS = ("where", "having", "group_by", "order_by", "select", "distinct", "limit", "offset", "join", "windows", "combinations", "preload", "lock", "updates", "with_ctes")


@dataclass(frozen=True)
class Source:
    """kind: table, frame, query, fragment or values."""

    kind: str
    value: Any
    schema: Schema | None = None
    prefix: str | None = None
    columns: tuple[str, ...] | None = None
    hints: tuple[str, ...] = ()
    bare: bool = False


@dataclass(frozen=True)
class Join:
    how: str
    source: Source
    on: Any = None
    name: str | None = None
    assoc: tuple | None = None


@dataclass(frozen=True)
class Values:
    rows: tuple
    types: dict


def values(rows, types_: dict) -> Values:
    """A constant table, every column typed."""
    rows = tuple(dict(r) for r in rows)
    if not rows:
        raise CompileError("values needs a row at least")
    for r in rows:
        if r.keys() != types_.keys():
            raise CompileError(f"every row of values has the fields {sorted(types_)}, not {sorted(r)}")
    cast = tuple({k: types.dump(t, types.cast(t, r[k])) for k, t in types_.items()} for r in rows)
    return Values(cast, dict(types_))


@dataclass(frozen=True)
class SubQuery:
    query: Query


def subquery(query) -> SubQuery:
    q = to_query(query)
    if q.preloads:
        raise QueryError("a subquery can't preload")
    return SubQuery(q)


class Binding:
    """What clause functions get: attributes and items are fields."""

    def __init__(self, index: int, name: str | None):
        self._index, self._name = index, name

    def __getattr__(self, field_name: str) -> Ref:
        if field_name.startswith("__"):
            raise AttributeError(field_name)
        return Ref(self, field_name)

    def __getitem__(self, field_name: str) -> Ref:
        return Ref(self, field_name)


def to_source(value, prefix=None, columns=None, hints=()) -> Source:
    hints = tuple([hints] if isinstance(hints, str) else hints)
    if isinstance(value, Schema):
        if value.source is None:
            raise QueryError(f"{value.name} is embedded and has no source")
        return Source("table", value.source, value, prefix or value.prefix, hints=hints)
    if isinstance(value, str):
        return Source("table", value, None, prefix, hints=hints)
    if isinstance(value, tuple) and len(value) == 2 and isinstance(value[1], Schema):
        source, schema = value
        if isinstance(source, Fragment):
            return Source("fragment", source, schema, columns=tuple(schema.stored_fields))
        return Source("table", source, schema, prefix or schema.prefix, hints=hints)
    if prefix is not None:
        raise QueryError("only tables take a prefix")
    if isinstance(value, DataFrame):
        return Source("frame", value, hints=hints)
    if isinstance(value, SubQuery):
        return Source("query", value.query, hints=hints)
    if isinstance(value, Query):
        return Source("query", value, hints=hints, bare=True)
    if isinstance(value, Fragment):
        return Source("fragment", value, columns=tuple(columns) if columns else None, hints=hints)
    if isinstance(value, Values):
        return Source("values", value)
    raise QueryError(f"{value!r} can't be queried")


@dataclass(frozen=True)
class Query:
    source: Source
    name: str | None = None
    joins: tuple[Join, ...] = ()
    wheres: tuple = ()
    havings: tuple = ()
    group_bys: tuple = ()
    select_: Any = None
    merges: tuple = ()
    distinct_: Any = None
    order_bys: tuple = ()
    limit_: Any = None
    offset_: Any = None
    ties: bool = False
    windows_: tuple = ()
    combinations: tuple = ()
    ctes: tuple = ()
    recursive: bool = False
    updates: tuple = ()
    preloads: tuple = ()
    lock_: str | None = None
    prefix_: str | None = None
    names: tuple = field(default=())

    def __str__(self):
        from tessera.plans.inspect import inspect_query

        return inspect_query(self)

    # bindings

    @property
    def bindings(self) -> list[Binding]:
        return [Binding(0, self.name), *(Binding(i + 1, j.name) for i, j in enumerate(self.joins))]

    def has_named_binding(self, name: str) -> bool:
        return any(b._name == name for b in self.bindings)

    def with_named_binding(self, name: str, make: Callable[[Query], Query]) -> Query:
        """The query itself if it has the binding, else what make adds it to."""
        if self.has_named_binding(name):
            return self
        made = make(self)
        if not made.has_named_binding(name):
            raise QueryError(f"the function didn't add a binding {name!r}")
        return made

    def resolve(self, part):
        """A clause's value: functions are called with their bindings."""
        if not callable(part) or isinstance(part, Expr):
            return part
        have, named = self.bindings, {b._name: b for b in self.bindings if b._name}
        given, at, extra = [], 0, {}
        for p in inspect.signature(part).parameters.values():
            if p.kind is p.VAR_POSITIONAL:
                given += have[at:]
                at = len(have)
            elif p.kind is p.KEYWORD_ONLY:
                if p.name not in named:
                    raise QueryError(f"unknown binding {p.name!r}, there are {sorted(named)}")
                extra[p.name] = named[p.name]
            else:
                if at >= len(have):
                    raise QueryError(f"the function takes more than the {len(have)} bindings there are")
                given.append(have[at])
                at += 1
        return part(*given, **extra)

    # clauses

    def _join(self, how: str, source, on=None, as_=None, **options) -> Query:
        if how not in JOINS:
            raise CompileError(f"unknown join {how!r}, expected one of {JOINS}")
        if as_ is not None and self.has_named_binding(as_):
            raise CompileError(f"binding {as_!r} is there already")
        if how.startswith("cross") and on is not None:
            raise CompileError("a cross join takes no on")
        if isinstance(source, AssocOf):
            return replace(self, joins=(*self.joins, Join(how, Source("assoc", None), on, as_, (source.owner._index, source.name))))
        if callable(source) and not isinstance(source, (Expr, Schema)):
            found = self.resolve(source)
            return self._join(how, found, on, as_, **options)
        made = to_source(source, **options)
        return replace(self, joins=(*self.joins, Join(how, made, on, as_)))

    def join(self, source, on=None, as_=None, how: str = "inner", **options) -> Query:
        return self._join(how, source, on, as_, **options)

    def left_join(self, source, on=None, as_=None, **options) -> Query:
        return self._join("left", source, on, as_, **options)

    def right_join(self, source, on=None, as_=None, **options) -> Query:
        return self._join("right", source, on, as_, **options)

    def full_join(self, source, on=None, as_=None, **options) -> Query:
        return self._join("full", source, on, as_, **options)

    def cross_join(self, source, as_=None, **options) -> Query:
        return self._join("cross", source, None, as_, **options)

    def where(self, *parts, **equal) -> Query:
        return replace(self, wheres=(*self.wheres, *_filters("and", parts, equal)))

    def or_where(self, *parts, **equal) -> Query:
        return replace(self, wheres=(*self.wheres, *_filters("or", parts, equal)))

    def having(self, *parts, **equal) -> Query:
        return replace(self, havings=(*self.havings, *_filters("and", parts, equal)))

    def or_having(self, *parts, **equal) -> Query:
        return replace(self, havings=(*self.havings, *_filters("or", parts, equal)))

    def group_by(self, *parts) -> Query:
        return replace(self, group_bys=(*self.group_bys, *parts))

    def select(self, part) -> Query:
        if self.select_ is not None:
            raise CompileError("a query has one select; exclude it first")
        return replace(self, select_=part)

    def select_merge(self, part) -> Query:
        return replace(self, merges=(*self.merges, part))

    def distinct(self, part=True) -> Query:
        if self.distinct_ is not None:
            raise CompileError("a query has one distinct; exclude it first")
        return replace(self, distinct_=part)

    def order_by(self, *parts) -> Query:
        return replace(self, order_bys=(*self.order_bys, *parts))

    def prepend_order_by(self, *parts) -> Query:
        return replace(self, order_bys=(*parts, *self.order_bys))

    def reverse_order(self) -> Query:
        if not self.order_bys:
            return replace(self, order_bys=tuple(Order(wrap(Ref(self.bindings[0], k)), "desc") for k in self._key()))
        flip = lambda p: (lambda *a, **k: [o.reversed() for o in orders(p(*a, **k))])
        out = []
        for p in self.order_bys:
            if callable(p) and not isinstance(p, Expr):
                flipped = flip(p)
                flipped.__signature__ = inspect.signature(p)
                out.append(flipped)
            else:
                out += [o.reversed() for o in orders(self._fields(p))]
        return replace(self, order_bys=tuple(out))

    def _fields(self, part):
        """Bare names are fields of the first binding."""
        one = lambda x: Ref(self.bindings[0], x) if isinstance(x, str) else x
        if isinstance(part, tuple) and len(part) == 2 and isinstance(part[0], str) and part[0].split("_")[0] in ("asc", "desc"):
            return (part[0], one(part[1]))
        if isinstance(part, (list, tuple)):
            return [self._fields(x) if isinstance(x, tuple) else one(x) for x in part]
        return one(part)

    def _key(self) -> list[str]:
        if self.source.schema is None or not self.source.schema.primary_key:
            raise QueryError("there is no order and no primary key to order by")
        return self.source.schema.primary_key

    def first(self, by=None) -> Query:
        q = self.order_by(by) if by is not None else self
        if not q.order_bys:
            q = q.order_by(*[Order(wrap(Ref(q.bindings[0], k))) for k in q._key()])
        return q.limit(1)

    def last(self, by=None) -> Query:
        q = self.order_by(by) if by is not None else self
        return q.reverse_order().limit(1)

    def limit(self, n) -> Query:
        return replace(self, limit_=n, ties=False)

    def offset(self, n) -> Query:
        return replace(self, offset_=n)

    def with_ties(self, on: bool = True) -> Query:
        if on and self.limit_ is None:
            raise QueryError("with_ties needs a limit")
        return replace(self, ties=on)

    def windows(self, **specs) -> Query:
        held = dict(self.windows_)
        for name in specs:
            if name in held:
                raise CompileError(f"window {name!r} is there already")
        return replace(self, windows_=(*self.windows_, *specs.items()))

    def _combine(self, kind: str, other) -> Query:
        return replace(self, combinations=(*self.combinations, (kind, to_query(other))))

    def union(self, other) -> Query:
        return self._combine("union", other)

    def union_all(self, other) -> Query:
        return self._combine("union_all", other)

    def except_(self, other) -> Query:
        return self._combine("except", other)

    def except_all(self, other) -> Query:
        return self._combine("except_all", other)

    def intersect(self, other) -> Query:
        return self._combine("intersect", other)

    def intersect_all(self, other) -> Query:
        return self._combine("intersect_all", other)

    def with_cte(self, name: str, query, materialized: bool | None = None, operation: str = "all") -> Query:
        held = query if isinstance(query, Fragment) else to_query(query)
        return replace(self, ctes=(*(c for c in self.ctes if c[0] != name), (name, held, materialized, operation)))

    def recursive_ctes(self, on: bool = True) -> Query:
        return replace(self, recursive=on)

    def update(self, **operations) -> Query:
        """set=, inc=, push=, pull=: dicts of fields (values or functions of bindings)."""
        unknown = operations.keys() - {"set", "inc", "push", "pull"}
        if unknown:
            raise CompileError(f"unknown update {sorted(unknown)}")
        return replace(self, updates=(*self.updates, *((op, fields) for op, fields in operations.items())))

    def preload(self, *names, **nested) -> Query:
        """Names, (name, nested) or name=nested; a function of bindings gives {name: binding} for those that are joined already."""
        return replace(self, preloads=(*self.preloads, *names, *nested.items()))

    def lock(self, text: str) -> Query:
        """Accepted for compatibility: Spark has no row locks."""
        return replace(self, lock_=text)

    def put_query_prefix(self, prefix: str | None) -> Query:
        return replace(self, prefix_=prefix)

    def exclude(self, *parts: str) -> Query:
        blank = {
            "where": {"wheres": ()},
            "having": {"havings": ()},
            "group_by": {"group_bys": ()},
            "order_by": {"order_bys": ()},
            "select": {"select_": None, "merges": ()},
            "distinct": {"distinct_": None},
            "limit": {"limit_": None, "ties": False},
            "offset": {"offset_": None},
            "join": {"joins": ()},
            "windows": {"windows_": ()},
            "combinations": {"combinations": ()},
            "preload": {"preloads": ()},
            "lock": {"lock_": None},
            "updates": {"updates": ()},
            "with_ctes": {"ctes": ()},
        }
        q = self
        for p in parts:
            if p in blank:
                q = replace(q, **blank[p])
            elif p.endswith("_join") or p in JOINS:
                how = p.removesuffix("_join")
                q = replace(q, joins=tuple(j for j in q.joins if j.how != how))
            else:
                raise CompileError(f"unknown part {p!r}, expected one of {PARTS}")
        return q


def _filters(op: str, parts, equal: dict):
    out = []
    for p in parts:
        if p is None:
            raise CompileError("a filter can't be null")
        out.append((op, p))
    if equal:
        for k, v in equal.items():
            if v is None:
                raise CompileError(f"{k}=None is never true; use is_nil()")
        out.append((op, _equal(equal)))
    return out


def _equal(fields: dict):
    return lambda first, *_: _all([first[k] == v for k, v in fields.items()])


def _all(parts) -> Expr:
    out = parts[0]
    for p in parts[1:]:
        out = Logic("and", out, p)
    return out


@dataclass(frozen=True)
class AssocOf:
    owner: Binding
    name: str


def assoc(binding: Binding, name: str) -> AssocOf:
    """In a join: the association of that binding."""
    return AssocOf(binding, name)


def dynamic(function: Callable) -> Callable:
    """A filter or value to be composed: a function of bindings, with & and | and ~."""
    return Dynamic(function)


class Dynamic:
    def __init__(self, function: Callable):
        self.function = function
        self.__signature__ = inspect.signature(function)

    def __call__(self, *args, **named):
        return self.function(*args, **named)

    def _with(self, other, join):
        def both(*args, **named):
            return join(_called(self, args, named), _called(other, args, named))

        out = Dynamic(both)
        out.__signature__ = _merged(self.__signature__, other.__signature__)
        return out

    def __and__(self, other):
        return self._with(other, lambda a, b: a & b)

    def __or__(self, other):
        return self._with(other, lambda a, b: a | b)

    def __invert__(self):
        out = Dynamic(lambda *args, **named: ~self.function(*args, **named))
        out.__signature__ = self.__signature__
        return out


def _merged(a: inspect.Signature, b: inspect.Signature) -> inspect.Signature:
    kinds = inspect.Parameter
    places = lambda s: [p for p in s.parameters.values() if p.kind is kinds.POSITIONAL_OR_KEYWORD]
    most = max(places(a), places(b), key=len)
    names = {p.name: p for s in (a, b) for p in s.parameters.values() if p.kind is kinds.KEYWORD_ONLY}
    return inspect.Signature([kinds(f"b{i}", kinds.POSITIONAL_OR_KEYWORD) for i in range(len(most))] + list(names.values()))


def _called(d: Dynamic, args, named):
    want = d.__signature__.parameters.values()
    n = sum(p.kind is p.POSITIONAL_OR_KEYWORD for p in want)
    own = {p.name: named[p.name] for p in want if p.kind is p.KEYWORD_ONLY}
    return d(*args[:n], **own)


def to_query(value) -> Query:
    if isinstance(value, Query):
        return value
    return Query(to_source(value))


def from_(value, as_: str | None = None, **options) -> Query:
    """Start a query from a table name, schema, (name, schema), DataFrame, query, subquery, fragment or values."""
    if isinstance(value, Query):
        return replace(value, name=as_) if as_ else value
    return Query(to_source(value, **options), as_)


def whole(binding: Binding) -> Whole:
    return Whole(binding)
