"""From a query value to one DataFrame: all optimising is Catalyst's.

Order of clauses: CTEs, sources and joins, where, group by with having, windows, select, distinct, combinations, order,
offset and limit. Terms of an order that the select lacks travel as hidden columns.
"""

from __future__ import annotations

import itertools
import warnings
from dataclasses import replace
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import CompileError, QueryError, SubQueryError
from tessera.functions import types
from tessera.plans.expr import (
    AliasRef, Compare, Expr, Fragment, Function, Identifier, Lit, Logic, Merge, NewRecord, Order, Param, Ref, SelectedAs, Splice, Typed, Updated, Whole, compare,
    ordered, wrap,
)
from tessera.plans.query import Binding, Join, Query, Source, SubQuery, Values, to_source
from tessera.plans.windows import orders

_count = itertools.count()


def quoted(*names: str) -> str:
    return ".".join("`" + n.replace("`", "``") + "`" for n in names)


class Context:
    """Where a query's expressions are built: its bindings, windows and select, and the queries around it."""

    def __init__(self, engine, query: Query, parent: Context | None, scope: dict[str, DataFrame]):
        self.engine, self.query, self.parent, self.scope = engine, query, parent, scope
        self.aliases: list[str] = []
        self.known: list[list[str] | None] = []
        self.schemas: list = []
        self.kinds: list[dict[str, T.DataType]] = []
        self.outer: list[bool] = []
        self.selects: dict[str, Expr] = {}
        self.pending: list[tuple[str, Any]] = []
        self.lateral = False
        self.aggregated = True  # until it is known not to be

    # bindings

    def add(self, name: str | None, df: DataFrame, schema, joined: bool) -> str:
        alias = f"{name or 'b'}_{next(_count)}"
        self.aliases.append(alias)
        # what refers to a query further out has no schema before it is joined, but its names are known
        lateral = getattr(df, "_names", None) if self.lateral else None
        fields = dict.fromkeys(lateral) if lateral else {f.name: f.dataType for f in df.schema.fields}
        self.known.append(list(fields))
        self.kinds.append(fields)
        self.schemas.append(schema)
        self.outer.append(joined)
        return alias

    def _index(self, binding: Binding) -> int:
        if binding._index >= len(self.aliases):
            raise QueryError(f"binding {binding._name or binding._index} isn't there (yet)")
        return binding._index

    def column(self, binding: Binding, name: str) -> Column:
        i = self._index(binding)
        schema = self.schemas[i]
        if schema is not None and name in schema.fields and schema.fields[name].virtual:
            raise QueryError(f"field {name!r} of {schema.name} is virtual")
        if name not in self.known[i]:
            near = [k for k in self.known[i] if k.lower().startswith(name.lower()[:3])]
            raise QueryError(f"field {name!r} isn't in {schema or self.aliases[i]}" + (f"; did you mean one of {near}?" if near else ""))
        return F.col(quoted(self.aliases[i], name))

    def field_type(self, binding: Binding, name: str) -> Any:
        schema = self.schemas[self._index(binding)]
        return schema.type_of(name) if schema is not None and (name in schema.fields or name in schema.embeds) else "any"

    def fields(self, binding: Binding) -> list[str]:
        i = self._index(binding)
        schema = self.schemas[i]
        return [k for k in schema.query_fields if k in self.known[i]] if schema is not None else self.known[i]

    def joined(self, binding: Binding) -> bool:
        return self.outer[self._index(binding)]

    def _parent(self, name: str) -> tuple[Context, int]:
        ctx = self.parent
        while ctx is not None:
            for b in ctx.query.bindings:
                if b._name == name and b._index < len(ctx.aliases):
                    return ctx, b._index
            ctx = ctx.parent
        raise QueryError(f"no query further out has a binding {name!r}")

    def parent_column(self, name: str, field: str) -> Column:
        ctx, i = self._parent(name)
        if field not in ctx.known[i]:
            raise QueryError(f"field {field!r} isn't in the parent's {name!r}")
        return F.col(quoted(ctx.aliases[i], field)).outer()

    def parent_type(self, name: str, field: str) -> Any:
        ctx, i = self._parent(name)
        return ctx.schemas[i].type_of(field) if ctx.schemas[i] is not None else "any"

    # names

    def window(self, name: str) -> dict:
        specs = dict(self.query.windows_)
        if name not in specs:
            raise QueryError(f"unknown window {name!r}, there are {sorted(specs)}")
        spec = self.query.resolve(specs[name])
        return {k: self.query.resolve(v) for k, v in spec.items()}

    def selected(self, name: str) -> Expr:
        if name not in self.selects:
            raise QueryError(f"nothing is selected as {name!r}")
        return self.selects[name]

    def before_select(self, column: Column, first: bool = False) -> Column:
        """A column to be there before the select is built; first: before the columns there are so far, which it must not use."""
        name = self.before_select_name(column)
        if first:
            self.pending.insert(0, self.pending.pop())
        return F.col(name)

    def before_select_name(self, column: Column) -> str:
        name = f"__pre_{next(_count)}"
        self.pending.append((name, column))
        return name

    def before_select_step(self, name: str, step) -> Column:
        """A column that step, a function of DataFrames, adds."""
        self.pending.append((name, step))
        return F.col(name)

    def prepared(self, df: DataFrame) -> DataFrame:
        for name, made in self.pending:
            df = df.withColumn(name, made) if isinstance(made, Column) else made(df)
        return df

    # nested queries and SQL

    def lower(self, query) -> DataFrame:
        return lower(self.engine, query.query if isinstance(query, SubQuery) else query, self, self.scope)

    def single_column(self, query) -> DataFrame:
        q = query.query if isinstance(query, SubQuery) else query
        df = self.lower(q)
        if q.select_ is not None and isinstance(q.resolve(q.select_), (dict, list, tuple)) and len(q.resolve(q.select_)) != 1:
            raise SubQueryError("a subquery in an expression has one column")
        return df

    def scalar(self, query) -> Column:
        return self.single_column(query).scalar()

    def quantified(self, kind: str, op: str, left: Expr, query) -> Column:
        """x op any(q): a row with x op y exists; x op all(q): none exists where it isn't true."""
        q = query.query if isinstance(query, SubQuery) else query
        inner = self.single_column(q).toDF("__y")
        value = _outer(self, left)
        met = compare(op, value, F.col("__y"))
        return inner.where(met).exists() if kind == "any" else ~inner.where(~F.coalesce(met, F.lit(False))).exists()

    def json_kind(self, expr: Expr) -> str:
        if isinstance(expr, Ref):
            kind = self.kinds[self._index(expr.binding)].get(expr.name)
            if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
                return "nested"
            if isinstance(kind, T.VariantType):
                return "variant"
        return "text"

    def sql_function(self, name: str, *args: Column) -> Column:
        return F.call_function(name, *args)

    def sql_expression(self, fragment: Fragment) -> Column:
        """The text with its arguments put in: a lambda's variables carry the columns."""
        text, parts = "", fragment.parts()
        for part, arg in itertools.zip_longest(parts, fragment.args):
            text += part
            if arg is None:
                continue
            if isinstance(arg, Identifier):
                text += quoted(arg.name)
                continue
            made = [wrap(v) for v in arg.values] if isinstance(arg, Splice) else [arg]
            names = []
            for x in made:
                names.append(_inline(self, x))
            text += ", ".join(names)
        return F.expr(text)


def _inline(ctx: Context, x: Expr) -> str:
    """SQL text of an argument: fields by their names, values as literals, other expressions by a name of their own."""
    if isinstance(x, Ref):
        return quoted(ctx.aliases[ctx._index(x.binding)], _checked(ctx, x))
    if isinstance(x, (Lit, Param)):
        v = types.cast(x.as_type, x.value) if isinstance(x, Param) and x.as_type else x.value
        return _literal(v)
    if isinstance(x, Fragment):
        return "(" + "".join(
            p + (", ".join(_inline(ctx, wrap(v)) for v in a.values) if isinstance(a, Splice) else quoted(a.name) if isinstance(a, Identifier) else "" if a is None else _inline(ctx, a))
            for p, a in itertools.zip_longest(x.parts(), x.args)
        ) + ")"
    if x.has_aggregate():
        raise QueryError("an aggregate can't be an argument of a fragment; write the aggregate in the fragment")
    return quoted(ctx.before_select_name(x.build(ctx)))


def _checked(ctx: Context, x: Ref) -> str:
    ctx.column(x.binding, x.name)
    return x.name


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return repr(v)
    if isinstance(v, float):
        return f"CAST('{v!r}' AS DOUBLE)"
    if isinstance(v, Decimal):
        return f"{v:f}BD"
    if isinstance(v, (list, tuple)):
        return "array(" + ", ".join(_literal(x) for x in v) + ")"
    if isinstance(v, bytes):
        return f"X'{v.hex()}'"
    kind = {"datetime": "timestamp_ntz" if getattr(v, "tzinfo", None) is None else "timestamp", "date": "date"}.get(type(v).__name__)
    text = "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{kind} {text}" if kind else text


def _outer(ctx: Context, left: Expr) -> Column:
    """A value of this query as its subquery sees it."""
    if isinstance(left, Ref):
        ctx.column(left.binding, left.name)
        return F.col(quoted(ctx.aliases[ctx._index(left.binding)], left.name)).outer()
    if isinstance(left, (Lit, Param)):
        return left.build(ctx)
    raise QueryError("any and all are compared with a field or a value")


# sources


def frame_of(engine, source: Source, ctx: Context, query: Query) -> tuple[DataFrame, Any]:
    if source.kind == "frame":
        df = source.value
    elif source.kind == "query":
        df = lower(engine, _as_subquery(source.value), ctx, ctx.scope)
    elif source.kind == "values":
        held: Values = source.value
        kind = T.StructType([T.StructField(k, types.spark_type(t) or T.StringType()) for k, t in held.types.items()])
        df = engine.spark.createDataFrame([tuple(r[k] for k in held.types) for r in held.rows], kind)
    elif source.kind == "fragment":
        df = _fragment_frame(engine, source, ctx)
    elif source.value in ctx.scope:
        df = ctx.scope[source.value]
    else:
        df = engine.table(source.value, source.prefix or query.prefix_)
    if source.schema is not None:
        df = typed(df, source.schema)
    for hint in source.hints:
        df = _hinted(df, hint)
    return df, source.schema


def _hinted(df: DataFrame, hint: str) -> DataFrame:
    name, _, rest = hint.partition("(")
    if name.strip().upper() == "TABLESAMPLE":
        share, _, seed = rest.rstrip(")").partition(",")
        return df.sample(fraction=float(share) / 100, seed=int(seed or 0))
    return df.hint(name.strip(), *[x.strip() for x in rest.rstrip(")").split(",") if x.strip()])


def typed(df: DataFrame, schema) -> DataFrame:
    """A table's columns under their field names, custom types loaded."""
    have = set(df.columns)
    out = []
    for k in schema.stored_fields:
        stored = schema.source_of(k)
        if stored not in have:
            raise QueryError(f"{schema.name} has no column {stored!r}")
        column = F.col(quoted(stored))
        kind = schema.type_of(k)
        out.append((types.load(kind, column) if _needs_load(kind) else column).alias(k))
    return df.select(*out)


def _needs_load(kind) -> bool:
    if isinstance(kind, tuple):
        return _needs_load(kind[1])
    return isinstance(kind, types.CustomType)


def _as_subquery(q: Query) -> Query:
    shape = q.resolve(q.select_) if q.select_ is not None else None
    if isinstance(shape, tuple) or isinstance(shape, list) and not all(isinstance(x, str) for x in shape):
        raise SubQueryError("a subquery as a source selects a source, a field, a map or a merge")
    return q


def _fragment_frame(engine, source: Source, ctx: Context) -> DataFrame:
    f: Fragment = source.value
    text = ""
    for part, arg in itertools.zip_longest(f.parts(), f.args):
        text += part
        if isinstance(arg, Identifier):
            text += quoted(arg.name)
        elif isinstance(arg, Splice):
            text += ", ".join(_literal(v.value if isinstance(v, (Lit, Param)) else v) for v in arg.values)
        elif arg is not None:
            text += _inline(ctx, arg)
    views = dict(ctx.scope)
    sql = text if text.lstrip().upper().startswith(("SELECT", "WITH", "VALUES", "(")) else f"SELECT * FROM {text}"
    df = engine.sql(sql, views)
    return df.toDF(*source.columns) if source.columns else df


# clauses


def fold(ctx: Context, query: Query, filters) -> Column | None:
    """(all before) op next, from the left."""
    out = None
    for op, part in filters:
        part = query.resolve(part)
        if isinstance(part, dict):
            raise QueryError("pass equal fields as keyword arguments")
        if part is True:
            continue
        column = wrap(part).build(ctx)
        out = column if out is None else (out & column if op == "and" else out | column)
    return out


def shape(ctx: Context, query: Query) -> tuple[list[tuple[str, Expr]], bool]:
    """Names and expressions of the select, and whether it is one bare value."""
    part = query.resolve(query.select_) if query.select_ is not None else query.bindings[0]
    merges = [query.resolve(m) for m in query.merges]
    if query.select_ is None and not merges and query.source.kind == "table" and query.source.schema is None and query.source.value not in ctx.scope:
        raise QueryError(f"{query.source.value!r} has no schema, so the query needs a select")
    if merges and query.select_ is None and query.source.schema is None and all(isinstance(m, dict) for m in merges):
        part = merges.pop(0) if ctx.engine.schemaless_merge else part
    named = spread(ctx, part)
    for m in merges:
        named = named | spread(ctx, m)
    for name, e in named.items():
        if isinstance(e, SelectedAs):
            if e.name in ctx.selects:
                raise CompileError(f"{e.name!r} is selected twice")
            ctx.selects[e.name] = e.expr
    out = []
    for name, e in named.items():
        out.append((e.name if isinstance(e, SelectedAs) else name, e))
    if len({n for n, _ in out}) < len(out):
        raise CompileError("two selected values have one name")
    return out, isinstance(part, Expr) and not isinstance(part, (Whole, Merge, Updated, NewRecord)) and not merges


def spread(ctx: Context, part) -> dict[str, Expr]:
    """A select as named expressions."""
    if isinstance(part, Binding):
        return {n: Ref(part, n) for n in ctx.fields(part)}
    if isinstance(part, Whole):
        return {n: Ref(part.binding, n) for n in part.fields or ctx.fields(part.binding)}
    if isinstance(part, NewRecord):
        blank = {k: Typed(Lit(f.default), f.type) for k, f in part.schema.fields.items()}
        return blank | {k: _value(v) for k, v in part.values.items()}
    if isinstance(part, dict) and any(isinstance(k, Expr) for k in part):
        # keys from the data: each row has a map of its own
        return {"value": Function("map", lambda *c: F.create_map(*c), tuple(_value(x) for pair in part.items() for x in pair))}
    if isinstance(part, dict):
        return {str(k): _value(v) for k, v in part.items()}
    if isinstance(part, (list, tuple)):
        if isinstance(part, list) and part and all(isinstance(x, str) for x in part):
            return {n: Ref(ctx.query.bindings[0], n) for n in part}
        return {f"_{i + 1}": _value(v) for i, v in enumerate(part)}
    if isinstance(part, Merge):
        left, right = spread(ctx, part.left), spread(ctx, part.right)
        if isinstance(part.left, Binding) and ctx.schemas[part.left._index] is not None:
            known = set(left) | set(ctx.schemas[part.left._index].fields)
            if unknown := right.keys() - known:
                raise QueryError(f"{sorted(unknown)} aren't fields of {ctx.schemas[part.left._index].name}")
        return left | right
    if isinstance(part, Updated):
        base = spread(ctx, part.base)
        if unknown := part.changes.keys() - base.keys():
            raise QueryError(f"{sorted(unknown)} aren't there to be updated")
        return base | {k: _value(v) for k, v in part.changes.items()}
    if isinstance(part, Ref):
        return {part.name: part}
    return {"value": wrap(part)}


def _value(v) -> Expr:
    return Whole(v) if isinstance(v, Binding) else wrap(v)


def lower(engine, query: Query, parent: Context | None = None, scope: dict[str, DataFrame] | None = None) -> DataFrame:
    if query.updates:
        raise QueryError("updates are for update_all")
    scope = dict(scope or {})
    for name, cte, materialized, operation in query.ctes:
        scope[name] = _cte(engine, query, name, cte, materialized, operation, parent, scope)
    if query.lock_:
        warnings.warn("Spark has no row locks; lock is ignored", stacklevel=2)
    df, ctx = joined(engine, query, parent, scope)
    condition = fold(ctx, query, query.wheres)
    if condition is not None:
        df = df.where(condition)
    named, _ = shape(ctx, query)
    groups = []
    for part in query.group_bys:
        found = query.resolve(part)
        found = [found] if isinstance(found, (Expr, str)) else list(found)
        groups += [wrap(query._fields(x)) for x in found]
    distinct_on = _distinct_on(query)
    sorting = _orders(query)
    aggregated = bool(groups) or bool(query.havings) or any(e.has_aggregate() for _, e in named)
    ctx.aggregated = aggregated
    hidden = [] if query.combinations else [(f"__order_{i}", o.expr, o.direction) for i, o in enumerate(sorting)]
    if aggregated:
        df, named_columns, hidden_columns = _grouped(df, ctx, query, groups, named, hidden, distinct_on)
    else:
        named_columns = [(n, e.build(ctx)) for n, e in named]
        hidden_columns = [(n, e.build(ctx)) for n, e, _ in hidden]
        hidden_columns += [(f"__on_{i}", o.expr.build(ctx)) for i, o in enumerate(distinct_on)]
        df = ctx.prepared(df)
    names = [n for n, _ in named_columns]
    if query.distinct_ is True:
        same = {id(e): n for n, e in named} | {("ref", e.binding._index, e.name): n for n, e in named if isinstance(e, Ref)}
        terms = []
        for _, e, direction in hidden:
            at = e.name if isinstance(e, AliasRef) else same.get(id(e)) or isinstance(e, Ref) and same.get(("ref", e.binding._index, e.name))
            if not at:
                raise QueryError("a distinct query can be ordered by what it selects only")
            terms.append((at, direction))
        df = df.select(*[c.alias(n) for n, c in named_columns]).distinct()
        return _finish(engine, query, parent, scope, df, names, terms)
    if not hidden_columns:
        df = df.select(*[c.alias(n) for n, c in named_columns])
        return _finish(engine, query, parent, scope, df, names, [])
    df = df.select(*[c.alias(n) for n, c in [*named_columns, *hidden_columns]])
    terms = [(n, d) for n, _, d in hidden]
    if distinct_on:
        keys = [F.col(f"__on_{i}") for i in range(len(distinct_on))]
        by = [(f"__on_{i}", o.direction) for i, o in enumerate(distinct_on)]
        first = Window.partitionBy(*keys).orderBy(*(_sorted_by(terms) or [F.lit(1)]))
        df = df.withColumn("__nth", F.row_number().over(first)).where("__nth = 1")
        terms = [*by, *terms]
    return _finish(engine, query, parent, scope, df, names, terms)


def _distinct_on(query: Query) -> list[Order]:
    if query.distinct_ is None or isinstance(query.distinct_, bool):
        return []
    found = query.resolve(query.distinct_)
    if found is True:
        return []
    return orders(query._fields(found if isinstance(found, (list, tuple)) else [found]))


def _orders(query: Query) -> list[Order]:
    out = []
    for part in query.order_bys:
        found = query.resolve(part)
        out += [o if isinstance(o, Order) else Order(wrap(o)) for o in orders(query._fields(found))]
    return out


def joined(engine, query: Query, parent: Context | None, scope: dict[str, DataFrame]) -> tuple[DataFrame, Context]:
    """The sources of a query, joined, and the context for its expressions."""
    query = _with_assocs(query)
    ctx = Context(engine, query, parent, scope)
    first, schema = frame_of(engine, query.source, ctx, query)
    df = first.alias(ctx.add(query.name, first, schema, False))
    for j in query.joins:
        df = _joined(engine, query, ctx, df, j)
    return df, ctx


def _joined(engine, query: Query, ctx: Context, df: DataFrame, j: Join) -> DataFrame:
    lateral = j.how.endswith("_lateral")
    source, filters = j.source, ()
    if source.kind == "query" and not lateral and _only_where(source.value):
        # a query of filters alone: its filters go into the join's condition
        source, filters = source.value.source, source.value.wheres
    elif source.kind == "query" and source.bare and not lateral and not _bare(source.value):
        raise QueryError("a query that is joined as it is has filters only; wrap others in subquery()")
    right, schema = frame_of(engine, source, ctx, query)
    if filters:
        inner = Context(engine, Query(source), None, ctx.scope)
        right = right.alias(inner.add(None, right, schema, False))
        right = right.where(fold(inner, inner.query, filters))
    how = j.how.removesuffix("_lateral")
    outer = how in ("left", "full")
    if how in ("right", "full"):
        ctx.outer = [True] * len(ctx.outer)
    ctx.lateral = lateral
    alias = ctx.add(j.name, right, schema, outer)
    right = right.alias(alias)
    on = query.resolve(j.on) if j.on is not None else None
    if isinstance(on, dict):
        own = query.bindings[len(ctx.aliases) - 1]
        parts = [Compare("==", Ref(own, k), wrap(v)) for k, v in on.items()]
        on = parts[0]
        for p in parts[1:]:
            on = Logic("and", on, p)
    condition = None if on is None or on is True else wrap(on).build(ctx)
    if lateral:
        return df.lateralJoin(right, on=condition, how=how)
    if how == "cross":
        return df.crossJoin(right)
    if condition is None:
        warnings.warn(f"{j.how} join without on: every pair of rows", stacklevel=2)
        condition = F.lit(True)
    return df.join(right, condition, how)


def _bare(q: Query) -> bool:
    """A query that is its source and no more."""
    return replace(q, name=None) == Query(q.source, prefix_=q.prefix_)


def _only_where(q: Query) -> bool:
    bare = replace(q, wheres=(), name=None)
    return bool(q.wheres) and bare == Query(q.source, prefix_=q.prefix_) and q.source.kind in ("table", "frame")


def _with_assocs(query: Query) -> Query:
    """Joins over associations become joins with conditions."""
    if not any(j.source.kind == "assoc" for j in query.joins):
        return query
    from tessera.operators.associations import expand

    return expand(query)


def _grouped(df, ctx: Context, query: Query, groups, named, hidden, distinct_on):
    """One aggregation gives the select, the hidden order terms and the having."""
    keys = [g.build(ctx) for g in groups]
    outputs = [(n, e) for n, e in named] + [(n, e) for n, e, _ in hidden] + [(f"__on_{i}", o.expr) for i, o in enumerate(distinct_on)]
    columns = [(f"__out_{i}", e.build(ctx)) for i, (_, e) in enumerate(outputs)]
    condition = fold(ctx, query, query.havings)
    extra = [] if condition is None else [condition.alias("__having")]
    df = ctx.prepared(df)
    wanted = [*[c.alias(n) for n, c in columns], *extra]
    if keys:
        made = df.groupBy(*keys).agg(*wanted)
    else:
        # a select of aggregates alone; with a having there is one group whatever is selected
        made = df.select(*wanted) if any(e.has_aggregate() for _, e in outputs) or extra else df.agg(*wanted)
    if condition is not None:
        made = made.where("__having")
    out = [(n, F.col(c)) for (n, _), (c, _) in zip(outputs, columns)]
    return made, out[: len(named)], out[len(named) :]


def _sorted_by(terms: list[tuple[str, str]]) -> list[Column]:
    return [ordered(F.col(quoted(n)), d) for n, d in terms]


def _with_ties(df: DataFrame, terms: list[tuple[str, str]], n: int, skip: int) -> DataFrame:
    """The first n rows after skip and those that tie with the last: only rows with a value of the first n + skip are ranked."""
    order = _sorted_by(terms)
    if terms:
        top = df.select(*[F.col(quoted(t)).alias(f"__top_{i}") for i, (t, _) in enumerate(terms)])
        top = top.orderBy(*[ordered(F.col(f"__top_{i}"), d) for i, (_, d) in enumerate(terms)]).limit(n + skip).distinct()
        df = df.join(top, reduce(Column.__and__, [F.col(quoted(t)).eqNullSafe(F.col(f"__top_{i}")) for i, (t, _) in enumerate(terms)]), "left_semi")
    w = Window.orderBy(*(order or [F.lit(1)]))
    ranked = df.withColumn("__rank", F.rank().over(w)).withColumn("__row", F.row_number().over(w))
    return ranked.where((F.col("__row") > skip) & (F.col("__rank") <= skip + n))


def _finish(engine, query: Query, parent, scope, df: DataFrame, names: list[str], terms: list[tuple[str, str]]) -> DataFrame:
    if query.combinations:
        df = df.select(*[F.col(quoted(n)) for n in names])
        for kind, other in query.combinations:
            right = lower(engine, other, parent, scope)
            df = {
                "union": lambda: df.union(right).distinct(),
                "union_all": lambda: df.union(right),
                "except": lambda: df.subtract(right),
                "except_all": lambda: df.exceptAll(right),
                "intersect": lambda: df.intersect(right),
                "intersect_all": lambda: df.intersectAll(right),
            }[kind]()
        terms = []
        for o in _orders(query):
            e = o.expr
            at = e.name if isinstance(e, (AliasRef, Ref)) else None
            if at not in names:
                raise QueryError("a combination can be ordered by its columns only")
            terms.append((at, o.direction))
    n, skip = _number(query, query.limit_, "limit"), _number(query, query.offset_, "offset")
    if query.ties and n is not None:
        df = _with_ties(df, terms, n, skip or 0)
        if terms:
            df = df.orderBy(*_sorted_by(terms))
    else:
        if terms:
            df = df.orderBy(*_sorted_by(terms))
        if skip:
            df = df.offset(skip)
        if n is not None:
            df = df.limit(n)
    out = df.select(*[F.col(quoted(x)) for x in names])
    out._names = names
    return out


def _number(query: Query, part, what: str) -> int | None:
    if part is None:
        return None
    found = query.resolve(part)
    found = found.value if isinstance(found, (Lit, Param)) else found
    if isinstance(found, bool) or not isinstance(found, int) or found < 0:
        raise QueryError(f"{what} is a whole number, not {found!r}")
    return found


# CTEs


def _cte(engine, query: Query, name: str, cte, materialized, operation: str, parent, scope) -> DataFrame:
    if operation != "all":
        from tessera.operators import dml

        done = dml.update_all(engine, cte) if operation == "update_all" else dml.delete_all(engine, cte)
        return done.affected
    if isinstance(cte, Fragment):
        if query.recursive:
            text = "".join(p + ("" if a is None else _literal(a.value)) for p, a in itertools.zip_longest(cte.parts(), cte.args))
            return engine.sql(f"WITH RECURSIVE {quoted(name)} AS ({text}) SELECT * FROM {quoted(name)}", scope)
        df = engine.sql("".join(p + ("" if a is None else _literal(a.value)) for p, a in itertools.zip_longest(cte.parts(), cte.args)), scope)
    elif query.recursive and cte.combinations and _mentions(cte.combinations[-1][1], name):
        return recursive(engine, name, cte, parent, scope)
    else:
        df = lower(engine, cte, parent, scope)
    return engine.staged(df) if materialized else df


def _mentions(query: Query, name: str) -> bool:
    sources = [query.source, *(j.source for j in query.joins)]
    return any(s.kind == "table" and s.value == name or s.kind == "query" and _mentions(s.value, name) for s in sources)


def recursive(engine, name: str, cte: Query, parent, scope, most: int = 10_000, most_parts: int = 25) -> DataFrame:
    """Anchor, then steps over the rows that the step before added, until one adds none.

    UNION takes only rows not seen before, UNION ALL all. Each step's rows are held apart from the plan that made them, and
    all rows so far every ``most_parts`` steps, so plans stay short.
    """
    kind, step = cte.combinations[-1]
    if kind not in ("union", "union_all"):
        raise QueryError("a recursive CTE is an anchor united with a step")
    anchor = replace(cte, combinations=cte.combinations[:-1])
    fresh = lower(engine, anchor, parent, scope)
    fresh, _ = engine.held(fresh.distinct() if kind == "union" else fresh)
    seen = fresh
    for nth in range(1, most + 1):
        added = lower(engine, step, parent, scope | {name: fresh}).toDF(*seen.columns)
        added = added.select(*[F.col(quoted(f.name)).cast(f.dataType).alias(f.name) for f in seen.schema])
        if kind == "union":
            same = [F.col(quoted("new", c)).eqNullSafe(F.col(quoted("old", c))) for c in seen.columns]
            added = added.distinct().alias("new").join(seen.alias("old"), reduce(Column.__and__, same), "left_anti")
        fresh, more = engine.held(added)
        if not more:
            return seen
        seen = seen.union(fresh)
        if nth % most_parts == 0:
            seen, _ = engine.held(seen)
    raise QueryError(f"the recursive CTE {name!r} didn't end in {most} steps")
