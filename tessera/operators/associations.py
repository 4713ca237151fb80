"""Associations: as joins, as queries for related rows, and preloaded as nested columns."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import QueryError
from tessera.plans.expr import Compare, Expr, Fragment, Logic, Ref, ordered, wrap
from tessera.plans.query import Binding, Join, Query, SubQuery, from_, to_query, to_source
from tessera.plans.schema import Assoc, Schema
from tessera.plans.windows import orders


def keys(owner: Schema, name: str) -> tuple[Assoc, Schema, str, str]:
    """The association, its schema, and the owner's and the related key (not for many_to_many and through)."""
    if name not in owner.assocs:
        raise QueryError(f"{owner.name} has no association {name!r}")
    a = owner.assocs[name]
    if a.through:
        at = owner
        for step in a.through:
            at = keys(at, step)[1]
        return a, at, "", ""
    target = a.target()
    if a.kind == "belongs_to":
        return a, target, a.owner_key or f"{name}_id", a.related_key or target.single_key()
    own = a.owner_key or owner.single_key()
    return a, target, own, a.related_key or f"{owner.name.lower()}_id"


def conditions(binding: Binding, where: dict) -> Expr | None:
    """equal, null (None), ("not", None), ("in", list) and ("fragment", sql) conditions of an association."""
    out = None
    for k, v in where.items():
        field = Ref(binding, k)
        if v is None:
            e = field.is_nil()
        elif isinstance(v, tuple) and v[0] == "not":
            e = ~field.is_nil() if v[1] is None else field != v[1]
        elif isinstance(v, tuple) and v[0] == "in":
            e = field.in_(v[1])
        elif isinstance(v, tuple) and v[0] == "fragment":
            e = Fragment(v[1], (field,))
        else:
            e = field == v
        out = e if out is None else Logic("and", out, e)
    return out


def _and(*parts):
    out = None
    for p in parts:
        if p is not None:
            out = p if out is None else Logic("and", out, p)
    return out


def _steps(owner: Schema, name: str) -> list[tuple[Schema, str]]:
    """A chain of plain associations; a through association is its parts' chains."""
    a, *_ = keys(owner, name)
    if not a.through:
        return [(owner, name)]
    out, at = [], owner
    for step in a.through:
        out += _steps(at, step)
        at = keys(at, step)[1]
    return out


def expand(query: Query) -> Query:
    """Each join over an association becomes joins with conditions; bindings added between get no place of their own.

    The last join of a chain keeps the association's place, so functions of bindings see what they name.
    """
    schemas: list[Schema | None] = [query.source.schema]
    joins: list[Join] = []
    for j in query.joins:
        if j.source.kind != "assoc":
            joins.append(j)
            schemas.append(j.source.schema)
            continue
        owner_index, name = j.assoc
        owner = schemas[owner_index]
        if owner is None:
            raise QueryError("a join over an association needs a schema")
        chain = _steps(owner, name)
        target = keys(owner, name)[1]
        joins.append(replace(j, source=_related(chain, j), on=_on(owner_index, len(schemas), owner, chain, j.on, query)))
        schemas.append(target)
    return replace(query, joins=tuple(joins))


def _related(chain, j: Join):
    """The source for the far end of a chain: the target itself, or the steps before joined to it with the owner's key."""
    owner, name = chain[0]
    a, target, _, _ = keys(owner, name)
    if len(chain) == 1 and a.kind != "many_to_many":
        return to_source(target)
    return to_source(SubQuery(related_rows(chain)))


OWNER = "__owner_key"


def related_rows(chain) -> Query:
    """Rows at the end of a chain, each with the key of the owner it belongs to; the owner's table itself is not read."""
    owner, name = chain[0]
    a, target, own, theirs = keys(owner, name)
    if a.kind == "many_to_many":
        mine, yours = a.join_keys
        q = from_(a.join_through, as_="via").join(
            target, on=lambda via, t: Compare("==", via[yours], t[target.single_key()])
        )
        condition = conditions(Binding(0, None), a.join_where)
        q = q.where(condition) if condition is not None else q
        key, at = Ref(Binding(0, None), mine), 1
    else:
        q, key, at = from_(target), Ref(Binding(0, None), theirs), 0
    extra = conditions(Binding(at, None), a.where)
    q = q.where(extra) if extra is not None else q
    schema = target
    for step_owner, step in chain[1:]:
        b, schema, step_own, step_theirs = keys(step_owner, step)
        if b.kind == "many_to_many":
            mine, yours = b.join_keys
            here = at
            q = q.join(b.join_through, on=lambda *bs: Compare("==", bs[here][step_owner.single_key()], bs[-1][mine]))
            via = len(q.joins)
            q = q.join(schema, on=lambda *bs: Compare("==", bs[via][yours], bs[-1][schema.single_key()]))
        else:
            here = at
            q = _chain_join(q, schema, here, step_own, step_theirs)
        at = len(q.joins)
        extra = conditions(Binding(at, None), b.where)
        q = q.where(extra) if extra is not None else q
    end = Binding(at, None)
    fields = {k: Ref(end, k) for k in schema.query_fields}
    q = q.select(fields | {OWNER: key})
    return q.distinct() if len(chain) > 1 else q


def _chain_join(q: Query, schema: Schema, here: int, own: str, theirs: str) -> Query:
    there = len(q.joins) + 1
    return q.join(schema, on=lambda *bs: Compare("==", bs[here][own], bs[there][theirs]))


def _on(owner_index: int, place: int, owner: Schema, chain, extra, query: Query):
    first_owner, name = chain[0]
    a, _, own, theirs = keys(first_owner, name)

    def on(*bindings):
        mine, there = bindings[owner_index], bindings[place]
        if len(chain) == 1 and a.kind != "many_to_many":
            out = Compare("==", mine[own], there[theirs])
            out = _and(out, conditions(there, a.where))
        else:
            out = Compare("==", mine[own or owner.single_key()], there[OWNER])
        return _and(out, wrap(query.resolve(extra)) if extra is not None else None)

    return on


def assoc_query(engine, rows: DataFrame, owner: Schema, path: list[str] | str) -> DataFrame:
    """The distinct rows that are associated with ``rows`` over a path."""
    path = [path] if isinstance(path, str) else path
    chain, at = [], owner
    for name in path:
        chain += _steps(at, name)
        at = keys(at, name)[1]
    related = engine.all(related_rows(chain))
    own = keys(*chain[0])[2] or chain[0][0].single_key()
    ids = rows.select(F.col(own).alias(OWNER)).where(F.col(OWNER).isNotNull()).distinct()
    return related.join(ids, OWNER, "left_semi").drop(OWNER).distinct()


def build_assoc(owner: Schema, record: dict, name: str, values: dict | None = None) -> dict:
    """A new related record with what ties it to its owner."""
    a, target, own, theirs = keys(owner, name)
    if a.through:
        raise QueryError("a record can't be built through another association")
    plain = {k: v for k, v in a.where.items() if v is not None and not isinstance(v, tuple)}
    tied = {theirs: record[own]} if a.kind in ("has_many", "has_one") else {}
    return {k: f.default for k, f in target.fields.items()} | plain | (values or {}) | tied


def assoc_loaded(record, name: str) -> bool:
    """Whether the association is there, be it empty."""
    return name in (record.asDict() if hasattr(record, "asDict") else record)


def joined_preloads(engine, query: Query, functions) -> DataFrame:
    """Rows with associations taken from the query's own joins: {name: binding} or {name: (binding, {name: ...})}.

    Each record is one column first; records further in are gathered for each record that they belong to.
    """
    if query.select_ is not None:
        raise QueryError("a preload from a join goes with a select of the source itself")
    tree: dict = {}
    for f in functions:
        tree |= query.resolve(f)
    places: dict[str, tuple] = {}

    def walk(schema: Schema, wanted: dict, path: str):
        out = []
        for name, to in wanted.items():
            binding, below = to if isinstance(to, tuple) else (to, {})
            a, target, *_ = keys(schema, name)
            own = f"{path}__{name}"
            places[own] = binding
            out.append((own, name, a.many, walk(target, below, own)))
        return out

    nodes = walk(query.source.schema, tree, "__in")
    orders_, bare = query.order_bys, replace(query, order_bys=())
    df = engine.lower(bare.select({"__row": query.bindings[0]} | places))

    def gather(df: DataFrame, node) -> DataFrame:
        own, _, many, below = node
        for child in below:
            df = gather(df, child)
        if below:
            inner = [F.col(f"`{own}`.`{f.name}`") for f in df.schema[own].dataType.fields] + [F.col(c[0]).alias(c[1]) for c in below]
            df = df.withColumn(own, F.when(F.col(own).isNotNull(), F.struct(*inner))).drop(*[c[0] for c in below])
        rest = [c for c in df.columns if c != own]
        found = F.sort_array(F.collect_set(own)) if many else F.any_value(own, True)
        return df.groupBy(*[F.col(f"`{c}`") for c in rest]).agg(found.alias(own))

    for node in nodes:
        df = gather(df, node)
    out = df.select("__row.*", *[F.col(own).alias(name) for own, name, _, _ in nodes])
    if orders_:
        terms = [o for part in orders_ for o in orders(query._fields(query.resolve(part)))]
        if any(not isinstance(o.expr, Ref) or o.expr.binding._index for o in terms):
            raise QueryError("rows with preloads from joins are ordered by the source's own fields")
        out = out.orderBy(*[ordered(F.col(f"`{o.expr.name}`"), o.direction) for o in terms])
    return out


def preload(engine, rows: DataFrame, owner: Schema, wanted) -> DataFrame:
    """``rows`` with a nested column for each association: a list of records, or one.

    wanted: names, or (name, x) pairs where x is a nested preload (name, list or dict), a query for the related rows,
    or a function from the owners' distinct keys (a DataFrame) to related rows that hold the related key.
    """
    for item in _pairs(wanted):
        rows = _preload_one(engine, rows, owner, *item)
    return rows


def preload_pairs(wanted):
    """(name, how) of what is to be preloaded."""
    return _pairs(wanted if not isinstance(wanted, tuple) else [wanted])


def _pairs(wanted):
    if isinstance(wanted, str):
        return [(wanted, None)]
    if isinstance(wanted, dict):
        return list(wanted.items())
    return [w if isinstance(w, tuple) else (w, None) for w in wanted]


def _preload_one(engine, rows: DataFrame, owner: Schema, name: str, how) -> DataFrame:
    chain = _steps(owner, name)
    a, target, own, theirs = keys(owner, name)
    plain = len(chain) == 1 and a.kind != "many_to_many"
    own = own or keys(*chain[0])[2] or owner.single_key()
    if own not in rows.columns:
        raise QueryError(f"preload of {name!r} needs {own!r} in the rows")
    nested, query, order = None, None, list(a.preload_order)
    if isinstance(how, Query) or hasattr(how, "query"):
        query = to_query(how)
        nested, query = query.preloads, replace(query, preloads=())
        order = [] if query.order_bys else order
    elif callable(how):
        ids = rows.select(F.col(own)).where(F.col(own).isNotNull()).distinct()
        related = how(ids).withColumn(OWNER, F.col(theirs))
    elif how is not None:
        nested = how
    if not (callable(how) and query is None):
        if plain:
            q = query if query is not None else from_(target)
            extra = conditions(q.bindings[0], a.where)
            q = q.where(extra) if extra is not None else q
            related = engine.lower(q).withColumn(OWNER, F.col(theirs))
        else:
            related = engine.lower(related_rows(chain))
            if query is not None:
                key = target.single_key()
                related = related.join(engine.lower(query).select(key), key, "left_semi")
    if nested:
        related = preload(engine, related.withColumnRenamed(OWNER, "__outer_key"), target, nested)
        related = related.withColumnRenamed("__outer_key", OWNER)
    record = F.struct(*[F.col(c) for c in related.columns if c != OWNER])
    many = a.kind in ("has_many", "many_to_many")
    keyed = related.select(OWNER, record.alias("__record"))
    pair = F.struct(F.col("__record"))
    if many:
        by = [(o.expr.value if hasattr(o.expr, "value") else o.expr.name, o.direction) for o in (orders(order) if order else [])]
        listed = F.collect_list(pair)
        lists = keyed.groupBy(OWNER).agg((F.array_sort(listed, _comparing(by)) if by else F.sort_array(listed)).alias("__list"))
        lists = lists.select(OWNER, F.transform("__list", lambda x: x["__record"]).alias(name))
        out = rows.join(lists, rows[own] == lists[OWNER], "left").drop(OWNER)
        empty = F.array().cast(lists.schema[name].dataType)
        return out.withColumn(name, F.coalesce(F.col(name), empty))
    one = keyed.groupBy(OWNER).agg(F.min(pair).alias("__one")).select(OWNER, F.col("__one.__record").alias(name))
    return rows.join(one, rows[own] == one[OWNER], "left").drop(OWNER)


def _comparing(by):
    """Compares two records by fields and directions: nulls last when rising, first when falling, unless said otherwise."""

    def one(a, b, name: str, direction: str):
        x, y = a["__record"][name], b["__record"][name]
        nulls = -1 if direction in ("desc", "desc_nulls_first", "asc_nulls_first") else 1
        less = 1 if direction.startswith("desc") else -1
        return (
            F.when(x.isNull() & y.isNull(), 0).when(x.isNull(), nulls).when(y.isNull(), -nulls)
            .when(x < y, less).when(x > y, -less).otherwise(0)
        )

    def compare(a, b):
        out = F.when(a["__record"] < b["__record"], -1).when(a["__record"] > b["__record"], 1).otherwise(0)
        for name, direction in reversed(by):
            found = one(a, b, name, direction)
            out = F.when(found != 0, found).otherwise(out)
        return out

    return compare
