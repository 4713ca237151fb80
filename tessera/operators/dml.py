"""Set-based writes as functions from tables to new tables: insert, update, delete and upsert.

Nothing is changed in place. Each function returns the table's new state and the rows it affected; ``publish`` puts the new states
of one or several stored tables in place of the old ones.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import ConstraintError, QueryError
from tessera.functions import types
from tessera.plans.expr import Lit, Param, wrap
from tessera.plans.lower import fold, joined, lower, quoted
from tessera.plans.query import Query, to_source
from tessera.plans.schema import Schema


@dataclass(frozen=True)
class Written:
    """The new state of the table, and the rows that were written or removed."""

    table: DataFrame
    affected: DataFrame
    source: str | None = None
    schema: Schema | None = None

    @property
    def count(self) -> int:
        return self.affected.count()

    def stored(self) -> DataFrame:
        """The new state under the table's own column names, values as they are stored."""
        if self.schema is None:
            return self.table
        out = []
        for c in self.table.columns:
            kind = self.schema.type_of(c) if c in self.schema.fields else "any"
            out.append(types.store(kind, F.col(quoted(c))).alias(self.schema.source_of(c)))
        return self.table.select(*out)


_ALLOWED = {"source", "name", "joins", "wheres", "ctes", "recursive", "updates", "prefix_", "names", "select_"}


def _guard(query: Query, what: str) -> None:
    blank = Query(query.source)
    extra = [k for k in Query.__dataclass_fields__ if k not in _ALLOWED and getattr(query, k) != getattr(blank, k)]
    if extra:
        raise QueryError(f"{what} allows with_cte, where and join only, not {extra}")
    if query.source.kind not in ("table", "frame"):
        raise QueryError(f"{what} needs a table")


def _prepared(engine, query: Query):
    """The joined sources, the condition, and the table itself with a row number to find its rows again."""
    from tessera.plans.lower import _cte, frame_of, Context

    scope: dict[str, DataFrame] = {}
    for name, cte, materialized, operation in query.ctes:
        scope[name] = _cte(engine, query, name, cte, materialized, operation, None, scope)
    base, _ = frame_of(engine, query.source, Context(engine, query, None, scope), query)
    return base, scope


def _key(query: Query, base: DataFrame) -> list[str]:
    schema = query.source.schema
    if schema is not None and schema.primary_key:
        return schema.primary_key
    raise QueryError("a write over a join needs a schema with a primary key")


def assignments(query: Query, ctx, base: DataFrame) -> dict[str, tuple[str, object]]:
    """field -> (operation, expression); each field once, and only fields that may be written."""
    out: dict[str, tuple[str, object]] = {}
    schema = query.source.schema
    for op, fields in query.updates:
        for k, v in query.resolve(fields).items():
            if k in out:
                raise QueryError(f"field {k!r} is updated twice")
            if schema is not None and k not in schema.updatable_fields:
                raise QueryError(f"field {k!r} of {schema.name} can't be updated")
            out[k] = (op, query.resolve(v))
    if not out:
        raise QueryError("update_all without updates")
    return out


def _value(ctx, query: Query, field: str, op: str, v, base: DataFrame):
    own = ctx.column(query.bindings[0], field)
    kind = base.schema[field].dataType
    schema_type = ctx.field_type(query.bindings[0], field)
    e = wrap(v)
    if isinstance(e, Lit) and query.source.schema is not None and field in query.source.schema.embeds:
        return nested(e.value, kind)
    if isinstance(e, (Lit, Param)) and schema_type != "any":
        inner = schema_type[1] if op in ("push", "pull") and isinstance(schema_type, tuple) else schema_type
        new = Lit(types.dump(inner, types.cast(inner, e.value))).build(ctx)
        new = types.load(inner, new) if isinstance(inner, types.CustomType) else new
    else:
        new = e.build(ctx)
    if op == "set":
        return new.cast(kind)
    if op == "inc":
        return (own + new).cast(kind)
    if op == "push":
        return F.array_append(own, new.cast(kind.elementType))
    return F.array_remove(own, new.cast(kind.elementType))


def nested(value, kind: T.DataType):
    """A record or a list of records as a column."""
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.StructType):
        held = [value.get(f.name) if isinstance(value, dict) else value[i] for i, f in enumerate(kind)]
        return F.struct(*[nested(v, f.dataType).alias(f.name) for v, f in zip(held, kind)])
    if isinstance(kind, T.ArrayType):
        return F.array(*[nested(v, kind.elementType) for v in value]).cast(kind)
    return F.lit(value).cast(kind)


def update_all(engine, query: Query) -> Written:
    """set, inc, push and pull on the rows that the query meets; with joins, each row is written once."""
    _guard(query, "update_all")
    base, scope = _prepared(engine, query)
    plain = replace(query, updates=(), select_=None)
    df, ctx = joined(engine, plain, None, scope)
    condition = fold(ctx, plain, plain.wheres)
    changes = assignments(query, ctx, base)
    columns = base.columns
    if not query.joins:
        hit = F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))
        values = {k: _value(ctx, query, k, op, v, base) for k, (op, v) in changes.items()}
        own = {c: ctx.column(query.bindings[0], c) for c in columns}
        marked = df.select(*[(F.when(hit, values[c]).otherwise(own[c]) if c in values else own[c]).alias(c) for c in columns], hit.alias("__hit"))
        return _of(query, marked.drop("__hit"), marked.where("__hit").drop("__hit"))
    key = _key(query, base)
    df = df if condition is None else df.where(condition)
    met = df.select(
        *[ctx.column(query.bindings[0], k).alias(f"__k_{k}") for k in key],
        *[_value(ctx, query, k, op, v, base).alias(f"__v_{k}") for k, (op, v) in changes.items()],
    ).dropDuplicates([f"__k_{k}" for k in key])
    met = met.withColumn("__hit", F.lit(True))
    same = reduce(lambda a, b: a & b, [base[k] == met[f"__k_{k}"] for k in key])
    wide = base.join(met, same, "left")
    hit = F.col("__hit").isNotNull()
    marked = wide.select(*[(F.when(hit, F.col(f"__v_{c}")).otherwise(F.col(quoted(c))) if c in changes else F.col(quoted(c))).alias(c) for c in columns], hit.alias("__hit"))
    return _of(query, marked.drop("__hit"), marked.where("__hit").drop("__hit"))


def _of(query: Query, table: DataFrame, affected: DataFrame) -> Written:
    return Written(table, affected, query.source.value if query.source.kind == "table" else None, query.source.schema)


def delete_all(engine, query: Query) -> Written:
    """Remove the rows that the query meets."""
    if query.updates:
        raise QueryError("delete_all takes no updates")
    _guard(query, "delete_all")
    base, scope = _prepared(engine, query)
    plain = replace(query, select_=None)
    df, ctx = joined(engine, plain, None, scope)
    condition = fold(ctx, plain, plain.wheres)
    own = [ctx.column(query.bindings[0], c).alias(c) for c in base.columns]
    if not query.joins:
        hit = F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))
        marked = df.select(*own, hit.alias("__hit"))
        return _of(query, marked.where("not __hit").drop("__hit"), marked.where("__hit").drop("__hit"))
    key = _key(query, base)
    met = (df if condition is None else df.where(condition)).select(*[c for c in own]).select(*key).distinct()
    return _of(query, base.join(met, key, "left_anti").select(*base.columns), base.join(met, key, "left_semi").select(*base.columns))


def insert_all(
    engine, table: DataFrame, rows, schema: Schema | None = None, on_conflict="raise", conflict_target: list[str] | tuple[str, str] | None = None, placeholders: dict | None = None,
    returning: bool | list[str] = True, replace_changed: bool = True, source: str | None = None,
) -> Written:
    """Insert rows (dicts, a DataFrame, or a query whose select names the columns).

    on_conflict: "raise", "nothing", "replace_all", ("replace", fields), ("replace_all_except", fields), or an update query on the
    table's own fields (set and inc; its where limits the rows). Of rows that repeat a key, "nothing" takes the first; otherwise
    they are an error. replace_changed: rows that a replacement wouldn't change don't count as affected. returning: the fields of
    the affected rows that are kept.
    """
    done = _insert_all(engine, table, rows, schema, on_conflict, conflict_target, placeholders, replace_changed)
    if returning is not True:
        done = replace(done, affected=done.affected.select(*[F.col(quoted(c)) for c in returning or []]))
    return replace(done, source=source, schema=schema)


def _insert_all(engine, table: DataFrame, rows, schema, on_conflict, conflict_target, placeholders, replace_changed) -> Written:
    if isinstance(rows, Query):
        if rows.select_ is None:
            raise QueryError("insert_all of a query needs a select")
        new = lower(engine, rows)
    elif isinstance(rows, DataFrame):
        new = rows
    else:
        held = [{k: _cell(engine, schema, k, v, placeholders or {}) for k, v in r.items()} for r in rows]
        if unknown := {k for r in held for k in r} - set(table.columns):
            raise QueryError(f"{sorted(unknown)} aren't columns of the table")
        custom = {k: f.type for k, f in schema.fields.items() if isinstance(f.type, types.CustomType)} if schema is not None else {}
        fields = [f for f in table.schema.fields if any(f.name in r for r in held) or not held]
        kind = T.StructType([T.StructField(f.name, types.spark_type(custom[f.name]) or f.dataType if f.name in custom else f.dataType) for f in fields])
        new = engine.spark.createDataFrame([tuple(r.get(f.name) for f in kind.fields) for r in held], kind)
        new = new.select(*[types.load(custom[c], F.col(quoted(c))).alias(c) if c in custom else F.col(quoted(c)) for c in new.columns])
    if unknown := set(new.columns) - set(table.columns):
        raise QueryError(f"{sorted(unknown)} aren't columns of the table")
    if schema is not None and (fixed := [c for c in new.columns if c in schema.fields and schema.fields[c].writable == "never"]):
        raise QueryError(f"{fixed} are never written")
    new = new.select(*[(F.col(quoted(f.name)) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema.fields])
    if isinstance(conflict_target, tuple):
        conflict_target = _constraint_fields(schema, *conflict_target)
    key = conflict_target or (schema.primary_key if schema is not None else [])
    if on_conflict == "raise" and conflict_target:
        raise QueryError("a conflict target needs an on_conflict other than raise")
    if not key:
        if on_conflict not in ("raise", "nothing"):
            raise QueryError("on_conflict needs a key: a conflict target or a primary key")
        return Written(table.union(new), new)
    full = reduce(lambda a, b: a & b, [F.col(quoted(k)).isNotNull() for k in key])
    if on_conflict == "nothing":
        # rows without a whole key are never alike
        nth = F.row_number().over(Window.partitionBy(*key).orderBy("__row"))
        new = new.withColumn("__row", F.monotonically_increasing_id()).withColumn("__nth", nth)
        new = new.where(~full | (F.col("__nth") == 1)).drop("__row", "__nth")
    elif not new.where(full).groupBy(*key).count().where("count > 1").isEmpty():
        raise ConstraintError(f"the new rows repeat a key {key}")
    met = new.join(table.select(*key), key, "left_semi")
    if on_conflict == "raise":
        if not met.isEmpty():
            name = f"{schema.source}_pkey" if schema is not None and key == schema.primary_key else None
            raise ConstraintError(f"key {key} is there already", met, kind="unique", name=name)
        _enforce(engine, schema, new, table)
        return Written(table.union(new), new)
    fresh = new.join(table.select(*key), key, "left_anti").select(*table.columns)
    _enforce(engine, schema, fresh, table)
    if on_conflict == "nothing":
        return Written(table.union(fresh), fresh)
    values = _replaced(engine, table, schema, key, on_conflict)
    both = table.alias("old").join(new.select(*[F.col(quoted(c)).alias(f"__n_{c}") for c in table.columns], F.lit(True).alias("__hit")),
        reduce(lambda a, b: a & b, [F.col(quoted("old", k)) == F.col(quoted(f"__n_{k}")) for k in key]), "left")
    hit = F.col("__hit").isNotNull()
    if values.get("__where") is not None:
        hit = hit & F.coalesce(values["__where"], F.lit(False))
    if replace_changed and not isinstance(on_conflict, Query):
        same = reduce(lambda a, b: a & b, [F.col(quoted("old", c)).eqNullSafe(v) for c, v in values.items()], F.lit(True))
        hit = hit & ~same
    changed = both.select(*[(F.when(hit, values[c]).otherwise(F.col(quoted("old", c))) if c in values else F.col(quoted("old", c))).alias(c) for c in table.columns], hit.alias("__hit"))
    return Written(changed.drop("__hit").union(fresh), changed.where("__hit").drop("__hit").union(fresh))


def _constraint_fields(schema: Schema | None, what: str, name: str) -> list[str]:
    """The fields of a named unique constraint, given as ("constraint", name)."""
    found = [c for c in schema.constraints if c.kind == "unique" and c.name == name] if schema is not None and what == "constraint" else []
    if not found:
        raise QueryError(f"{name!r} is no unique constraint of {schema.name if schema is not None else 'the table'}")
    return list(found[0].fields)


def _enforce(engine, schema: Schema | None, new: DataFrame, others: DataFrame) -> None:
    """The schema's constraints on new rows; ``others`` are the rows that stay."""
    if schema is not None and (broken := violations(engine, schema, new, others)):
        kind, name = broken[0]
        raise ConstraintError(f"constraint {name!r} ({kind}) is broken", kind=kind, name=name)


def violations(engine, schema: Schema, new: DataFrame, others: DataFrame) -> list[tuple[str, str]]:
    """(kind, name) of each of the schema's constraints that the new rows break, beside the others."""
    out = []
    for c in schema.constraints:
        fields = list(c.fields)
        full = reduce(lambda a, b: a & b, [F.col(quoted(k)).isNotNull() for k in fields], F.lit(True))
        own = new.where(full).select(*fields)
        if c.kind == "unique":
            broken = own.groupBy(*fields).count().where("count > 1").select(*fields).union(own.join(others.select(*fields), fields, "left_semi"))
        elif c.kind == "foreign_key":
            target = c.target()
            there = engine.lower(Query(to_source(target))).select(F.col(quoted(c.key or target.single_key())).alias(fields[0]))
            broken = own.join(there, fields, "left_anti")
        else:
            broken = new.where(~F.expr(c.condition))
        if not broken.isEmpty():
            out.append((c.kind, c.name))
    return out


def _cell(engine, schema, k, v, placeholders):
    if isinstance(v, tuple) and len(v) == 2 and v[0] == "placeholder":
        v = placeholders[v[1]]
    if isinstance(v, Query):
        found = lower(engine, v).limit(2).collect()
        if len(found) > 1:
            raise QueryError("a query for a value has one row")
        v = found[0][0] if found else None
    if schema is not None and k in schema.fields:
        return types.dump(schema.type_of(k), types.cast(schema.type_of(k), v))
    return v


def _replaced(engine, table: DataFrame, schema, key, on_conflict) -> dict:
    """column -> its value where a key is there already, from columns old.* and __n_*."""
    new = lambda c: F.col(quoted(f"__n_{c}"))
    allowed = set(schema.updatable_fields) if schema is not None else set(table.columns)
    if on_conflict == "replace_all":
        return {c: new(c) for c in table.columns if c in allowed and c not in key}
    if isinstance(on_conflict, tuple) and on_conflict[0] in ("replace", "replace_all_except"):
        fields = list(on_conflict[1])
        if unknown := set(fields) - set(table.columns):
            raise QueryError(f"{sorted(unknown)} aren't columns of the table")
        if on_conflict[0] == "replace":
            if not fields or not set(fields) <= allowed:
                raise QueryError("replace needs fields that can be updated")
            return {c: new(c) for c in fields}
        return {c: new(c) for c in table.columns if c in allowed and c not in fields and c not in key}
    if isinstance(on_conflict, Query):
        plain = replace(on_conflict, updates=())
        from tessera.plans.lower import Context

        ctx = Context(engine, plain, None, {})
        ctx.add(None, table, schema, False)
        ctx.aliases = ["old"]
        out = {k: _value(ctx, plain, k, op, v, table) for k, (op, v) in assignments(on_conflict, ctx, table).items()}
        out["__where"] = fold(ctx, plain, plain.wheres)
        return out
    raise QueryError(f"unknown on_conflict {on_conflict!r}")


class Folders:
    """Folders of any file system that Spark knows."""

    def __init__(self, spark):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        at = self._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self._conf), at

    def exists(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def delete(self, path: str) -> None:
        fs, at = self._at(path)
        fs.delete(at, True)

    def rename(self, a: str, b: str) -> bool:
        fs, at = self._at(a)
        return fs.rename(at, self._at(b)[1])


def publish(df: DataFrame, path: str) -> None:
    """Put a table's new state in place of the stored one."""
    publish_all(df.sparkSession, {path: df})


def publish_all(spark, tables: dict[str, DataFrame]) -> None:
    """Put new states in place of stored tables: all or none.

    All new states are written beside the old ones first, so one may be computed from the other. Then the folders are renamed; if a
    rename fails, those done are undone. The old folders are deleted last. While a folder is swapped, for the time between
    two renames, a reader finds no table there.
    """
    folders = Folders(spark)
    mark = uuid.uuid4().hex
    fresh = {path: f"{path}.new-{mark}" for path in tables}
    old = {path: f"{path}.old-{mark}" for path in tables}
    done: list[tuple[str, str]] = []

    def rename(a: str, b: str) -> None:
        if not folders.rename(a, b):
            raise OSError(f"{a} can't be renamed to {b}")
        done.append((a, b))

    try:
        for path, df in tables.items():
            df.write.parquet(fresh[path])
        for path in tables:
            if folders.exists(path):
                rename(path, old[path])
            rename(fresh[path], path)
    except Exception:
        for a, b in reversed(done):
            folders.rename(b, a)
        for path in tables:
            folders.delete(fresh[path])
        raise
    for path in tables:
        folders.delete(old[path])
        spark.catalog.refreshByPath(path)
