"""The engine: where tables come from, and the operations that run a query."""

from __future__ import annotations

import copy
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import MultiplePrimaryKeyError, MultipleResultsError, NoPrimaryKeyValueError, NoResultsError, QueryError, StaleEntryError
from tessera.functions import types
from tessera.operators import dml
from tessera.operators.persist import Saved, as_change, save
from tessera.operators.record import RecordChange
from tessera.plans.expr import Aggregate, Ref, wrap
from tessera.plans.lower import lower, quoted, typed
from tessera.plans.query import Query, SubQuery, from_, to_query
from tessera.plans.schema import Schema


class Engine:
    """Runs queries over named tables.

    tables: a function from a name to a DataFrame, or a dict of DataFrames; names not found there are asked of the catalog.
    prepare: a hook that may change each query before it runs (a tenant's filter, say).
    default_options: a hook from an operation's name to options that calls without them get.
    prepare_transaction: a hook that may change named steps and their options before they run.
    states: tables as earlier writes have left them; they go before all others.
    """

    schemaless_merge = True

    def __init__(
        self, spark: SparkSession, tables: Callable[[str], DataFrame | None] | dict | None = None, prepare: Callable[[str, Query], Query] | None = None,
        default_options: Callable[[str], dict] | None = None, prepare_transaction: Callable | None = None,
    ):
        self.spark, self.prepare = spark, prepare
        self.default_options, self.prepare_transaction = default_options, prepare_transaction
        self._tables = tables.get if isinstance(tables, dict) else tables
        self.states: dict[str, DataFrame] = {}

    def overlay(self) -> Engine:
        """The same engine, whose writes are seen by itself only."""
        out = copy.copy(self)
        out.states = dict(self.states)
        return out

    def _options(self, operation: str, given: dict) -> dict:
        return (self.default_options(operation) if self.default_options else {}) | given

    # tables

    def table(self, name: str, prefix: str | None = None) -> DataFrame:
        if prefix is None and name in self.states:
            return self.states[name]
        if prefix is None and self._tables is not None:
            found = self._tables(name)
            if found is not None:
                return found
        return self.spark.table(quoted(prefix, name) if prefix else quoted(name))

    def sql(self, text: str, views: dict[str, DataFrame]) -> DataFrame:
        """SQL over these tables, which have these names in this statement only."""
        used = {n: df for n, df in views.items() if n.lower() in text.lower()}
        if not used:
            return self.spark.sql(text)
        mark = uuid.uuid4().hex
        held = {name: f"tessera_{mark}_{i}" for i, name in enumerate(used)}
        try:
            for name, df in used.items():
                df.createTempView(held[name])
            ctes = ", ".join(f"{quoted(n)} AS (SELECT * FROM {v})" for n, v in held.items())
            return self.spark.sql(f"WITH {ctes} SELECT * FROM ({text})")
        finally:
            for view in held.values():
                self.spark.catalog.dropTempView(view)

    #: Results of up to so many rows are held on the driver between steps of a recursion.
    LOCAL_ROWS = 10_000

    def held(self, df: DataFrame) -> tuple[DataFrame, bool]:
        """A result that doesn't depend on its plan any more, and whether it has rows: few rows locally, others staged."""
        few = df.limit(self.LOCAL_ROWS + 1).toArrow()
        if few.num_rows <= self.LOCAL_ROWS:
            return self.spark.createDataFrame(few, df.schema), few.num_rows > 0
        return self.staged(df), True

    def staged(self, df: DataFrame) -> DataFrame:
        """Written to the cluster's shared folder and read back; a folder of our own only on one machine where none is set."""
        folder = self.spark.conf.get("spark.checkpoint.dir", None)
        sc = self.spark.sparkContext
        if not folder:
            held = sc._jsc.sc().getCheckpointDir()
            if held.isDefined():
                folder = held.get()
            elif sc.master.startswith("local-") or not sc.master.startswith("local"):
                raise QueryError("set spark.checkpoint.dir to a folder that the cluster shares")
            else:
                folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
                sc.setCheckpointDir(folder)
        path = f"{folder.rstrip('/')}/staged/query-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    # running

    def lower(self, query, operation: str = "all") -> DataFrame:
        q = to_query(query)
        if self.prepare is not None:
            q = self.prepare(operation, q)
        return lower(self, q)

    def all(self, query) -> DataFrame:
        """The query's rows as a DataFrame, with its preloads."""
        from tessera.operators.associations import joined_preloads, preload

        q = to_query(query)
        if q.preloads and q.source.schema is None:
            raise QueryError("a preload needs a schema")
        over = [p for p in q.preloads if callable(p) and not isinstance(p, tuple)]
        apart = tuple(p for p in q.preloads if not callable(p) or isinstance(p, tuple))
        if over:
            q = self.prepare("all", q) if self.prepare else q
            df = joined_preloads(self, replace(q, preloads=()), over)
        else:
            df = self.lower(replace(q, preloads=()))
        return preload(self, df, q.source.schema, apart) if apart else df

    def preload(self, rows: DataFrame, schema: Schema, *wanted, force: bool = False) -> DataFrame:
        """Rows with associations; those there already stay as they are, unless forced."""
        from tessera.operators.associations import preload_pairs, preload

        pairs = [p for w in wanted for p in preload_pairs(w)]
        if force:
            rows = rows.drop(*[name for name, _ in pairs])
        return preload(self, rows, schema, [(name, how) for name, how in pairs if name not in rows.columns])

    def all_by(self, query, **equal) -> DataFrame:
        return self.all(to_query(query).where(**equal))

    def one(self, query) -> Row | None:
        found = self.all(query).limit(2).collect()
        if len(found) > 1:
            raise MultipleResultsError("expected one row at most, there are more")
        return found[0] if found else None

    def one_or_fail(self, query) -> Row:
        found = self.one(query)
        if found is None:
            raise NoResultsError("expected a row, there is none")
        return found

    def get(self, schema: Schema, key) -> Row | None:
        if key is None:
            raise NoPrimaryKeyValueError("get needs a key's value")
        return self.one(from_(schema).where(**{schema.single_key(): key}))

    def get_or_fail(self, schema: Schema, key) -> Row:
        found = self.get(schema, key)
        if found is None:
            raise NoResultsError(f"no {schema.name} with key {key!r}")
        return found

    def get_by(self, query, **equal) -> Row | None:
        return self.one(to_query(query).where(**equal))

    def get_by_or_fail(self, query, **equal) -> Row:
        return self.one_or_fail(to_query(query).where(**equal))

    def exists(self, query) -> bool:
        q = to_query(query).exclude("select", "preload", "order_by", "distinct")
        return not self.lower(replace(q, select_={"one": wrap(1)}).limit(1) if not q.group_bys else q).limit(1).isEmpty()

    def aggregate(self, query, kind: str = "count", field: str | None = None):
        """One value over the query's rows; limits, offsets, distinct and combinations are applied first."""
        return self.aggregate_frame(query, kind, field).first()[0]

    def aggregate_frame(self, query, kind: str = "count", field: str | None = None) -> DataFrame:
        q = to_query(query)
        if q.group_bys:
            raise QueryError("aggregate of a grouped query isn't defined")
        if kind not in ("count", "sum", "avg", "min", "max") or field is None and kind != "count":
            raise QueryError(f"aggregate {kind!r} of {field!r} isn't defined")
        whole = q.limit_ is not None or q.offset_ is not None or q.distinct_ is not None or q.combinations
        q = q.exclude("preload")
        if whole:
            if q.select_ is None and field is not None and q.source.schema is None:
                q = q.select([field])
            q = from_(SubQuery(q))
        else:
            q = q.exclude("order_by", "select")
        target = None if field is None else Ref(q.bindings[0], field)
        return self.lower(q.select({"value": Aggregate(kind, target)}))

    def stream(self, query) -> Iterator[Row]:
        """The rows one by one, a partition at a time."""
        if to_query(query).preloads:
            raise QueryError("a stream has no preloads")
        return self.lower(query).toLocalIterator(prefetchPartitions=True)

    def reload(self, schema: Schema, rows: DataFrame, strict: bool = False) -> DataFrame:
        """Fetch rows again by key, in the order given (column __order); missing ones are null, or an error."""
        key = schema.single_key()
        ids = rows.select(F.col(key).alias("__key"), F.monotonically_increasing_id().alias("__order"))
        fresh = self.all(schema)
        record = F.struct(*[F.col(c) for c in fresh.columns])
        fresh = fresh.select(F.col(key).alias("__key"), record.alias("record"))
        out = ids.join(fresh, "__key", "left").select("__order", "record")
        if strict and not out.where(F.col("record").isNull()).isEmpty():
            raise NoResultsError("some rows aren't there any more")
        return out.orderBy("__order")

    def load(self, schema: Schema, df: DataFrame) -> DataFrame:
        """Raw rows as typed records: columns by field or column name, cast and loaded."""
        have, out = set(df.columns), []
        for k in schema.stored_fields:
            name = schema.source_of(k) if schema.source_of(k) in have else k
            if name in have:
                out.append(types.load(schema.type_of(k), F.col(quoted(name))).alias(k))
        return df.select(*out)

    # writing

    def insert_all(self, target, rows, **options) -> dml.Written:
        schema = target if isinstance(target, Schema) else None
        table = typed(self.table(schema.source, schema.prefix), schema) if schema is not None else self.table(target)
        options = self._options("insert_all", options)
        return dml.insert_all(self, table, rows, schema, source=schema.source if schema is not None else target, **options)

    def update_all(self, query) -> dml.Written:
        q = to_query(query)
        return dml.update_all(self, self.prepare("update_all", q) if self.prepare else q)

    def delete_all(self, query) -> dml.Written:
        q = to_query(query)
        return dml.delete_all(self, self.prepare("delete_all", q) if self.prepare else q)

    def insert(self, record, **options) -> Saved:
        """One record: a change, or (schema, dict)."""
        return save(self, "insert", as_change(record), **self._options("insert", options))

    def insert_or_update(self, change: RecordChange, **options) -> Saved:
        """By the record's state."""
        return save(self, "insert_or_update", change, **self._options("insert_or_update", options))

    def update(self, schema: Schema | RecordChange, key=None, changes: dict | None = None, lock: tuple[str, int] | None = None, allow_stale: bool = False, force: bool = False):
        """A change to a record; or one row by key, with an optimistic lock (field, value), which is raised by one."""
        if isinstance(schema, RecordChange):
            return save(self, "update", schema, allow_stale=allow_stale, force=force)
        q = from_(schema).where(**{schema.single_key(): key})
        if lock is not None:
            q = q.where(**{lock[0]: lock[1]})
            changes = changes | {lock[0]: lock[1] + 1}
        done = self.update_all(q.update(set=changes))
        return self._met(done, allow_stale)

    def delete(self, schema: Schema | RecordChange, key=None, allow_stale: bool = False):
        """A record, with what its associations say of theirs; or one row by key."""
        if isinstance(schema, RecordChange):
            return save(self, "delete", schema, allow_stale=allow_stale)
        return self._met(self.delete_all(from_(schema).where(**{schema.single_key(): key})), allow_stale)

    def _met(self, done: dml.Written, allow_stale: bool) -> dml.Written:
        n = len(done.affected.limit(2).collect())
        if n > 1:
            raise MultiplePrimaryKeyError("several rows have that key")
        if n == 0 and not allow_stale:
            raise StaleEntryError("the row isn't there, or isn't as it was")
        return done

    # storage

    def storage_up(self, name: str) -> bool:
        """Create a database; False if it is there."""
        if self.spark.catalog.databaseExists(name):
            return False
        self.spark.sql(f"CREATE DATABASE {quoted(name)}")
        return True

    def storage_down(self, name: str) -> bool:
        if not self.spark.catalog.databaseExists(name):
            return False
        self.spark.sql(f"DROP DATABASE {quoted(name)} CASCADE")
        return True

    def storage_status(self, name: str) -> str:
        return "up" if self.spark.catalog.databaseExists(name) else "down"

    def transact(self, multi, paths: dict[str, str] | None = None, **options):
        """Named steps; see ``Multi.transact``."""
        options = self._options("transact", options)
        if self.prepare_transaction is not None:
            multi, options = self.prepare_transaction(multi, options)
        return multi.transact(self, paths, **options)

    def values_frame(self, rows: list[dict], schema: T.StructType) -> DataFrame:
        return self.spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)
