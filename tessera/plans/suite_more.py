"""More registered queries: sources, writes, single records, terminals, validation, windows and what else the first suite leaves out."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from tessera import (
    Changeset, Embed, Engine, Field, Multi, RecordChange, Schema, assoc, belongs_to, change, check, foreign_key as fkey, from_, has_many, many_to_many, subquery, unique,
    values,
)
from tessera.errors import ConstraintError, NoResultsError, QueryError, StaleEntryError
from tessera.functions import types
from tessera.plans import expr as e
from tessera.plans.expr import asc, avg, count, datetime_add, desc, fragment, max_, min_, parent_as, sum_, type_, wrap
from tessera.plans.suite import CUSTOMER, NATION, ORDER, PART, REGION, query, subquery_value


def table(engine, rows: list[tuple], schema: str):
    return engine.spark.createDataFrame(rows, schema)


def raises(error, function) -> bool:
    try:
        function()
    except error:
        return True
    return False


# sources


@query("fragment_schema", "SELECT CAST(i AS BIGINT) AS id, CAST(i AS BIGINT) AS twice FROM generate_series(3, 8) t(i)")
def _(engine):
    series = Schema("Series", None, {"id": Field("integer", primary_key=True), "twice": "integer"})
    return from_((fragment("SELECT id, id AS twice FROM range(?, ?)", 3, 9), series))


@query("prefixed_table", "SELECT r_name AS name FROM region")
def _(engine):
    engine.table("region").createOrReplaceGlobalTempView("tessera_region")
    return from_("tessera_region", prefix="global_temp").select(lambda r: {"name": r.r_name})


@query("sampled_table", "SELECT true AS near_a_tenth, count(*) AS whole FROM lineitem")
def _(engine):
    part = from_("lineitem", hints=["TABLESAMPLE(10, 7)"]).select({"n": count()})
    whole = from_("lineitem").select({"n": count()})
    return from_(subquery(part), as_="p").cross_join(subquery(whole)).select(lambda p, w: {"near_a_tenth": (p.n * 12 > w.n) & (p.n * 8 < w.n), "whole": w.n})


@query("cte_of_fragment", "WITH big AS (SELECT l_orderkey AS k FROM lineitem WHERE l_quantity > 48.5) SELECT k, count(*) AS n FROM big GROUP BY k")
def _(engine):
    engine.spark.range(1).createOrReplaceTempView("big")
    items = from_("lineitem").select(["l_orderkey", "l_quantity"])
    q = from_("big").with_cte("items", items).with_cte("big", fragment("SELECT l_orderkey AS k FROM items WHERE l_quantity > ?", 48.5))
    return q.group_by(lambda b: b.k).select(lambda b: {"k": b.k, "n": count()})


@query("cte_materialized", "WITH t AS (SELECT o_custkey AS c, sum(o_totalprice) AS v FROM orders GROUP BY 1) SELECT a.c, round(a.v, 2) AS v FROM t a JOIN t b ON a.c = b.c WHERE b.v > 1000000")
def _(engine):
    total = from_("orders").group_by(lambda o: o.o_custkey).select(lambda o: {"c": o.o_custkey, "v": sum_(o.o_totalprice)})
    q = from_("t", as_="a").with_cte("t", total, materialized=True).join("t", as_="b", on=lambda a, b: a.c == b.c)
    return q.where(lambda *, b: b.v > 1000000).select(lambda a: {"c": a.c, "v": fragment("round(?, 2)", a.v)})


@query("cte_writing", "SELECT p_partkey AS k, p_size AS s FROM part WHERE p_size > 45")
def _(engine):
    gone = from_(PART).where(lambda p: p.p_size > 45)
    return from_("gone").with_cte("gone", gone, operation="delete_all").select(lambda g: {"k": g.p_partkey, "s": g.p_size})


# select


@query("select_nested_fields", "SELECT c_custkey AS id, n_name AS nation, n_regionkey AS region FROM customer JOIN nation ON n_nationkey = c_nationkey")
def _(engine):
    q = from_(CUSTOMER, as_="c").join(lambda c: assoc(c, "nation"), as_="n").select(lambda c, n: {"id": c.id, "n": e.struct(n, ["name", "region_id"])})
    return engine.all(q).select("id", F.col("n.name").alias("nation"), F.col("n.region_id").alias("region"))


@query("select_record", "SELECT s_name AS name, s_suppkey AS id, 'new' AS state, NULL::DOUBLE AS score FROM supplier")
def _(engine):
    made = Schema("Made", None, {"id": "integer", "name": "string", "state": Field("string", default="new"), "score": Field("float", virtual=True)})
    return from_("supplier").select(lambda s: e.record(made, id=s.s_suppkey, name=s.s_name))


@query("select_keys_from_data", "SELECT k, v FROM (SELECT unnest([n_name, 'region']) AS k, unnest([n_nationkey, n_regionkey]) AS v FROM nation)")
def _(engine):
    q = from_("nation").select(lambda n: {n.n_name: n.n_nationkey, "region": n.n_regionkey})
    return engine.all(q).select(F.explode("value").alias("k", "v"))


@query("scalar_subquery_where", "SELECT o_orderkey AS k FROM orders o WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders i WHERE i.o_custkey = o.o_custkey)")
def _(engine):
    mean = from_("orders").where(lambda i: i.o_custkey == parent_as("o").o_custkey).select(lambda i: {"m": fragment("avg(?) * 1.5", i.o_totalprice, aggregate=True)})
    return from_("orders", as_="o").where(lambda o: o.o_totalprice > subquery_value(mean)).select(lambda o: {"k": o.o_orderkey})


@query("virtual_fields", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def _(engine):
    held = Schema("Held", "nation", {"id": Field("integer", source="n_nationkey", primary_key=True), "name": Field("string", source="n_name"), "note": Field("string", virtual=True), "region_id": Field("integer", source="n_regionkey", load_in_query=False)})
    return from_(held)


@query("filter_like_ilike", "SELECT p_partkey AS k FROM part WHERE p_name LIKE '%ring%' AND p_type ILIKE '%econ%'")
def _(engine):
    return from_("part").where(lambda p: p.p_name.like("%ring%") & p.p_type.ilike("%econ%")).select(lambda p: {"k": p.p_partkey})


@query("named_bindings", "SELECT o_orderkey AS k, n_name AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2")
def _(engine):
    base = from_(ORDER, as_="o").with_named_binding("c", lambda q: q.join(CUSTOMER, as_="c", on=lambda o, c: o.customer_id == c.id))
    both = base.with_named_binding("c", lambda q: q).with_named_binding("n", lambda q: q.join(NATION, as_="n", on=lambda *, c, n: c.nation_id == n.id))
    return both.where(lambda *, n: n.region_id == 2).select(lambda o, *, n: {"k": o.id, "n": n.name})


@query("exclude_parts", "SELECT p_partkey AS k FROM part WHERE p_size = 9")
def _(engine):
    q = from_("part").where(p_size=7).limit(3).order_by("p_size").distinct().select(["p_name"])
    return q.exclude("where", "limit", "order_by", "distinct", "select").where(p_size=9).select(lambda p: {"k": p.p_partkey})


@query("join_keywords", "SELECT o_orderkey AS k FROM orders JOIN customer ON c_custkey = o_custkey AND c_mktsegment = 'BUILDING'")
def _(engine):
    q = from_("orders").join("customer", on=lambda o, c: {"c_custkey": o.o_custkey, "c_mktsegment": "BUILDING"})
    return q.select(lambda o: {"k": o.o_orderkey})


@query("order_prepended", "SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderpriority DESC, o_orderkey) AS nth FROM orders")
def _(engine):
    q = from_("orders").order_by("o_orderkey").prepend_order_by(lambda o: desc(o.o_orderpriority)).select(lambda o: {"k": o.o_orderkey})
    rows = engine.all(q.select_merge(lambda o: {"nth": e.row_number().over(order_by=[desc(o.o_orderpriority), asc(o.o_orderkey)])}))
    return rows


@query("order_prepended_first", "SELECT o_orderkey AS k FROM orders ORDER BY o_orderpriority DESC, o_orderkey LIMIT 9")
def _(engine):
    return from_("orders").order_by("o_orderkey").prepend_order_by(lambda o: desc(o.o_orderpriority)).limit(9).select(lambda o: {"k": o.o_orderkey})


@query("lock_is_accepted", "SELECT r_regionkey AS k FROM region")
def _(engine):
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return engine.all(from_("region").lock("FOR UPDATE").select(lambda r: {"k": r.r_regionkey}))


# values


@query("arithmetic", "SELECT l_orderkey AS k, l_linenumber AS n, l_quantity - 1 AS less, l_extendedprice / l_quantity AS each, -l_quantity AS minus, 2 * l_discount + 1 AS more FROM lineitem")
def _(engine):
    return from_("lineitem").select(lambda l: {"k": l.l_orderkey, "n": l.l_linenumber, "less": l.l_quantity - 1, "each": l.l_extendedprice / l.l_quantity, "minus": -l.l_quantity, "more": 2 * l.l_discount + 1})


_UNITS = {"year": 2, "month": -5, "week": 3, "day": -9, "hour": 30, "minute": -200, "second": 4000, "millisecond": -2500, "microsecond": 1700}


@query("datetime_units", "SELECT event_id, " + ", ".join(f"ts + to_{u}s({n}) AS {u}_" for u, n in _UNITS.items()) + " FROM events")
def _(engine):
    return from_("events").select(lambda v: {"event_id": v.event_id} | {f"{u}_": datetime_add(v.ts, n, u) for u, n in _UNITS.items()})


@query("json_null_is_something", "SELECT i AS id, i = 3 AS missing FROM (VALUES (1), (2), (3)) t(i)")
def _(engine):
    rows = table(engine, [(1, '{"a": null}'), (2, '{"a": {"b": [1]}}'), (3, '{"c": 1}')], "id int, meta string")
    return from_(rows).select(lambda t: {"id": t.id, "missing": t.meta["a"].is_nil()})


def lower_of(x):
    """A function made of a fragment."""
    return fragment("lower(?)", x)


@query("macro_function", "SELECT c_custkey AS k, lower(c_mktsegment) AS s FROM customer WHERE lower(c_mktsegment) = 'building'")
def _(engine):
    return from_("customer").where(lambda c: lower_of(c.c_mktsegment) == "building").select(lambda c: {"k": c.c_custkey, "s": lower_of(c.c_mktsegment)})


@query("fragment_aggregate", "SELECT o_orderpriority AS p, round(quantile_cont(o_totalprice, 0.5), 3) AS median FROM orders GROUP BY 1")
def _(engine):
    return from_("orders").group_by(lambda o: o.o_orderpriority).select(lambda o: {"p": o.o_orderpriority, "median": fragment("round(percentile(?, 0.5), 3)", o.o_totalprice, aggregate=True)})


_STATUS = types.Enum(open="O", filled="F", pending="P")


@query("enum_fields", "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE 'pending' END AS status FROM orders WHERE o_orderstatus <> 'P'")
def _(engine):
    order = Schema("EnumOrder", "orders", {"id": Field("integer", source="o_orderkey", primary_key=True), "status": Field(_STATUS, source="o_orderstatus")})
    return from_(order).where(lambda o: o.status.in_(["open", "filled"]))


@query("prepare_hook", "SELECT s_suppkey AS k FROM supplier WHERE s_nationkey < 10 AND s_acctbal > 0")
def _(engine):
    tenant = Engine(engine.spark, engine.table, prepare=lambda operation, q: q.where(lambda s, *_: s.s_nationkey < 10))
    return tenant.all(from_("supplier").where(lambda s: s.s_acctbal > 0).select(lambda s: {"k": s.s_suppkey}))


# windows


@query("window_aggregates", """SELECT l_orderkey AS k, l_linenumber AS n, round(avg(l_quantity) OVER w, 6) AS a, min(l_discount) OVER w AS lo, max(l_tax) OVER w AS hi, count(DISTINCT l_suppkey) OVER w AS suppliers
    FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)""")
def _(engine):
    q = from_("lineitem").windows(w={"partition_by": lambda l: l.l_orderkey})
    return q.select(lambda l: {"k": l.l_orderkey, "n": l.l_linenumber, "a": fragment("round(?, 6)", avg(l.l_quantity).over("w")), "lo": min_(l.l_discount).over("w"), "hi": max_(l.l_tax).over("w"), "suppliers": count(l.l_suppkey, distinct=True).over("w")})


@query("window_fragment", "SELECT o_orderkey AS k, any_value(o_orderstatus) OVER (PARTITION BY o_orderstatus) AS s, bit_or(o_custkey) OVER (PARTITION BY o_orderstatus) AS b FROM orders")
def _(engine):
    return from_("orders").select(lambda o: {"k": o.o_orderkey, "s": o.o_orderstatus, "b": fragment("bit_or(?)", o.o_custkey).over(partition_by=o.o_orderstatus)})


@query("window_interval_frame", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS n FROM events")
def _(engine):
    return from_("events").select(lambda v: {"event_id": v.event_id, "n": count().over(partition_by=v.user_id, order_by=v.ts, frame="RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW")})


@query("window_exclude_group", "SELECT l_orderkey AS k, l_linenumber AS n, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE GROUP) AS others FROM lineitem")
def _(engine):
    frame = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE GROUP"
    return from_("lineitem").select(lambda l: {"k": l.l_orderkey, "n": l.l_linenumber, "others": sum_(l.l_quantity).over(partition_by=l.l_orderkey, order_by=l.l_suppkey, frame=frame)})


@query("window_shift_by_column", "SELECT o_orderkey AS k, lead(o_orderkey, CAST(o_custkey % 3 AS INTEGER)) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS v FROM orders")
def _(engine):
    return from_("orders").select(lambda o: {"k": o.o_orderkey, "v": e.lead(o.o_orderkey, fragment("? % 3", o.o_custkey)).over(partition_by=o.o_orderstatus, order_by=o.o_orderkey)})


# associations


@query("assoc_many_to_many", "SELECT o_orderkey AS id, p_partkey AS part FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_size > 40")
def _(engine):
    order = Schema("O2", "orders", {"id": Field("integer", source="o_orderkey", primary_key=True)}, {"parts": many_to_many(lambda: PART, "lineitem", ("l_orderkey", "l_partkey"))})
    return from_(order).join(lambda o: assoc(o, "parts"), as_="p").where(lambda o, p: p.p_size > 40).select(lambda o, p: {"id": o.id, "part": p.p_partkey})


def _flat(rows, name):
    return rows.select("id", F.explode_outer(name).alias("x")).select("id", F.col("x.name").alias("name"))


@query("preload_joined", "SELECT r_regionkey AS id, n_name AS name FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_name <> 'NATION_3'")
def _(engine):
    q = from_(REGION).join(lambda r: assoc(r, "nations"), as_="n").where(lambda *, n: n.name != "NATION_3").preload(lambda r, *, n: {"nations": n})
    return _flat(engine.all(q), "nations")


@query("preload_function", "SELECT r_regionkey AS id, n_name AS name FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey > 20")
def _(engine):
    late = lambda ids: engine.all(from_(NATION).where(lambda n: n.id > 20))
    return _flat(engine.all(from_(REGION).preload(nations=late)), "nations")


@query("preload_rows", "SELECT r_regionkey AS id, n_name AS name FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey < 9")
def _(engine):
    rows = engine.preload(engine.all(REGION), REGION, "nations")
    return _flat(engine.preload(rows, REGION, ("nations", from_(NATION).where(lambda n: n.id < 9)), force=True), "nations")


@query("preload_falling", "SELECT r_regionkey AS id, n_name AS name, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_name DESC) - 1 AS nth FROM region JOIN nation ON n_regionkey = r_regionkey")
def _(engine):
    region = Schema("R2", "region", {"id": Field("integer", source="r_regionkey", primary_key=True)}, {"nations": has_many(lambda: NATION, "region_id", "id", preload_order=(("desc", "name"),))})
    rows = engine.all(from_(region).preload("nations"))
    return rows.select("id", F.posexplode("nations").alias("nth", "x")).select("id", F.col("x.name").alias("name"), F.col("nth").cast("long").alias("nth"))


@query("embedded_records", "SELECT n_nationkey AS id, n_name AS inner_name, CAST(n_regionkey AS BIGINT) AS second FROM nation")
def _(engine):
    inner = Schema("Inner", None, {"name": "string", "n": "integer"})
    outer = Schema("Outer", "held", {"id": Field("integer", primary_key=True)}, embeds={"one": Embed(inner), "many": Embed(inner, many=True)})
    one = F.struct(F.col("n_name").alias("name"), F.lit(1).cast("long").alias("n"))
    two = F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("n"))
    held = engine.table("nation").select(F.col("n_nationkey").alias("id"), one.alias("one"), F.array(one, two).alias("many"))
    return Engine(engine.spark, {"held": held}).all(from_(outer).select(lambda o: {"id": o.id, "inner_name": o.one["name"], "second": o["many"][1]["n"]}))


@query("assoc_built", "SELECT CAST(r_regionkey AS BIGINT) AS region_id, 'x' || r_name AS name FROM region")
def _(engine):
    from tessera.operators.associations import build_assoc

    made = [build_assoc(REGION, r.asDict(), "nations", {"name": "x" + r.name}) for r in engine.stream(from_(REGION))]
    return table(engine, [(m["region_id"], m["name"]) for m in made], "region_id long, name string")


# terminals


@query("terminals", """SELECT * FROM (VALUES ('one', 'NATION_4'), ('get', 'NATION_7'), ('get_by', 'NATION_2'), ('get_nothing', NULL), ('exists', 'true'), ('not_exists', 'false'), ('fails', 'true'), ('stream', '25'), ('aggregate', '24')) t(what, value)""")
def _(engine):
    out = [
        ("one", engine.one(from_(NATION).where(id=4)).name), ("get", engine.get(NATION, 7).name), ("get_by", engine.get_by(NATION, name="NATION_2").name), ("get_nothing", engine.get(NATION, -1)),
        ("exists", str(engine.exists(from_(NATION).where(id=1))).lower()), ("not_exists", str(engine.exists(from_(NATION).where(id=-1))).lower()),
        ("fails", str(raises(NoResultsError, lambda: engine.get_or_fail(NATION, -1))).lower()), ("stream", str(sum(1 for _ in engine.stream(from_(NATION))))), ("aggregate", str(engine.aggregate(from_(NATION), "max", "id"))),
    ]
    return table(engine, out, "what string, value string")


@query("all_by", "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region_id FROM nation WHERE n_regionkey = 3")
def _(engine):
    return engine.all_by(NATION, region_id=3)


@query("reload_rows", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_acctbal < 0")
def _(engine):
    stale = engine.all(from_(CUSTOMER).where(lambda c: c.balance < 0).select(lambda c: {"id": c.id, "name": "old"}))
    return engine.reload(CUSTOMER, stale).select("record.id", "record.name")


@query("load_rows", "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE 'pending' END AS status FROM orders")
def _(engine):
    order = Schema("EnumOrder", "orders", {"id": Field("integer", source="o_orderkey", primary_key=True), "status": Field(_STATUS, source="o_orderstatus")})
    return engine.load(order, engine.table("orders"))


@query("query_text", "SELECT 'from_(Nation, as_=''n'').where(n.id > 3).order_by((''desc'', n.name)).limit(2)' AS text")
def _(engine):
    q = from_(NATION, as_="n").where(lambda n: n.id > 3).order_by(lambda n: desc(n.name)).limit(2)
    return table(engine, [(str(q),)], "text string")


@query("storage", "SELECT * FROM (VALUES ('before', 'down'), ('up', 'true'), ('again', 'false'), ('now', 'up'), ('down', 'true'), ('after', 'down')) t(step, value)")
def _(engine):
    name = f"tessera_{uuid.uuid4().hex}"
    out = [("before", engine.storage_status(name)), ("up", engine.storage_up(name)), ("again", engine.storage_up(name)), ("now", engine.storage_status(name)), ("down", engine.storage_down(name)), ("after", engine.storage_status(name))]
    return table(engine, [(s, str(v).lower()) for s, v in out], "step string, value string")


# writes


@query("insert_cells", "SELECT p_partkey, p_name, p_size FROM part UNION ALL SELECT -1, 'held', (SELECT max(p_size) FROM part) UNION ALL SELECT -2, 'held', 3")
def _(engine):
    top = from_(PART).select(lambda p: {"v": max_(p.p_size)})
    rows = [{"p_partkey": -1, "p_name": ("placeholder", "n"), "p_size": top}, {"p_partkey": "-2", "p_name": ("placeholder", "n"), "p_size": 3}]
    return engine.insert_all(PART, rows, placeholders={"n": "held"}).table.select("p_partkey", "p_name", "p_size")


@query("insert_first_of_repeats", "SELECT CAST(k AS BIGINT) AS p_partkey, p_name FROM (VALUES (-1, 'first'), (-2, 'only')) t(k, p_name)")
def _(engine):
    rows = [{"p_partkey": k, "p_name": n} for k, n in ((-1, "first"), (-1, "second"), (-2, "only"), (1, "there"))]
    return engine.insert_all(PART, rows, on_conflict="nothing", returning=["p_partkey", "p_name"]).affected


@query("insert_raises", "SELECT true AS conflict, true AS repeated, true AS unknown")
def _(engine):
    tried = [raises(ConstraintError, lambda: engine.insert_all(PART, [{"p_partkey": 1}])), raises(ConstraintError, lambda: engine.insert_all(PART, [{"p_partkey": -1}] * 2)), raises(QueryError, lambda: engine.insert_all(PART, [{"nope": 1}]))]
    return table(engine, [tuple(tried)], "conflict boolean, repeated boolean, unknown boolean")


@query("upsert_unchanged", "SELECT p_partkey FROM part WHERE p_size <> 7")
def _(engine):
    rows = engine.table("part").withColumn("p_size", F.lit(7))
    return engine.insert_all(PART, rows, on_conflict=("replace", ["p_size"]), returning=["p_partkey"]).affected


def joined_list(df):
    return df.withColumn("held", F.array_join(F.col("held").cast("array<string>"), ","))


@query("update_push", "SELECT p_partkey, array_to_string([p_size, 5, 9], ',') AS held FROM part")
def _(engine):
    frame = engine.table("part").select("p_partkey", F.array("p_size", F.lit(5)).alias("held"))
    return joined_list(engine.update_all(from_(frame).update(push={"held": 9})).table)


@query("update_pull", "SELECT p_partkey, array_to_string(list_filter([p_size, 5, 9, 5], lambda x: x <> 5), ',') AS held FROM part")
def _(engine):
    frame = engine.table("part").select("p_partkey", F.array("p_size", F.lit(5), F.lit(9), F.lit(5)).alias("held"))
    return joined_list(engine.update_all(from_(frame).update(pull={"held": 5})).table)


@query("update_errors", "SELECT true AS twice, true AS fixed, true AS nothing, true AS limited")
def _(engine):
    fixed = Schema("F2", "part", {"p_partkey": Field("integer", primary_key=True), "p_name": Field("string", writable="never"), "p_size": "integer"})
    run = lambda q: raises(QueryError, lambda: engine.update_all(q))
    tried = (run(from_(fixed).update(set={"p_size": 1}, inc={"p_size": 1})), run(from_(fixed).update(set={"p_name": "x"})), run(from_(fixed)), run(from_(fixed).limit(1).update(set={"p_size": 1})))
    return table(engine, [tried], "twice boolean, fixed boolean, nothing boolean, limited boolean")


@query("row_update_locked", "SELECT p_partkey, CASE WHEN p_partkey = 3 THEN p_size + 1 ELSE p_size END AS p_size, CASE WHEN p_partkey = 3 THEN 'renamed' ELSE p_name END AS p_name FROM part")
def _(engine):
    size = engine.get(PART, 3).p_size
    return engine.update(PART, 3, {"p_name": "renamed"}, lock=("p_size", size)).table.select("p_partkey", "p_size", "p_name")


@query("row_delete_and_stale", "SELECT p_partkey, true AS stale FROM part WHERE p_partkey <> 5")
def _(engine):
    stale = raises(StaleEntryError, lambda: engine.delete(PART, -5)) and raises(StaleEntryError, lambda: engine.update(PART, 3, {"p_name": "x"}, lock=("p_size", -1)))
    return engine.delete(PART, 5).table.select("p_partkey", F.lit(stale).alias("stale"))


# single records


_NATION = Schema("N3", "nation", {"id": Field("integer", source="n_nationkey", primary_key=True), "name": Field("string", source="n_name"), "region_id": Field("integer", source="n_regionkey")},
    {"region": belongs_to(lambda: _REGION, "region_id")}, constraints=[unique("nation_name_index", "name"), fkey("nation_region_id_fkey", "region_id", lambda: _REGION), check("named", "length(name) > 1")])
_REGION = Schema("R3", "region", {"id": Field("integer", source="r_regionkey", primary_key=True), "name": Field("string", source="r_name")},
    {"nations": has_many(lambda: _NATION, "region_id", "id", on_replace="delete", on_delete="delete_all")})


@query("record_insert", "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT (SELECT max(n_nationkey) + 1 FROM nation), 'NEW', 2")
def _(engine):
    return engine.insert(change(_NATION, {}, {"name": "NEW", "region_id": 2})).tables["nation"]


@query("record_insert_or_update", "SELECT CASE WHEN n_nationkey = 6 THEN 'SIX' ELSE n_name END AS n_name FROM nation UNION ALL SELECT 'FRESH'")
def _(engine):
    steps = Multi().insert_or_update("six", lambda _: change(_NATION, engine.get(_NATION, 6).asDict(), {"name": "SIX"})).insert_or_update("new", change(_NATION, {}, {"name": "FRESH", "region_id": 1}))
    own = engine.overlay()
    out = steps.transact(own)
    saved = out.results["new"]
    rows = own.insert_or_update(change(_NATION, own.get(_NATION, 6).asDict(), {"name": "SIX"})).tables["nation"]
    return rows.select("n_name").union(table(engine, [(saved["name"],)], "n_name string"))


@query("record_constraints", """SELECT * FROM (VALUES ('name', 'has already been taken'), ('region_id', 'does not exist'), ('name', 'is invalid'), ('raised', 'nation_name_index')) t(field, message)""")
def _(engine):
    base = change(_NATION, {}, {"name": "NATION_1", "region_id": 1})
    out = engine.insert(base.unique_constraint("name", "name_index", match="suffix")).change.errors
    out += engine.insert(change(_NATION, {}, {"name": "X1", "region_id": 99}).foreign_key_constraint("region_id")).change.errors
    out += engine.insert(change(_NATION, {}, {"name": "X", "region_id": 1}).check_constraint("name", "named")).change.errors
    try:
        engine.insert(base)
    except ConstraintError as err:
        out += (("raised", err.name),)
    return table(engine, list(out), "field string, message string")


@query("record_cast_assoc", "SELECT n_nationkey, CASE WHEN n_nationkey = 0 THEN 'ZERO' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_regionkey <> 0 OR n_nationkey = 0 UNION ALL SELECT (SELECT max(n_nationkey) + 1 FROM nation), 'NEW', 0")
def _(engine):
    row = engine.all(from_(_REGION).where(id=0).preload("nations")).first().asDict(recursive=True)
    edit = change(_REGION, row).cast_assoc("nations", {"nations": [{"id": 0, "name": "ZERO"}, {"name": "NEW"}]})
    return engine.update(edit).tables["nation"]


@query("record_cast_embed", "SELECT 1::BIGINT AS id, 7::BIGINT AS price, 2 AS items")
def _(engine):
    item = Schema("Item", None, {"id": Field("integer", primary_key=True), "price": "integer"})
    held = Schema("Held2", "held", {"id": Field("integer", primary_key=True)}, embeds={"one": Embed(item), "many": Embed(item, many=True)})
    own = Engine(engine.spark, {"held": engine.spark.createDataFrame([], held.spark_schema(stored=True))})
    made = change(held, {}, {}).cast_embed("one", {"one": {"price": "7"}}).put_embed("many", [{"id": 1, "price": 1}, {"id": 2, "price": 2}])
    return own.insert(made).tables["held"].select("id", "one.price", F.size("many").alias("items"))


@query("record_delete_cascades", "SELECT n_nationkey AS k, 'nation' AS t FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT r_regionkey, 'region' FROM region WHERE r_regionkey <> 1")
def _(engine):
    done = engine.delete(change(_REGION, {"id": 1}))
    return done.tables["nation"].select(F.col("n_nationkey").alias("k"), F.lit("nation").alias("t")).union(done.tables["region"].select("r_regionkey", F.lit("region")))


@query("record_helpers", "SELECT * FROM (VALUES ('age', '4'), ('name', 'ann'), ('error', 'is invalid'), ('valid', 'false')) t(what, value)")
def _(engine):
    person = Schema("P4", None, {"name": "string", "age": "integer", "size": "integer"})
    c = RecordChange(person, {"name": "ann", "age": 3}).cast({"name": "ann", "age": "4", "size": "x"}, ["name", "age", "size"])
    out = [(k, str(v)) for k, v in c.changes.items()] + [("name", c.get_field("name")), ("error", c.traverse_errors()["size"][0]), ("valid", str(c.valid).lower())]
    return table(engine, out, "what string, value string")


@query("multi_single_rows", "SELECT n_name FROM nation WHERE n_nationkey <> 8 UNION ALL SELECT 'INNER'")
def _(engine):
    steps = Multi().insert("region", (_REGION, {"id": 77, "name": "R77"})).insert("nation", lambda done: (_NATION, {"name": "TMP", "region_id": done["region"]["id"]}))
    steps = steps.update("renamed", lambda done: change(_NATION, done["nation"], {"name": "INNER"})).delete("gone", change(_NATION, {"id": 8, "name": "NATION_8", "region_id": 0}))
    return steps.run("rows", lambda own, done: own.table("nation").select("n_name")).transact(engine).results["rows"]


@query("multi_stops", "SELECT 'second' AS failed, 'has already been taken' AS message, false AS ran_on")
def _(engine):
    steps = Multi().insert("first", change(_NATION, {}, {"name": "TWIN", "region_id": 1})).insert("second", change(_NATION, {}, {"name": "TWIN", "region_id": 2}).unique_constraint("name")).put("third", 1)
    out = steps.transact(engine)
    return table(engine, [(out.failed, out.value.errors[0][1], "third" in out.results)], "failed string, message string, ran_on boolean")


# validation


@query("validate_cast_required", "SELECT doc_id, CASE WHEN text IS NULL OR trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 1 ELSE 0 END + CASE WHEN regexp_full_match(lang, '[+-]?[0-9]+') OR lang IS NULL THEN 0 ELSE 1 END AS failures FROM documents")
def _(engine):
    kinds = Schema("D5", None, {"lang": "integer", "text": "string"})
    out = Changeset.cast(engine.table("documents").select("doc_id", "lang", "text"), kinds, ["lang"]).validate_required("text").result()
    return out.select("doc_id", F.size("errors").alias("failures"))


@query("validate_exclusion_subset", "SELECT c_custkey AS k, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 1 ELSE 0 END + CASE WHEN c_nationkey % 4 IN (0, 1) THEN 0 ELSE 1 END AS failures FROM customer")
def _(engine):
    rows = engine.table("customer").withColumn("tags", F.array(F.col("c_nationkey") % 4, F.lit(1)))
    out = Changeset(rows).validate_exclusion("c_mktsegment", ["BUILDING", "MACHINERY"]).validate_subset("tags", [0, 1]).result()
    return out.select(F.col("c_custkey").alias("k"), F.size("errors").alias("failures"))


@query("validate_confirmation_acceptance", "SELECT o_orderkey AS k, CASE WHEN o_custkey % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS failures FROM orders")
def _(engine):
    same = F.when(F.col("o_custkey") % 7 != 0, F.col("o_orderpriority")).otherwise(F.lit("other"))
    rows = engine.table("orders").withColumn("o_orderpriority_confirmation", same).withColumn("ok", F.col("o_orderstatus") == "F")
    return Changeset(rows).validate_confirmation("o_orderpriority").validate_acceptance("ok").result().select(F.col("o_orderkey").alias("k"), F.size("errors").alias("failures"))


@query("validate_no_assoc", "SELECT p_partkey AS k, p_partkey NOT IN (SELECT l_partkey FROM lineitem) AS valid FROM part")
def _(engine):
    return Changeset(engine.table("part").select("p_partkey")).no_assoc("p_partkey", engine.table("lineitem"), "l_partkey").result().select(F.col("p_partkey").alias("k"), "valid")


@query("validate_check_and_exclusion", """SELECT event_id AS k, value > 1 AS big, NOT EXISTS (SELECT 1 FROM events o WHERE o.user_id = e.user_id AND o.event_id <> e.event_id AND o.ts < e.ts + INTERVAL 30 MINUTE AND e.ts < o.ts + INTERVAL 30 MINUTE) AS alone FROM events e""")
def _(engine):
    rows = engine.table("events").select("event_id", "user_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("low")).withColumn("high", F.col("low") + 30 * 60 * 1_000_000)
    out = Changeset(rows).check_constraint("big", F.col("value") > 1, "value").exclusion_constraint("low", "high", ["user_id"]).result()
    has = lambda kind: F.exists("errors", lambda x: x["validation"] == kind)
    return out.select(F.col("event_id").alias("k"), (~has("big")).alias("big"), (~has("exclusion")).alias("alone"))


@query("validate_inventory", "SELECT * FROM (VALUES ('c_name', 'required'), ('c_name', 'format'), ('c_acctbal', 'number')) t(field, validation)")
def _(engine):
    c = Changeset(engine.table("customer")).validate_required("c_name").validate_format("c_name", "#").validate_number("c_acctbal", greater_than=0)
    return table(engine, c.traverse_validations(), "field string, validation string")
