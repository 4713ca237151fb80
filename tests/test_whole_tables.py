"""Registered queries that must take whole tables, against brute force at sf0.01."""

import datetime as dt
import os
import random
import re
from collections import Counter, defaultdict

import pytest

from tessera import Engine, from_
from tessera.plans import registry, suite, suite_more, windows  # noqa: F401
from tessera.plans.expr import rank, row_number
from tessera.sources import folder

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def read(spark, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*columns).collect()]


@pytest.mark.parametrize(("name", "n", "outer"), [("inner", 2, False), ("left", 1, True), ("cross", 3, False)])
def test_lateral_joins_take_every_customer(spark, name, n, outer):
    own = defaultdict(list)
    for k, c, total in read(spark, "orders", "o_orderkey", "o_custkey", "o_totalprice"):
        own[c].append((-total, k))
    want = []
    for (c,) in read(spark, "customer", "c_custkey"):
        top = [k for _, k in sorted(own[c])[:n]]
        want += [(c, k) for k in top or [None] * outer]
    got = [(r.k, r.o) for r in registry.QUERIES[f"join_lateral_{name}"](spark, SF).collect()]
    assert max(c for c, _ in got) >= 1000
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", ["union", "union_all", "except", "except_all", "intersect", "intersect_all"])
def test_set_operations_take_every_customer(spark, name):
    left, right = Counter(read(spark, "supplier", "s_nationkey")), Counter(read(spark, "customer", "c_nationkey"))
    assert right.total() >= 1000
    if not name.endswith("_all"):
        left, right = Counter(set(left)), Counter(set(right))
    want = {"union": left | right, "except": left - right, "intersect": left & right}[name.removesuffix("_all")]
    if name == "union_all":
        want = left + right
    assert Counter(tuple(r) for r in registry.QUERIES[f"set_{name}"](spark, SF).collect()) == want


def test_order_nulls_gives_every_row_in_order(spark):
    quality = defaultdict(list)
    for i, q in read(spark, "labels", "doc_id", "quality"):
        quality[i].append(q)
    want = [(i, q) for (i,) in read(spark, "documents", "doc_id") for q in quality[i] or [None]]
    want.sort(key=lambda r: (r[1] is not None, -(r[1] or 0), r[0]))
    got = [(r.doc_id, r.quality) for r in registry.QUERIES["order_nulls"](spark, SF).collect()]
    assert len(got) >= 1000 and got == want


def test_insert_select_takes_rows_whose_keys_are_there(spark, tmp_path):
    rows = [(1, "one", "b", "t", 1, 1.0), (1000001, "two", "b", "t", 1, 2.0), (1000002, "three", "b", "t", 2, 3.0)]
    part = spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    part.write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(tuple(r) for r in registry.QUERIES["insert_select"](spark, str(tmp_path)).collect())
    assert got == [(1, "one"), (1000001, "ONE"), (1000001, "two"), (1000002, "three"), (2000001, "TWO")]


def test_rows_of_a_whole_table_are_numbered_in_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(windows, "RANGE_ROWS", 40)
    r = random.Random(3)
    rows = [(n, r.choice([None, "a", "b", "é", ""]), r.choice([None, 1.5, -0.0, 0.0, float("nan"), 7.25]), r.choice([None, *(dt.datetime(2000, 1, d, 3) for d in range(1, 9))])) for n in range(600)]
    spark.createDataFrame(rows, "k long, s string, x double, t timestamp_ntz").write.parquet(f"{tmp_path}/t.parquet")
    engine = Engine(spark, folder(spark, str(tmp_path)))
    number = lambda f, by: from_("t").select(lambda t: {"k": t.k, "v": f.over(order_by=[(d, getattr(t, c)) for d, c in by])})
    for by in ([("asc", "s"), ("desc", "k")], [("desc", "x"), ("asc_nulls_first", "t"), ("asc", "k")], [("desc_nulls_last", "t"), ("asc", "s"), ("asc", "k")], [("asc", "k")]):
        for f, many in ((row_number(), by), (rank(), by[:1])):
            query = number(f, many)
            monkeypatch.setattr(windows, "MOST_RANGES", 1)
            want = sorted(tuple(x) for x in engine.all(query).collect())
            monkeypatch.setattr(windows, "MOST_RANGES", 256)
            got = engine.all(query)
            assert "_range" in got._jdf.queryExecution().analyzed().toString()
            assert sorted(tuple(x) for x in got.collect()) == want
    counted = from_("t").group_by(lambda t: t.s).select(lambda t: {"s": t.s, "v": row_number().over(order_by=[("desc", t.s)])})
    assert {x.s: x.v for x in engine.all(counted).collect()} == {None: 1, "é": 2, "b": 3, "a": 4, "": 5}


def sorts(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"\bSort \[", plan))


def test_window_aggregates_sorts_its_rows_once(spark):
    assert sorts(spark, "window_aggregates") == 1


def test_window_exclude_group_sorts_its_rows_once(spark):
    assert sorts(spark, "window_exclude_group") == 1
