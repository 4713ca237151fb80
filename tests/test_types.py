"""Casting, storing and loading of field types."""

import datetime as dt
import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tessera.errors import CastError, ChangeError
from tessera.functions import types

GOOD = [
    ("integer", "12", 12), ("integer", -3, -3), ("float", 1, 1.0), ("float", "1.5", 1.5), ("boolean", "1", True), ("boolean", "false", False),
    ("string", "x", "x"), ("decimal", "1.20", Decimal("1.20")), ("date", "2014-01-02", dt.date(2014, 1, 2)), ("date", "2014-01-02T03:04:05", dt.date(2014, 1, 2)),
    ("time", "10:11", dt.time(10, 11)), ("naive_datetime", "2014-01-02T03:04:05.678", dt.datetime(2014, 1, 2, 3, 4, 5)),
    ("naive_datetime_usec", "2014-01-02T03:04:05.678", dt.datetime(2014, 1, 2, 3, 4, 5, 678000)),
    ("utc_datetime", "2014-01-02T03:04:05+01:00", dt.datetime(2014, 1, 2, 2, 4, 5, tzinfo=dt.UTC)), (("array", "integer"), ["1", None], [1, None]),
    (("map", "integer"), {"a": "1"}, {"a": 1}), (("in", "integer"), ["1"], [1]), ("integer", None, None), ("any", object, object),
    ("uuid", "601D74E4-A8D3-4B6E-8365-EDDB4C893327", "601d74e4-a8d3-4b6e-8365-eddb4c893327"), ("map", {"a": 1}, {"a": 1}),
]
BAD = [
    ("integer", "1.0"), ("integer", "1x"), ("integer", "9" * 32), ("integer", True), ("float", "1-foo"), ("boolean", "yes"), ("boolean", 1), ("string", 1), ("decimal", "NaN"),
    ("date", "2014-13-01"), ("time", "25:00"), ("naive_datetime", "x"), (("array", "integer"), "1"), (("in", "integer"), None), ("uuid", "zz"), ("map", []), ("nope", 1),
]


@pytest.mark.parametrize(("kind", "value", "want"), GOOD)
def test_cast(kind, value, want):
    assert types.cast(kind, value) == want


@pytest.mark.parametrize(("kind", "value"), BAD)
def test_cast_errors(kind, value):
    with pytest.raises(CastError):
        types.cast(kind, value)


def test_enum(spark):
    e = types.Enum("draft", "done")
    n = types.Enum(low=1, high=5)
    assert types.cast(e, "draft") == "draft" and types.dump(n, "high") == 5 and types.cast(n, 5) == "high" and n.values == ["low", "high"]
    for bad in ("x", 1):
        with pytest.raises(CastError):
            types.cast(e, bad)
    with pytest.raises(ChangeError):
        types.dump(e, "x")
    with pytest.raises(ChangeError):
        types.Enum(a=1, b=1)
    df = spark.createDataFrame([(1,), (5,), (None,), (7,)], "v int").select(types.load(n, F.col("v")).alias("v"))
    assert [r.v for r in df.collect()] == ["low", "high", None, None]


def test_dump_and_equal():
    with pytest.raises(ChangeError):
        types.dump("naive_datetime", dt.datetime(2014, 1, 1, 0, 0, 0, 5))
    assert types.dump("duration", {"year": 1, "week": 2, "second": 3}) == {"months": 12, "days": 14, "micros": 3_000_000}
    assert types.equal("decimal", Decimal("1.0"), Decimal("1.00")) and not types.equal("integer", None, 1)
    assert types.matches("decimal", "integer") and types.matches("any", "string") and not types.matches("string", "integer")


def test_uuids(spark):
    row = spark.range(1).select(types.uuid_v7().alias("u")).select("u", types.uuid_version(F.col("u")).alias("v"), types.uuid_v7_time(F.col("u")).alias("t")).first()
    assert uuid.UUID(row.u).version == 7 and row.v == 7 and abs((dt.datetime.now() - row.t).total_seconds()) < 86400
