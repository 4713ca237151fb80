"""Field types: how outside values become inside ones (cast), are stored (dump) and come back (load), and their Spark types.

A type is a name, a pair ("array", t), ("map", t), ("in", t) or ("try", t), or an instance of ``CustomType``.
Casting is for values from outside and strict: text becomes a number only if all of it is one. Null always passes,
except for ("in", t).
"""

from __future__ import annotations

import datetime as dt
import re
import uuid as uuids
from decimal import Decimal, InvalidOperation
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import CastError, ChangeError

DURATION = T.StructType(
    [T.StructField("months", T.IntegerType()), T.StructField("days", T.IntegerType()), T.StructField("micros", T.LongType())]
)
_SPARK = {
    "integer": T.LongType(),
    "id": T.LongType(),
    "float": T.DoubleType(),
    "boolean": T.BooleanType(),
    "string": T.StringType(),
    "binary": T.BinaryType(),
    "bitstring": T.BinaryType(),
    "binary_id": T.StringType(),
    "uuid": T.StringType(),
    "decimal": T.DecimalType(38, 10),
    "date": T.DateType(),
    "time": T.StringType(),
    "time_usec": T.StringType(),
    "naive_datetime": T.TimestampNTZType(),
    "naive_datetime_usec": T.TimestampNTZType(),
    "utc_datetime": T.TimestampType(),
    "utc_datetime_usec": T.TimestampType(),
    "duration": DURATION,
    "map": T.VariantType(),
}
BASE_TYPES = (*_SPARK, "any")
_DATETIMES = ("naive_datetime", "naive_datetime_usec", "utc_datetime", "utc_datetime_usec")
_UUID = re.compile(r"[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}")
_LONGEST_INTEGER = 32


class CustomType:
    """A type of one's own; override what differs from the type it is stored as."""

    stored: Any = "any"

    def cast(self, value):
        return value

    def dump(self, value):
        return value

    def load(self, column: Column) -> Column:
        """The inside value of a stored column."""
        return column

    def store(self, column: Column) -> Column:
        """The stored value of an inside column."""
        return column

    def equal(self, a, b) -> bool:
        return a == b

    def autogenerate(self):
        raise NotImplementedError(f"{type(self).__name__} generates no values")


class Enum(CustomType):
    """One of some names, stored as text or, given a mapping to integers, as numbers."""

    def __init__(self, *values: str, **mapping):
        self.mapping = {v: v for v in values} | mapping
        if not self.mapping or len(set(self.mapping.values())) < len(self.mapping):
            raise ChangeError("an enum needs distinct values")
        kinds = {type(v) for v in self.mapping.values()}
        if kinds not in ({str}, {int}):
            raise ChangeError("an enum is stored as text or as integers, not both")
        self.stored = "string" if kinds == {str} else "integer"

    @property
    def values(self) -> list[str]:
        return list(self.mapping)

    @property
    def dump_values(self) -> list:
        return list(self.mapping.values())

    def cast(self, value):
        for name, held in self.mapping.items():
            if value == name or (value == held and type(value) is type(held)):
                return name
        raise CastError(f"{value!r} is not one of {self.values}", self, value)

    def dump(self, value):
        if value not in self.mapping:
            raise ChangeError(f"{value!r} is not one of {self.values}")
        return self.mapping[value]

    def load(self, column: Column) -> Column:
        pairs = [F.lit(x) for name, held in self.mapping.items() for x in (held, name)]
        return F.try_element_at(F.create_map(*pairs), column.cast("bigint" if self.stored == "integer" else "string"))

    def store(self, column: Column) -> Column:
        return F.try_element_at(F.create_map(*[F.lit(x) for pair in self.mapping.items() for x in pair]), column)


def store(type_, column: Column) -> Column:
    """The stored value of a column of that type."""
    if isinstance(type_, tuple):
        return F.transform(column, lambda x: store(type_[1], x)) if type_[0] == "array" and _custom(type_[1]) else column
    return type_.store(column) if isinstance(type_, CustomType) else column


def _custom(type_) -> bool:
    return _custom(type_[1]) if isinstance(type_, tuple) else isinstance(type_, CustomType)


def base(type_) -> Any:
    """The type that a value of this one is stored as."""
    return base(type_.stored) if isinstance(type_, CustomType) else type_


def spark_type(type_) -> T.DataType | None:
    """The Spark type; None for ``any``, which is left to Spark."""
    type_ = base(type_)
    if type_ == "any":
        return None
    if isinstance(type_, tuple):
        kind, inner = type_
        if kind == "array":
            return T.ArrayType(spark_type(inner) or T.StringType())
        if kind == "map":
            return T.MapType(T.StringType(), spark_type(inner) or T.StringType())
        if kind in ("try", "in"):
            return spark_type(inner)
    if type_ not in _SPARK:
        raise CastError(f"unknown type {type_!r}", type_)
    return _SPARK[type_]


def matches(schema_type, query_type) -> bool:
    """Whether a value of one type may be compared with one of the other."""
    a, b = base(schema_type), base(query_type)
    if "any" in (a, b) or a == b:
        return True
    pairs = {("decimal", "float"), ("decimal", "integer"), ("decimal", "id"), ("float", "integer"), ("float", "id")}
    alike = {("id", "integer"), ("binary_id", "binary"), ("binary_id", "uuid"), ("binary_id", "string"), ("uuid", "string")}
    if (a, b) in pairs or (a, b) in alike or (b, a) in alike:
        return True
    if a in _DATETIMES and b in _DATETIMES:
        return True
    return isinstance(a, tuple) and isinstance(b, tuple) and a[0] == b[0] and matches(a[1], b[1])


def _bad(type_, value):
    raise CastError(f"cannot cast {value!r} to {type_!r}", type_, value)


def _to_datetime(type_, value):
    if isinstance(value, str):
        try:
            value = dt.datetime.fromisoformat(value)
        except ValueError:
            _bad(type_, value)
    elif isinstance(value, dict):
        try:
            value = dt.datetime(*(int(value[k]) for k in ("year", "month", "day", "hour", "minute")), int(value.get("second", 0)))
        except (KeyError, ValueError, TypeError):
            _bad(type_, value)
    elif not isinstance(value, dt.datetime):
        _bad(type_, value)
    if type_.startswith("utc"):
        value = value.replace(tzinfo=dt.UTC) if value.tzinfo is None else value.astimezone(dt.UTC)
    else:
        value = value.replace(tzinfo=None)
    return value if type_.endswith("usec") else value.replace(microsecond=0)


def cast(type_, value):
    """The inside value of an outside one; CastError if there is none."""
    if isinstance(type_, tuple) and type_[0] == "in":
        if not isinstance(value, (list, tuple, set, range)):
            _bad(type_, value)
        return [cast(type_[1], v) for v in value]
    if value is None:
        return None
    if isinstance(type_, CustomType):
        return type_.cast(value)
    if isinstance(type_, tuple):
        kind, inner = type_
        if kind == "array":
            return [cast(inner, v) for v in value] if isinstance(value, (list, tuple)) else _bad(type_, value)
        if kind == "map":
            return {str(k): cast(inner, v) for k, v in value.items()} if isinstance(value, dict) else _bad(type_, value)
        return cast(inner, value)
    return _CASTS[type_](value) if type_ in _CASTS else _bad(type_, value)


def _integer(value):
    if isinstance(value, bool):
        _bad("integer", value)
    if isinstance(value, int):
        return value
    if isinstance(value, str) and len(value) < _LONGEST_INTEGER and re.fullmatch(r"[+-]?\d+", value, re.ASCII):
        return int(value)
    _bad("integer", value)


def _float(value):
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return float(value)
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, str) and re.fullmatch(r"[+-]?\d+(\.\d+)?([eE][+-]?\d+)?", value, re.ASCII):
        return float(value)
    _bad("float", value)


def _boolean(value):
    found = {True: True, False: False, "true": True, "1": True, "false": False, "0": False}
    if isinstance(value, (bool, str)) and value in found:
        return found[value]
    _bad("boolean", value)


def _decimal(value):
    try:
        out = value if isinstance(value, Decimal) else Decimal(str(value)) if isinstance(value, (int, float, str)) else None
    except InvalidOperation:
        out = None
    if out is None or isinstance(value, bool) or not out.is_finite():
        _bad("decimal", value)
    return out


def _date(value):
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    if isinstance(value, str):
        try:
            return dt.date.fromisoformat(value) if len(value) == 10 else dt.datetime.fromisoformat(value).date()
        except ValueError:
            pass
    elif isinstance(value, dict):
        try:
            return dt.date(int(value["year"]), int(value["month"]), int(value["day"]))
        except (KeyError, ValueError, TypeError):
            pass
    _bad("date", value)


def _time(type_):
    def run(value):
        if isinstance(value, str):
            try:
                value = dt.time.fromisoformat(value)
            except ValueError:
                _bad(type_, value)
        if not isinstance(value, dt.time):
            _bad(type_, value)
        return value if type_ == "time_usec" else value.replace(microsecond=0)

    return run


def _uuid(value):
    if isinstance(value, uuids.UUID):
        return str(value)
    if isinstance(value, bytes) and len(value) == 16:
        return str(uuids.UUID(bytes=value))
    if isinstance(value, str) and _UUID.fullmatch(value):
        return str(uuids.UUID(value))
    _bad("uuid", value)


def _only(type_, *kinds):
    return lambda value: value if isinstance(value, kinds) else _bad(type_, value)


_CASTS = {
    "integer": _integer,
    "id": _integer,
    "float": _float,
    "boolean": _boolean,
    "string": _only("string", str),
    "binary": _only("binary", bytes, str),
    "bitstring": _only("bitstring", bytes),
    "binary_id": _uuid,
    "uuid": _uuid,
    "decimal": _decimal,
    "date": _date,
    "time": _time("time"),
    "time_usec": _time("time_usec"),
    "map": _only("map", dict),
    "duration": _only("duration", dict, dt.timedelta),
    "any": lambda value: value,
} | {t: (lambda value, t=t: _to_datetime(t, value)) for t in _DATETIMES}


def dump(type_, value):
    """The stored value of an inside one."""
    if value is None:
        return None
    if isinstance(type_, CustomType):
        return dump(type_.stored, type_.dump(value))
    if isinstance(type_, tuple) and type_[0] in ("array", "in"):
        return [dump(type_[1], v) for v in value]
    if isinstance(type_, tuple) and type_[0] == "map":
        return {k: dump(type_[1], v) for k, v in value.items()}
    if type_ in ("naive_datetime", "utc_datetime", "time") and getattr(value, "microsecond", 0):
        raise ChangeError(f"{type_} holds no microseconds: {value!r}")
    if type_ in ("time", "time_usec"):
        return value.isoformat()
    if type_ == "duration":
        if isinstance(value, dt.timedelta):
            return {"months": 0, "days": value.days, "micros": value.seconds * 10**6 + value.microseconds}
        months = value.get("year", 0) * 12 + value.get("month", 0)
        days = value.get("week", 0) * 7 + value.get("day", 0)
        seconds = value.get("hour", 0) * 3600 + value.get("minute", 0) * 60 + value.get("second", 0)
        return {"months": months, "days": days, "micros": seconds * 10**6 + value.get("microsecond", 0)}
    return value


def load(type_, column: Column) -> Column:
    """A stored column as inside values: a projection."""
    if isinstance(type_, CustomType):
        return type_.load(load(type_.stored, column))
    kind = spark_type(type_)
    if isinstance(type_, tuple) and type_[0] == "array" and isinstance(type_[1], CustomType):
        return F.transform(column, lambda x: load(type_[1], x))
    if kind is None or isinstance(type_, tuple) and type_[0] == "try" or type_ == "map":
        return column
    if type_ in ("naive_datetime", "utc_datetime"):
        return F.date_trunc("second", column.cast(kind)).cast(kind)
    return column.cast(kind)


def equal(type_, a, b) -> bool:
    """Whether two inside values are the same to the type."""
    if a is None or b is None:
        return a is b
    if isinstance(type_, CustomType):
        return type_.equal(a, b)
    if isinstance(type_, tuple) and type_[0] == "array":
        return len(a) == len(b) and all(equal(type_[1], x, y) for x, y in zip(a, b))
    return a == b


def infer(value) -> Any:
    """The type of a literal."""
    kinds = ((bool, "boolean"), (int, "integer"), (float, "float"), (str, "string"), (bytes, "binary"), (Decimal, "decimal"))
    for kind, name in kinds + ((dt.datetime, "naive_datetime_usec"), (dt.date, "date"), (dict, "map")):
        if isinstance(value, kind):
            return "utc_datetime_usec" if isinstance(value, dt.datetime) and value.tzinfo else name
    if isinstance(value, (list, tuple)):
        inner = {infer(v) for v in value if v is not None}
        return ("array", inner.pop() if len(inner) == 1 else "any")
    return "any"


def uuid_v7() -> Column:
    """A version 7 UUID for each row: milliseconds of the row's query, then random bits."""
    millis = F.lpad(F.lower(F.hex(F.unix_millis(F.current_timestamp()))), 12, "0")
    tail = F.uuid()
    return F.concat(F.substring(millis, 1, 8), F.lit("-"), F.substring(millis, 9, 4), F.lit("-7"), F.substring(tail, 16, 21))


def uuid_version(value: Column) -> Column:
    return F.conv(F.substring(value, 15, 1), 16, 10).cast("int")


def uuid_v7_time(value: Column) -> Column:
    """When a version 7 UUID was made; null for others."""
    millis = F.conv(F.concat(F.substring(value, 1, 8), F.substring(value, 10, 4)), 16, 10).cast("long")
    return F.when(uuid_version(value) == 7, F.timestamp_millis(millis))
