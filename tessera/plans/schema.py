"""Schemas: typed records with a source, keys, associations and embedded records."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field as dc_field
from typing import Any

from pyspark.sql import types as T

from tessera.errors import CompileError, NoPrimaryKeyFieldError
from tessera.functions import types


@dataclass(frozen=True)
class Field:
    type: Any = "any"
    default: Any = None
    source: str | None = None
    primary_key: bool = False
    virtual: bool = False
    load_in_query: bool = True
    writable: str = "always"
    on_writable_violation: str = "nothing"
    redact: bool = False
    autogenerate: Callable | None = None

    def __post_init__(self):
        if self.writable not in ("always", "insert", "never"):
            raise CompileError(f"writable is always, insert or never, not {self.writable!r}")
        if self.on_writable_violation not in ("nothing", "warn", "raise"):
            raise CompileError(f"on_writable_violation is nothing, warn or raise, not {self.on_writable_violation!r}")


@dataclass(frozen=True)
class Assoc:
    """has_many, has_one, belongs_to, many_to_many, or through a chain of other associations."""

    kind: str
    target: Callable[[], Schema] | None = None
    owner_key: str | None = None
    related_key: str | None = None
    where: dict = dc_field(default_factory=dict)
    preload_order: tuple = ()
    join_through: str | None = None
    join_keys: tuple[str, str] | None = None
    join_where: dict = dc_field(default_factory=dict)
    through: tuple[str, ...] = ()
    on_delete: str = "nothing"
    on_replace: str = "raise"

    def __post_init__(self):
        if self.on_delete not in ("nothing", "nilify_all", "delete_all"):
            raise CompileError(f"on_delete is nothing, nilify_all or delete_all, not {self.on_delete!r}")
        if self.on_replace not in ("raise", "mark_as_invalid", "nilify", "update", "delete"):
            raise CompileError(f"on_replace can't be {self.on_replace!r}")

    @property
    def many(self) -> bool:
        return self.kind in ("has_many", "many_to_many")


def has_many(target, related_key=None, owner_key=None, **options) -> Assoc:
    return Assoc("has_many", target, owner_key, related_key, **options)


def has_one(target, related_key=None, owner_key=None, **options) -> Assoc:
    return Assoc("has_one", target, owner_key, related_key, **options)


def belongs_to(target, owner_key=None, related_key=None, **options) -> Assoc:
    return Assoc("belongs_to", target, owner_key, related_key, **options)


def many_to_many(target, join_through, join_keys, **options) -> Assoc:
    return Assoc("many_to_many", target, join_through=join_through, join_keys=tuple(join_keys), **options)


def through(*names: str, many: bool = True) -> Assoc:
    return Assoc("has_many" if many else "has_one", through=names)


@dataclass(frozen=True)
class Embed:
    """A nested record (one) or a list of them (many)."""

    schema: Schema
    many: bool = False
    on_replace: str = "raise"


@dataclass(frozen=True)
class Constraint:
    """What writes hold new rows to: kind unique, foreign_key (``target``'s ``key``) or check (``condition``, SQL over fields)."""

    kind: str
    name: str
    fields: tuple[str, ...] = ()
    target: Callable[[], Schema] | None = None
    key: str | None = None
    condition: str | None = None


def unique(name: str, *fields: str) -> Constraint:
    return Constraint("unique", name, fields)


def foreign_key(name: str, field: str, target, key: str | None = None) -> Constraint:
    return Constraint("foreign_key", name, (field,), target, key)


def check(name: str, condition: str) -> Constraint:
    return Constraint("check", name, condition=condition)


class Schema:
    """name, fields, associations, embeds and constraints; ``source`` None makes an embedded schema."""

    def __init__(self, name: str, source: str | None, fields: dict[str, Any], assocs=None, embeds=None, prefix: str | None = None, constraints=()):
        self.name, self.source, self.prefix = name, source, prefix
        self.constraints: tuple[Constraint, ...] = tuple(constraints)
        self.fields = {k: f if isinstance(f, Field) else Field(f) for k, f in fields.items()}
        self.assocs: dict[str, Assoc] = dict(assocs or {})
        self.embeds: dict[str, Embed] = dict(embeds or {})
        both = self.fields.keys() & (self.assocs.keys() | self.embeds.keys())
        if both:
            raise CompileError(f"{name} defines {sorted(both)} twice")

    def __repr__(self):
        return f"Schema({self.name})"

    @property
    def primary_key(self) -> list[str]:
        return [k for k, f in self.fields.items() if f.primary_key]

    def single_key(self) -> str:
        if len(self.primary_key) != 1:
            raise NoPrimaryKeyFieldError(f"{self.name} needs one primary key field, it has {self.primary_key}")
        return self.primary_key[0]

    @property
    def query_fields(self) -> list[str]:
        return [k for k, f in self.fields.items() if not f.virtual and f.load_in_query] + list(self.embeds)

    @property
    def stored_fields(self) -> list[str]:
        return [k for k, f in self.fields.items() if not f.virtual] + list(self.embeds)

    @property
    def updatable_fields(self) -> list[str]:
        return [k for k, f in self.fields.items() if not f.virtual and f.writable == "always"] + list(self.embeds)

    def source_of(self, name: str) -> str:
        return self.fields[name].source or name if name in self.fields else name

    def type_of(self, name: str) -> Any:
        if name in self.embeds:
            return "any"
        return self.fields[name].type

    def spark_schema(self, stored: bool = False) -> T.StructType:
        """As Spark knows it, under field names or (stored) under column names; ``any`` is text."""
        out = []
        for k, f in self.fields.items():
            if not f.virtual:
                out.append(T.StructField(self.source_of(k) if stored else k, types.spark_type(f.type) or T.StringType()))
        for k, e in self.embeds.items():
            inner = e.schema.spark_schema(stored)
            out.append(T.StructField(k, T.ArrayType(inner) if e.many else inner))
        return T.StructType(out)
