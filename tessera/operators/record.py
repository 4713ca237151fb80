"""Changes to one record, before they are written: what a changeset is to a table, for a single row."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from tessera.errors import CastError, InvalidChangesetError, QueryError
from tessera.functions import types
from tessera.operators import messages
from tessera.plans.schema import Schema


@dataclass(frozen=True)
class Rule:
    """A constraint whose failure is an error of a field: ``name`` is compared by match, or is a compiled pattern."""

    kind: str
    name: str | re.Pattern
    match: str
    field: str
    message: str

    def meets(self, kind: str | None, name: str) -> bool:
        if kind != self.kind:
            return False
        if isinstance(self.name, re.Pattern):
            return self.name.search(name) is not None
        return {"exact": name == self.name, "suffix": name.endswith(self.name), "prefix": name.startswith(self.name)}[self.match]


@dataclass(frozen=True)
class RecordChange:
    """A record's data, the changes to it, changes to related records, and the errors found so far.

    state: "built" for a record that isn't stored yet, "loaded" for one that is.
    related: association -> list of (action, change), where action is insert, update, delete or nilify.
    """

    schema: Schema
    data: dict[str, Any]
    changes: dict[str, Any] = field(default_factory=dict)
    errors: tuple[tuple[str, str], ...] = ()
    state: str = "built"
    related: dict[str, list] = field(default_factory=dict)
    embedded: dict[str, list] = field(default_factory=dict)
    constraints: tuple[Rule, ...] = ()
    prepares: tuple[Callable, ...] = ()
    lock: tuple[str, Callable] | None = None
    stale_field: str | None = None

    @property
    def valid(self) -> bool:
        return not self.errors and all(c.valid for _, c in self._below())

    def _below(self):
        return [x for held in (self.related, self.embedded) for own in held.values() for x in own]

    def cast(self, params: dict[str, Any], permitted: list[str]) -> RecordChange:
        """Permitted parameters as changes; those equal to the data are none, and those that don't fit are errors."""
        out = self
        for k in permitted:
            if k not in params:
                continue
            try:
                out = out.put_change(k, types.cast(self._type(k), params[k]))
            except CastError:
                out = out.add_error(k, messages.INVALID)
        return out

    def _type(self, k: str):
        if k not in self.schema.fields:
            raise QueryError(f"{self.schema.name} has no field {k!r}")
        return self.schema.type_of(k)

    def put_change(self, k: str, value) -> RecordChange:
        if types.equal(self._type(k), self.data.get(k), value):
            return self.delete_change(k)
        return self.force_change(k, value)

    def force_change(self, k: str, value) -> RecordChange:
        """A change even if the data have the value already."""
        self._type(k)
        return replace(self, changes=self.changes | {k: value})

    def delete_change(self, k: str) -> RecordChange:
        return replace(self, changes={c: v for c, v in self.changes.items() if c != k})

    def update_change(self, k: str, function: Callable[[Any], Any]) -> RecordChange:
        """Only if there is a change."""
        return self.put_change(k, function(self.changes[k])) if k in self.changes else self

    def get_change(self, k: str, default=None):
        return self.changes.get(k, default)

    def get_field(self, k: str, default=None):
        return self.changes.get(k, self.data.get(k, default))

    def fetch_field(self, k: str) -> tuple[str, Any]:
        """("changes", value) or ("data", value)."""
        if k in self.changes:
            return "changes", self.changes[k]
        if k in self.data:
            return "data", self.data[k]
        raise KeyError(k)

    def add_error(self, k: str, message: str) -> RecordChange:
        return replace(self, errors=(*self.errors, (k, message)))

    def merge(self, other: RecordChange) -> RecordChange:
        """Both changes to the same data; the other's win."""
        if other.data != self.data:
            raise QueryError("changes to different records can't be merged")
        return replace(
            self, changes=self.changes | other.changes, errors=(*self.errors, *other.errors), related=self.related | other.related,
            embedded=self.embedded | other.embedded, constraints=(*self.constraints, *other.constraints), prepares=(*self.prepares, *other.prepares),
        )

    def apply_changes(self) -> dict[str, Any]:
        """The record with its changes, valid or not."""
        out = self.data | self.changes
        for name, own in (self.related | self.embedded).items():
            kept = [c.apply_changes() for action, c in own if action in ("insert", "update")]
            many = (self.schema.assocs.get(name) or self.schema.embeds[name]).many
            out[name] = kept if many else kept[0] if kept else None
        return out

    def apply_action(self) -> dict[str, Any]:
        if not self.valid:
            raise InvalidChangesetError(f"the record is invalid: {self.traverse_errors()}")
        return self.apply_changes()

    def traverse_errors(self, show: Callable[[str], Any] = lambda message: message) -> dict[str, Any]:
        """field -> messages, association or embed -> the errors below it."""
        out: dict[str, Any] = {}
        for k, message in self.errors:
            out.setdefault(k, []).append(show(message))
        for name, own in (self.related | self.embedded).items():
            below = [c.traverse_errors(show) for _, c in own]
            if any(below):
                many = (self.schema.assocs.get(name) or self.schema.embeds[name]).many
                out[name] = below if many else below[0]
        return out

    # what the store decides

    def _rule(self, kind: str, name, match: str, k: str, message: str) -> RecordChange:
        if match not in ("exact", "suffix", "prefix"):
            raise QueryError(f"a constraint's name is matched exact, suffix or prefix, not {match!r}")
        return replace(self, constraints=(*self.constraints, Rule(kind, name, match, k, message)))

    def unique_constraint(self, k: str, name=None, match: str = "exact", message: str = messages.TAKEN) -> RecordChange:
        return self._rule("unique", name or f"{self.schema.source}_{k}_index", match, k, message)

    def foreign_key_constraint(self, k: str, name=None, match: str = "exact", message: str = messages.NO_SUCH) -> RecordChange:
        return self._rule("foreign_key", name or f"{self.schema.source}_{k}_fkey", match, k, message)

    def check_constraint(self, k: str, name, match: str = "exact", message: str = messages.INVALID) -> RecordChange:
        return self._rule("check", name, match, k, message)

    def no_assoc_constraint(self, assoc: str, name=None, match: str = "exact", message: str | None = None) -> RecordChange:
        from tessera.operators.associations import keys

        a, target, _, theirs = keys(self.schema, assoc)
        message = message or (messages.STILL_MANY if a.many else messages.STILL_ONE)
        return self._rule("foreign_key", name or f"{target.source}_{theirs}_fkey", match, assoc, message)

    def prepare_changes(self, function: Callable[[RecordChange], RecordChange]) -> RecordChange:
        """Called with the change right before it is written."""
        return replace(self, prepares=(*self.prepares, function))

    def optimistic_lock(self, k: str, following: Callable[[Any], Any] = lambda v: (v or 0) + 1) -> RecordChange:
        """The write goes through only if the field is stored as it is in the data; it becomes the following value."""
        self._type(k)
        return replace(self, lock=(k, following))

    def stale_error(self, k: str) -> RecordChange:
        """A stale record is an error of this field."""
        return replace(self, stale_field=k)

    # related and embedded records

    def cast_assoc(self, name: str, params: dict[str, Any], with_: Callable | None = None, required: bool = False) -> RecordChange:
        """Parameters of related records: those whose key is among the related ones change these, others are new."""
        if name not in self.schema.assocs:
            raise QueryError(f"{self.schema.name} has no association {name!r}")
        a = self.schema.assocs[name]
        if a.through:
            raise QueryError("a through association can't be cast; cast its parts")
        return self._cast_below("related", name, a.target(), a.many, a.on_replace, params, with_, required)

    def cast_embed(self, name: str, params: dict[str, Any], with_: Callable | None = None, required: bool = False) -> RecordChange:
        if name not in self.schema.embeds:
            raise QueryError(f"{self.schema.name} has no embed {name!r}")
        e = self.schema.embeds[name]
        return self._cast_below("embedded", name, e.schema, e.many, e.on_replace, params, with_, required)

    def put_assoc(self, name: str, values) -> RecordChange:
        """Related records as given: dicts or changes."""
        if name not in self.schema.assocs:
            raise QueryError(f"{self.schema.name} has no association {name!r}")
        a = self.schema.assocs[name]
        return self._put_below("related", name, a.target(), a.many, a.on_replace, values)

    def put_embed(self, name: str, values) -> RecordChange:
        if name not in self.schema.embeds:
            raise QueryError(f"{self.schema.name} has no embed {name!r}")
        e = self.schema.embeds[name]
        return self._put_below("embedded", name, e.schema, e.many, e.on_replace, values)

    def _held(self, where: str, name: str, many: bool) -> list[dict]:
        if name not in self.data:
            if self.state == "loaded" and where == "related":
                raise QueryError(f"{name!r} must be preloaded before it is changed")
            return []
        held = self.data[name]
        return list(held or []) if many else [held] if held is not None else []

    def _cast_below(self, where, name, schema: Schema, many, on_replace, params, with_, required) -> RecordChange:
        if name not in params:
            return self.add_error(name, messages.BLANK) if required and not self._held(where, name, many) else self
        given = params[name]
        if many and isinstance(given, dict):  # as forms send lists
            given = [v for _, v in sorted(given.items(), key=lambda x: int(x[0]))]
        listed = given if many else [given] if given is not None else []
        if not isinstance(listed, list) or not all(isinstance(x, dict) for x in listed):
            return self.add_error(name, messages.INVALID)
        key = schema.primary_key
        fields = [k for k in schema.fields if k not in key]
        change = with_ or (lambda c, p: c.cast(p, fields))
        held, made = self._held(where, name, many), []
        for p in listed:
            at = self._find(schema, held, p)
            if at is None and not many and held and on_replace == "update":
                at = 0
            if at is None:
                made.append(("insert", change(RecordChange(schema, {}), p)))
            else:
                made.append(("update", change(RecordChange(schema, held.pop(at), state="loaded"), p)))
        out = self._replaced(where, name, schema, held, made, on_replace)
        return out.add_error(name, messages.BLANK) if required and not made else out

    def _put_below(self, where, name, schema: Schema, many, on_replace, values) -> RecordChange:
        listed = list(values or []) if many else [values] if values is not None else []
        held, made = self._held(where, name, many), []
        for v in listed:
            own = v.data if isinstance(v, RecordChange) else v
            at = self._find(schema, held, own)
            if at is not None:
                old = held.pop(at)
                made.append(("update", v if isinstance(v, RecordChange) else _changed(RecordChange(schema, old, state="loaded"), v)))
            elif isinstance(v, RecordChange):
                made.append(("insert" if v.state == "built" else "update", v))
            else:
                made.append(("insert", _changed(RecordChange(schema, {}), v)))
        return self._replaced(where, name, schema, held, made, on_replace)

    def _find(self, schema: Schema, held: list[dict], own: dict) -> int | None:
        key = schema.primary_key
        if not key or any(own.get(k) is None for k in key):
            return None
        for i, h in enumerate(held):
            try:
                if all(types.cast(schema.type_of(k), own[k]) == h.get(k) for k in key):
                    return i
            except CastError:
                return None
        return None

    def _replaced(self, where, name, schema, left: list[dict], made: list, on_replace: str) -> RecordChange:
        """What happens to the records that are no longer related."""
        out, gone = self, []
        for old in left:
            if on_replace == "raise":
                raise QueryError(f"{name!r} would lose a record; set on_replace to say what becomes of it")
            if on_replace == "mark_as_invalid":
                out = out.add_error(name, messages.INVALID)
            else:
                gone.append(("nilify" if on_replace == "nilify" else "delete", RecordChange(schema, old, state="loaded")))
        return replace(out, **{where: getattr(out, where) | {name: [*gone, *made]}})


def _changed(change: RecordChange, values: dict[str, Any]) -> RecordChange:
    for k, v in values.items():
        change = change.put_change(k, v) if k in change.schema.fields else change
    return change


def change(schema: Schema, data: dict[str, Any] | None = None, changes: dict[str, Any] | None = None, state: str | None = None) -> RecordChange:
    """Changes to a record; one with its key's value counts as loaded."""
    data = dict(data or {})
    known = bool(schema.primary_key) and all(data.get(k) is not None for k in schema.primary_key)
    return _changed(RecordChange(schema, data, state=state or ("loaded" if known else "built")), changes or {})
