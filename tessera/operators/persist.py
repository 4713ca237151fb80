"""Writing one record: its parents first, then itself, then its children, with broken constraints as errors of fields.

Nothing is stored. A write gives the new states of the tables it touches, which an engine made by ``overlay`` then reads.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import ConstraintError, QueryError, StaleEntryError
from tessera.operators import messages
from tessera.operators.associations import keys
from tessera.operators.dml import Written, _enforce
from tessera.operators.record import RecordChange, change as changed
from tessera.plans.query import from_
from tessera.plans.schema import Schema


@dataclass(frozen=True)
class Saved:
    """ok: the record as written and the tables' new states; otherwise the change with its errors."""

    ok: bool
    change: RecordChange
    record: dict[str, Any] | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)


class _Failed(Exception):
    def __init__(self, own: RecordChange):
        super().__init__()
        self.change = own


def save(engine, action: str, given: RecordChange, **options) -> Saved:
    """action: insert, update, delete, or insert_or_update (by the record's state)."""
    if action == "insert_or_update":
        action = "insert" if given.state == "built" else "update"
    if not given.valid:
        return Saved(False, given)
    own = engine.overlay()
    try:
        record = _ACTIONS[action](own, given, options)
    except _Failed as e:
        return Saved(False, e.change)
    return Saved(True, given, record, {k: v for k, v in own.states.items() if engine.states.get(k) is not v})


def _ready(given: RecordChange) -> RecordChange:
    for function in given.prepares:
        given = function(given)
    if not given.valid:
        raise _Failed(given)
    return given


def _writable(given: RecordChange, values: dict, action: str) -> dict:
    """The values that may be written in this action; others are passed over, warned of or refused."""
    out = {}
    for k, v in values.items():
        if k not in given.schema.fields:
            out[k] = v
            continue
        f = given.schema.fields[k]
        if f.virtual:
            continue
        if f.writable == "never" or f.writable == "insert" and action == "update":
            if v is not None and f.on_writable_violation == "raise":
                raise QueryError(f"field {k!r} of {given.schema.name} isn't written on {action}")
            if v is not None and f.on_writable_violation == "warn":
                warnings.warn(f"field {k!r} of {given.schema.name} isn't written on {action}", stacklevel=2)
            continue
        out[k] = v
    return out


def _mapped(given: RecordChange, e: ConstraintError) -> Exception:
    for rule in given.constraints:
        if e.name is not None and rule.meets(e.kind, e.name):
            return _Failed(given.add_error(rule.field, rule.message))
    return e


def _parents(engine, given: RecordChange) -> RecordChange:
    for name, own in given.related.items():
        a, target, mine, theirs = keys(given.schema, name)
        if a.kind != "belongs_to":
            continue
        for action, child in own:
            if action in ("insert", "update"):
                record = _below(engine, given, name, action, child)
                given = given.force_change(mine, record[theirs])
            else:
                given = given.force_change(mine, None)
                if action == "delete":
                    _delete(engine, child, {})
    return given


def _children(engine, given: RecordChange, record: dict) -> dict:
    for name, own in given.related.items():
        a, target, mine, theirs = keys(given.schema, name)
        if a.kind == "belongs_to":
            continue
        kept = []
        for action, child in own:
            if a.kind == "many_to_many":
                kept += _linked(engine, given, name, action, child, record)
                continue
            if action == "delete":
                _delete(engine, child, {})
            elif action == "nilify":
                _update(engine, child.force_change(theirs, None), {})
            else:
                kept.append(_below(engine, given, name, action, child.force_change(theirs, record[mine])))
        record = record | {name: kept if a.many else kept[0] if kept else None}
    return record


def _below(engine, given: RecordChange, name: str, action: str, child: RecordChange) -> dict:
    """A related record's write; if it fails, its errors are below the record's own."""
    try:
        return _ACTIONS[action](engine, child, {})
    except _Failed as e:
        own, held = given.related[name], []
        for what, c in own:
            hit = what == action and c.data == child.data
            held.append((what, e.change if hit else c))
        raise _Failed(replace(given, related=given.related | {name: held})) from None


def _linked(engine, given: RecordChange, name: str, action: str, child: RecordChange, record: dict) -> list[dict]:
    """Rows of the table between the two."""
    a = given.schema.assocs[name]
    mine, yours = a.join_keys
    own = record[given.schema.single_key()]
    if action in ("insert", "update"):
        made = _below(engine, given, name, action, child)
        if action == "insert":
            _publish(engine, engine.insert_all(a.join_through, [{mine: own, yours: made[a.target().single_key()]}]))
        return [made]
    gone = child.data[a.target().single_key()]
    left = engine.table(a.join_through).where(~((F.col(mine) == own) & (F.col(yours) == gone)))
    engine.states[a.join_through] = left
    return []


def _publish(engine, done: Written) -> None:
    engine.states[done.source] = done.stored()


def _embeds(given: RecordChange, values: dict) -> dict:
    for name, own in given.embedded.items():
        e = given.schema.embeds[name]
        kept = [c.apply_changes() for action, c in own if action in ("insert", "update")]
        kind = [k for k, f in e.schema.fields.items() if not f.virtual]
        kept = [tuple(x.get(k) for k in kind) for x in kept]
        values = values | {name: kept if e.many else kept[0] if kept else None}
    return values


def _insert(engine, given: RecordChange, options: dict) -> dict:
    given = _parents(engine, _ready(given))
    schema = given.schema
    values = {k: v for k, v in given.data.items() if k in schema.fields or k in schema.embeds} | given.changes
    for k, f in schema.fields.items():
        if values.get(k) is None and not f.virtual:
            if f.autogenerate is not None:
                values[k] = f.autogenerate()
            elif k not in given.changes and f.default is not None:
                values[k] = f.default
    key = schema.primary_key
    if len(key) == 1 and values.get(key[0]) is None and schema.type_of(key[0]) in ("id", "integer"):
        column = F.col(f"`{schema.source_of(key[0])}`")
        values[key[0]] = (engine.table(schema.source, schema.prefix).agg(F.max(column)).first()[0] or 0) + 1
    values = _embeds(given, _writable(given, values, "insert"))
    try:
        done = engine.insert_all(schema, [values], **options)
    except ConstraintError as e:
        raise _mapped(given, e) from None
    _publish(engine, done)
    return _children(engine, given, given.data | values)


def _this(given: RecordChange):
    key = given.schema.primary_key
    if not key or any(given.data.get(k) is None for k in key):
        raise QueryError(f"a record of {given.schema.name} is written by its key, which it lacks")
    return from_(given.schema).where(**{k: given.data[k] for k in key})


def _stale(given: RecordChange, options: dict) -> Exception | None:
    if options.get("allow_stale"):
        return None
    if given.stale_field is not None:
        return _Failed(given.add_error(given.stale_field, messages.STALE))
    return StaleEntryError("the record isn't there, or isn't as it was")


def _update(engine, given: RecordChange, options: dict) -> dict:
    given = _parents(engine, _ready(given))
    changes = _embeds(given, _writable(given, given.changes, "update"))
    record = given.data
    if changes or options.get("force"):
        query = _this(given)
        if given.lock is not None:
            k, following = given.lock
            query = query.where(**{k: given.data[k]}) if given.data.get(k) is not None else query.where(lambda r: r[k].is_nil())
            changes = changes | {k: following(given.data.get(k))}
        done = engine.update_all(query.update(set=changes))
        if done.affected.isEmpty():
            if e := _stale(given, options):
                raise e
        else:
            same = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.lit(given.data[k])) for k in given.schema.primary_key])
            try:
                _enforce(engine, given.schema, done.affected, done.table.where(~same))
            except ConstraintError as e:
                raise _mapped(given, e) from None
        _publish(engine, done)
        record = record | changes
    return _children(engine, given, record)


def _delete(engine, given: RecordChange, options: dict) -> dict:
    given = _ready(given)
    query = _this(given)
    if given.lock is not None:
        query = query.where(**{given.lock[0]: given.data[given.lock[0]]})
    for name, a in given.schema.assocs.items():
        if a.through or a.kind == "belongs_to":
            continue
        try:
            _cascade(engine, given, name)
        except ConstraintError as e:
            raise _mapped(given, e) from None
    done = engine.delete_all(query)
    if done.affected.isEmpty() and (e := _stale(given, options)):
        raise e
    _publish(engine, done)
    return given.data


def _cascade(engine, given: RecordChange, name: str) -> None:
    """What becomes of the records associated with a deleted one."""
    a, target, mine, theirs = keys(given.schema, name)
    if a.kind == "many_to_many":
        if a.on_delete == "delete_all":
            column = F.col(f"`{a.join_keys[0]}`")
            engine.states[a.join_through] = engine.table(a.join_through).where(column.isNull() | (column != given.data[given.schema.single_key()]))
        return
    below = from_(target).where(**{theirs: given.data[mine]})
    if a.on_delete == "delete_all":
        _publish(engine, engine.delete_all(below))
    elif a.on_delete == "nilify_all":
        _publish(engine, engine.update_all(below.update(set={theirs: None})))
    else:
        for c in target.constraints:
            if c.kind == "foreign_key" and c.fields == (theirs,) and c.target() is given.schema and engine.exists(below):
                raise ConstraintError(f"constraint {c.name!r} (foreign_key) is broken", kind="foreign_key", name=c.name)


_ACTIONS = {"insert": _insert, "update": _update, "delete": _delete}


def as_change(given, schema: Schema | None = None) -> RecordChange:
    """A change as it is; a record (dict) of a schema as one."""
    if isinstance(given, RecordChange):
        return given
    if isinstance(given, tuple):
        schema, given = given
    if schema is None:
        raise QueryError("a record needs its schema: pass (schema, dict) or a change")
    return changed(schema, given)
