"""Named steps run in order: a later step sees the results of those before, the first error stops the run.

Writes are functions from tables to tables: a later step sees the new states of earlier ones, but nothing is stored until the
tables named in ``paths`` are swapped in together at the end.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from tessera.errors import CompileError, InvalidChangesetError
from tessera.operators.changeset import Changeset
from tessera.operators.dml import Written, publish_all
from tessera.operators.persist import as_change, save
from tessera.operators.record import RecordChange
from tessera.plans.query import Query

_SINGLE = ("insert", "update", "insert_or_update", "delete")


class StepError(Exception):
    """Raised inside a step to stop the run with a value."""

    def __init__(self, value=None):
        super().__init__(repr(value))
        self.value = value


@dataclass(frozen=True)
class Outcome:
    ok: bool
    results: dict[str, Any]
    failed: str | None = None
    value: Any = None


@dataclass(frozen=True)
class Multi:
    steps: tuple[tuple[str, str, Any], ...] = ()

    def _add(self, name: str, kind: str, what) -> Multi:
        if name in {n for n, _, _ in self.steps}:
            raise CompileError(f"step {name!r} is there already")
        return replace(self, steps=(*self.steps, (name, kind, what)))

    def put(self, name: str, value) -> Multi:
        return self._add(name, "put", value)

    def run(self, name: str, function: Callable[[Any, dict], Any]) -> Multi:
        """function(engine, results) gives the step's result; StepError stops."""
        return self._add(name, "run", function)

    def error(self, name: str, value) -> Multi:
        return self._add(name, "error", value)

    def validate(self, name: str, changeset: Changeset) -> Multi:
        """Checked before any step runs."""
        return self._add(name, "validate", changeset)

    def all(self, name: str, query) -> Multi:
        return self._add(name, "all", query)

    def one(self, name: str, query) -> Multi:
        return self._add(name, "one", query)

    def exists(self, name: str, query) -> Multi:
        return self._add(name, "exists", query)

    def insert(self, name: str, record, **options) -> Multi:
        """record: a change, (schema, dict), or a function of the results so far that gives one; likewise in the next three."""
        return self._add(name, "insert", (record, options))

    def update(self, name: str, change, **options) -> Multi:
        return self._add(name, "update", (change, options))

    def insert_or_update(self, name: str, change, **options) -> Multi:
        return self._add(name, "insert_or_update", (change, options))

    def delete(self, name: str, change, **options) -> Multi:
        return self._add(name, "delete", (change, options))

    def insert_all(self, name: str, target, rows, **options) -> Multi:
        return self._add(name, "insert_all", (target, rows, options))

    def update_all(self, name: str, query) -> Multi:
        return self._add(name, "update_all", query)

    def delete_all(self, name: str, query) -> Multi:
        return self._add(name, "delete_all", query)

    def merge(self, function: Callable[[dict], Multi]) -> Multi:
        """Steps made from the results so far."""
        return replace(self, steps=(*self.steps, (f"__merge_{len(self.steps)}", "merge", function)))

    def append(self, other: Multi) -> Multi:
        out = self
        for step in other.steps:
            out = out._add(*step)
        return out

    def prepend(self, other: Multi) -> Multi:
        return other.append(self)

    def to_list(self) -> list[tuple[str, str]]:
        return [(n, k) for n, k, _ in self.steps]

    def inspect(self, show: Callable[[dict], None] = print) -> Multi:
        return replace(self, steps=(*self.steps, (f"__inspect_{len(self.steps)}", "inspect", show)))

    def transact(self, engine, paths: dict[str, str] | None = None) -> Outcome:
        """Run the steps; if all succeed, the tables of written steps, or of sources, named in ``paths`` are published."""
        results: dict[str, Any] = {}
        engine = engine.overlay()
        for name, kind, what in self.steps:
            if kind == "validate":
                try:
                    results[name] = what.apply()
                except InvalidChangesetError:
                    return Outcome(False, {}, name, what.result().where("not valid"))
            elif kind == "error":
                return Outcome(False, {}, name, what)
            elif kind in _SINGLE and isinstance(what[0], RecordChange) and not what[0].valid:
                return Outcome(False, {}, name, what[0])
        waiting = list(self.steps)
        while waiting:
            name, kind, what = waiting.pop(0)
            try:
                if kind == "merge":
                    more = what(results)
                    if clash := {n for n, _, _ in more.steps} & (results.keys() | {n for n, _, _ in waiting}):
                        raise CompileError(f"steps {sorted(clash)} are there already")
                    waiting = [*more.steps, *waiting]
                elif kind == "inspect":
                    what(results)
                elif kind != "validate":
                    results[name] = self._step(engine, kind, what, results)
            except StepError as e:
                return Outcome(False, results, name, e.value)
        states = {}
        for name, path in (paths or {}).items():
            if isinstance(results.get(name), Written):
                states[path] = results[name].stored()
            elif name in engine.states:
                states[path] = engine.states[name]
        publish_all(engine.spark, states)
        return Outcome(True, results)

    def _step(self, engine, kind: str, what, results: dict):
        if kind == "put":
            return what
        if kind == "error":
            raise StepError(what)
        if kind == "run":
            return what(engine, results)
        if callable(what) and not isinstance(what, Query):
            what = what(results)
        if kind == "insert_all":
            target, rows, options = what
            done = engine.insert_all(target, rows(results) if callable(rows) else rows, **options)
        elif kind in _SINGLE:
            record, options = what
            record = as_change(record(results) if callable(record) else record)
            saved = save(engine, kind, record, **options)
            if not saved.ok:
                raise StepError(saved.change)
            engine.states |= saved.tables
            return saved.record
        else:
            done = getattr(engine, kind)(what)
        if isinstance(done, Written) and done.source is not None:
            engine.states[done.source] = done.stored()
        return done
