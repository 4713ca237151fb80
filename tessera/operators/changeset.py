"""Row validation on whole tables: each check is a boolean column, the failures of a row are gathered in ``errors``.

errors: array<struct<field, message, validation>>. A null value passes every check but ``required``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import InvalidChangesetError, QueryError
from tessera.functions import types
from tessera.operators import messages
from tessera.plans.schema import Schema

_NONE = "cast(array() as array<struct<field:string,message:string,validation:string>>)"


@dataclass(frozen=True)
class Changeset:
    """Rows with checks. Checks within a row are columns; checks over rows join a flag to the rows first."""

    df: DataFrame
    checks: tuple[tuple[Column, str, str, str], ...] = ()

    def check(self, failed: Column, field: str, message: str, validation: str) -> Changeset:
        return replace(self, checks=(*self.checks, (F.coalesce(failed, F.lit(False)), field, message, validation)))

    # casting

    @staticmethod
    def cast(df: DataFrame, schema: Schema, permitted: list[str]) -> Changeset:
        """Text columns to the schema's types; what can't be cast is null and an error."""
        out, wrong = df, []
        for k in permitted:
            kind = types.spark_type(schema.type_of(k))
            if kind is None or dict(df.dtypes)[k] != "string" or kind.simpleString() == "string":
                continue
            text = F.col(k)
            exact = {"bigint": r"^[+-]?[0-9]+$", "double": r"^[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$", "boolean": "^(true|false|1|0)$"}.get(kind.simpleString())
            fits = text.rlike(exact) if exact else F.lit(True)
            out = out.withColumn(f"__cast_{k}", F.when(fits, text.try_cast(kind)))
            wrong.append(k)
        plain = [F.col(f"__cast_{c}").alias(c) if c in wrong else F.col(c) for c in df.columns]
        flags = [(F.col(c).isNotNull() & F.col(f"__cast_{c}").isNull()).alias(f"__bad_{c}") for c in wrong]
        made = Changeset(out.select(*plain, *flags))
        for c in wrong:
            made = made.check(F.col(f"__bad_{c}"), c, messages.INVALID, "cast")
        return made

    # checks within a row

    def validate_required(self, *fields: str, trim: bool = True) -> Changeset:
        out, kinds = self, dict(self.df.dtypes)
        for f in fields:
            missing = F.col(f).isNull()
            if trim and kinds[f] == "string":
                missing = missing | (F.regexp_replace(F.col(f), r"^\s+|\s+$", "") == "")
            out = out.check(missing, f, messages.BLANK, "required")
        return out

    def validate_format(self, field: str, pattern: str, message: str = messages.FORMAT) -> Changeset:
        return self.check(~F.col(field).rlike(pattern), field, message, "format")

    def validate_inclusion(self, field: str, values, message: str = messages.INVALID) -> Changeset:
        return self.check(~F.col(field).isin(list(values)), field, message, "inclusion")

    def validate_exclusion(self, field: str, values, message: str = messages.RESERVED) -> Changeset:
        return self.check(F.col(field).isin(list(values)), field, message, "exclusion")

    def validate_subset(self, field: str, values, message: str = messages.SUBSET) -> Changeset:
        allowed = F.array(*[F.lit(v) for v in values])
        return self.check(F.size(F.array_except(F.col(field), allowed)) > 0, field, message, "subset")

    def validate_length(self, field: str, is_: int | None = None, min_: int | None = None, max_: int | None = None, count: str = "codepoints") -> Changeset:
        kind = dict(self.df.dtypes)[field]
        many = kind.startswith(("array", "map"))
        size = F.size(field) if many else F.octet_length(field) if count == "bytes" else F.char_length(field)
        what = "item(s)" if many else "byte(s)" if count == "bytes" else "character(s)"
        verb = "have" if many else "be"
        out = self
        if is_ is not None:
            return out.check(size != is_, field, messages.LENGTH["is"].format(verb=verb, n=is_, what=what), "length")
        if min_ is not None:
            out = out.check(size < min_, field, messages.LENGTH["min"].format(verb=verb, n=min_, what=what), "length")
        if max_ is not None:
            # one message a field: too short goes before too long
            over = size > max_ if min_ is None else (size > max_) & ~(size < min_)
            out = out.check(over, field, messages.LENGTH["max"].format(verb=verb, n=max_, what=what), "length")
        return out

    def validate_number(self, field: str, **limits) -> Changeset:
        tests = {
            "less_than": lambda c, n: c >= n,
            "greater_than": lambda c, n: c <= n,
            "less_than_or_equal_to": lambda c, n: c > n,
            "greater_than_or_equal_to": lambda c, n: c < n,
            "equal_to": lambda c, n: c != n,
            "not_equal_to": lambda c, n: c == n,
        }
        out, earlier = self, F.lit(False)
        for name, n in limits.items():
            if name not in tests:
                raise QueryError(f"unknown limit {name!r}")
            failed = F.coalesce(tests[name](F.col(field), n), F.lit(False))
            out, earlier = out.check(failed & ~earlier, field, messages.NUMBER[name].format(n), "number"), earlier | failed
        return out

    def validate_confirmation(self, field: str, message: str = messages.CONFIRMATION) -> Changeset:
        other = f"{field}_confirmation"
        return self.check(F.col(other).isNotNull() & ~F.col(field).eqNullSafe(F.col(other)), other, message, "confirmation")

    def validate_acceptance(self, field: str, message: str = messages.ACCEPTANCE) -> Changeset:
        return self.check(~F.coalesce(F.col(field), F.lit(False)), field, message, "acceptance")

    def validate_change(self, field: str, failed: Column, message: str = messages.INVALID) -> Changeset:
        return self.check(F.col(field).isNotNull() & failed, field, message, "custom")

    def check_constraint(self, name: str, holds: Column, field: str, message: str = messages.INVALID) -> Changeset:
        return self.check(~holds, field, message, name)

    # checks over rows

    def _flagged(self, df: DataFrame) -> Changeset:
        return replace(self, df=df)

    def validate_unique(self, fields: list[str], existing: DataFrame | None = None, message: str = messages.TAKEN) -> Changeset:
        """No two rows with one key, nor a row with a key of ``existing``; keys with a null are never equal."""
        flag = f"__unique_{len(self.checks)}"
        full = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in fields])
        counts = self.df.where(full).groupBy(*fields).agg(F.count(F.lit(1)).alias(flag)).where(F.col(flag) > 1)
        taken = counts.select(*fields)
        if existing is not None:
            taken = taken.union(existing.select(*fields).where(full)).distinct()
        df = self.df.join(taken.withColumn(flag, F.lit(True)), fields, "left")
        return self._flagged(df.select(*self.df.columns, flag)).check(F.col(flag), fields[0], message, "unique")

    def foreign_key(self, field: str, related: DataFrame, key: str, message: str = messages.NO_SUCH) -> Changeset:
        flag = f"__foreign_{len(self.checks)}"
        known = related.select(F.col(key).alias(field)).where(F.col(field).isNotNull()).distinct().withColumn(flag, F.lit(True))
        df = self.df.join(known, field, "left").select(*self.df.columns, flag)
        return self._flagged(df).check(F.col(field).isNotNull() & F.col(flag).isNull(), field, message, "foreign_key")

    assoc_constraint = foreign_key

    def no_assoc(self, key: str, related: DataFrame, field: str, message: str = messages.STILL_ONE) -> Changeset:
        flag = f"__assoc_{len(self.checks)}"
        used = related.select(F.col(field).alias(key)).where(F.col(key).isNotNull()).distinct().withColumn(flag, F.lit(True))
        df = self.df.join(used, key, "left").select(*self.df.columns, flag)
        return self._flagged(df).check(F.col(flag), key, message, "no_assoc")

    def exclusion_constraint(self, low: str, high: str, by: list[str], message: str = messages.EXCLUSION) -> Changeset:
        """No row's range [low, high) meets another's of the same key; found with running maxima, not with pairs."""
        flag = f"__exclusion_{len(self.checks)}"
        order = Window.partitionBy(*by).orderBy(low, high)
        before = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
        after = F.min(low).over(Window.partitionBy(*by).orderBy(low, high).rowsBetween(1, Window.unboundedFollowing))
        meets = F.coalesce(before > F.col(low), F.lit(False)) | F.coalesce(after < F.col(high), F.lit(False))
        return self._flagged(self.df.withColumn(flag, meets)).check(F.col(flag), low, message, "exclusion")

    # results

    def result(self) -> DataFrame:
        """The rows with ``errors`` and ``valid``."""
        found = [
            F.when(failed, F.array(F.struct(F.lit(f).alias("field"), F.lit(m).alias("message"), F.lit(v).alias("validation")))).otherwise(F.expr(_NONE))
            for failed, f, m, v in self.checks
        ]
        errors = F.concat(*found) if found else F.expr(_NONE)
        plain = [c for c in self.df.columns if not c.startswith("__")]
        return self.df.select(*plain, errors.alias("errors")).withColumn("valid", F.size("errors") == 0)

    def traverse_validations(self) -> list[tuple[str, str]]:
        """(field, validation) of every check there is, in order."""
        return [(f, v) for _, f, _, v in self.checks]

    def traverse_errors(self) -> DataFrame:
        """field, message, validation, rows: how often each failure occurs."""
        e = self.result().select(F.explode("errors").alias("e"))
        return e.groupBy("e.field", "e.message", "e.validation").agg(F.count(F.lit(1)).alias("rows"))

    def apply(self) -> DataFrame:
        """The rows, if all are valid."""
        out = self.result()
        bad = out.where("not valid").limit(1).collect()
        if bad:
            raise InvalidChangesetError(f"a row is invalid: {bad[0]}")
        return out.drop("errors", "valid")
