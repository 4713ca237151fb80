"""Window functions: named and inline specifications, frame texts, and what Spark has no syntax for."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import CompileError, QueryError
from tessera.plans.expr import Aggregate, Expr, Fragment, Order, WindowFunction, ordered, wrap

_BOUND = r"(UNBOUNDED PRECEDING|UNBOUNDED FOLLOWING|CURRENT ROW|(?:\d+|INTERVAL '?\d+'? \w+) (?:PRECEDING|FOLLOWING))"
_FRAME = re.compile(
    rf"(ROWS|RANGE|GROUPS) (?:BETWEEN {_BOUND} AND {_BOUND}|{_BOUND})(?: EXCLUDE (CURRENT ROW|NO OTHERS|GROUP|TIES))?", re.IGNORECASE
)
#: A window over a whole table is ranked in ranges of about so many rows, and in so many ranges at most.
RANGE_ROWS, MOST_RANGES = 1 << 18, 256
_MICROS = {"week": 604_800_000_000, "day": 86_400_000_000, "hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000, "millisecond": 1000, "microsecond": 1}


def parse_frame(text: str) -> tuple[str, int, int, str]:
    """Kind, first and last offset (intervals in microseconds), and what is excluded."""
    found = _FRAME.fullmatch(" ".join(text.split()))
    if not found:
        raise CompileError(f"frame {text!r} isn't understood")
    kind, low, high, alone, exclude = found.groups()
    low, high = (alone, "CURRENT ROW") if alone else (low, high)

    def offset(bound: str) -> int:
        bound = bound.upper()
        if bound == "CURRENT ROW":
            return 0
        n, _, way = bound.rpartition(" ")
        if n.startswith("INTERVAL"):
            _, n, unit = n.replace("'", "").split()
            if (unit := unit.lower().removesuffix("s")) not in _MICROS or kind.upper() != "RANGE":
                raise CompileError(f"frame {text!r} isn't understood: RANGE takes intervals of {sorted(_MICROS)}")
            n = str(int(n) * _MICROS[unit])
        if n == "UNBOUNDED":
            return Window.unboundedPreceding if way == "PRECEDING" else Window.unboundedFollowing
        return -int(n) if way == "PRECEDING" else int(n)

    return kind.upper(), offset(low), offset(high), (exclude or "NO OTHERS").upper()


def orders(items) -> list[Order]:
    """Order terms as given: expressions, Order, or (direction, expression)."""
    out = []
    if isinstance(items, tuple) and len(items) == 2 and isinstance(items[0], str) and items[0].split("_")[0] in ("asc", "desc"):
        items = [items]
    for x in items if isinstance(items, (list, tuple)) else [items]:
        if isinstance(x, tuple) and len(x) == 2 and isinstance(x[0], str):
            out.append(Order(wrap(x[1]), x[0]))
        else:
            out.append(x if isinstance(x, Order) else Order(wrap(x)))
    return out


def build_over(ctx, function: Expr, window):
    spec = ctx.window(window) if isinstance(window, str) else window
    unknown = spec.keys() - {"partition_by", "order_by", "frame"}
    if unknown:
        raise CompileError(f"unknown window options {sorted(unknown)}")
    parts, made = spec.get("partition_by", []), len(ctx.pending)
    parts = [wrap(p).build(ctx) for p in (parts if isinstance(parts, (list, tuple)) else [parts])]
    terms = [o.column(ctx) for o in orders(spec.get("order_by", []))]
    whole = Window.partitionBy(*parts)
    w = whole.orderBy(*terms) if terms else whole
    excluded = "NO OTHERS"
    if (frame := spec.get("frame")) is not None:
        text = "?".join(frame.parts()) if isinstance(frame, Fragment) else frame
        if isinstance(frame, Fragment):
            for a in frame.args:
                text = text.replace("?", str(a.value), 1)
        kind, low, high, excluded = parse_frame(text)
        if kind == "GROUPS":
            nth = ctx.before_select(F.dense_rank().over(w))
            w = whole.orderBy(nth).rangeBetween(low, high)
        elif kind == "RANGE" and "INTERVAL" in text.upper():
            (term,) = orders(spec.get("order_by", []))
            w = whole.orderBy(ordered(F.unix_micros(term.expr.build(ctx).cast("timestamp")), term.direction)).rangeBetween(low, high)
        else:
            w = w.rowsBetween(low, high) if kind == "ROWS" else w.rangeBetween(low, high)
        if excluded in ("GROUP", "TIES") and (not low <= 0 <= high or kind == "ROWS" and (low, high) != (Window.unboundedPreceding, Window.unboundedFollowing)):
            raise QueryError(f"EXCLUDE {excluded} needs a frame that holds all peers of its row")
    if isinstance(function, WindowFunction):
        if excluded != "NO OTHERS":
            raise QueryError("EXCLUDE is for sum and count only")
        return _function(ctx, function, w, whole, terms, parts, orders(spec.get("order_by", [])))
    if isinstance(function, Aggregate):
        if function.distinct:
            return _count_distinct(ctx, function, w, whole, parts, terms, spec.get("frame") is not None and (kind, low, high), made)
        value = function.build(ctx, over=True).over(w)
        if excluded == "NO OTHERS":
            return value
        if function.name not in ("count", "sum"):
            raise QueryError("EXCLUDE is for sum and count only")
        own = F.lit(1) if function.arg is None else function.arg.build(ctx)
        if function.condition is not None:
            own = F.when(function.condition.build(ctx), own)
        gone, gone_sum = F.when(own.isNull(), 0).otherwise(1), F.coalesce(own, F.lit(0))
        if excluded in ("GROUP", "TIES"):
            # by the order of the window itself, so that a task sorts its rows once
            peers = whole.orderBy(*terms).rangeBetween(Window.currentRow, Window.currentRow) if terms else whole
            mine, mine_sum = (gone, gone_sum) if excluded == "TIES" else (F.lit(0), F.lit(0))
            gone, gone_sum = F.count(own).over(peers) - mine, F.coalesce(F.sum(own).over(peers), F.lit(0)) - mine_sum
        others = F.count(own).over(w) - gone
        return others if function.name == "count" else F.when(others > 0, value - gone_sum)
    if isinstance(function, Fragment):
        return function.build(ctx).over(w)
    raise CompileError("over() needs an aggregate or a window function")


def _count_distinct(ctx, function: Aggregate, w, whole, parts, terms, frame, made: int):
    """Over whole partitions by ranks, over running frames by first occurrences; other frames gather what they hold."""
    value = function.arg.build(ctx)
    if function.condition is not None:
        value = F.when(function.condition.build(ctx), value)
    unbounded = (Window.unboundedPreceding, Window.unboundedFollowing)
    if not function.arg.has_aggregate():
        if not terms and not frame or frame and frame[1:] == unbounded:
            # before others, unless it uses columns made for it: the other windows' rows are in order then, and a task sorts them once
            first = not terms and len(ctx.pending) == made
            place = ctx.before_select(F.dense_rank().over(whole.orderBy(value.asc_nulls_last())), first)
            return F.coalesce(F.max(F.when(value.isNotNull(), place)).over(whole), F.lit(0)).cast("long")
        if terms and (not frame or frame[0] in ("ROWS", "RANGE") and frame[1:] == (Window.unboundedPreceding, Window.currentRow)):
            held = ctx.before_select(value)
            nth = ctx.before_select(F.row_number().over(Window.partitionBy(*parts, held).orderBy(*terms)))
            return F.sum(F.when(held.isNotNull() & (nth == 1), 1).otherwise(0)).over(w).cast("long")
    return F.size(function.build(ctx, over=True).over(w)).cast("long")


def _shifted(ctx, value, offset, parts, ranked):
    """struct<v> of the row so many places on: rows are numbered and joined with themselves by number."""
    keys = [ctx.before_select_name(p) for p in parts]
    nth = ctx.before_select_name(F.row_number().over(ranked))
    aim = ctx.before_select_name(F.col(nth) + offset)
    held = ctx.before_select_name(F.struct(value.alias("v")))
    name = f"{held}_at"

    def step(df):
        there = df.select(*[F.col(k).alias(f"{name}_{i}") for i, k in enumerate(keys)], F.col(nth).alias(f"{name}_n"), F.col(held).alias(name))
        same = F.col(aim) == F.col(f"{name}_n")
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"{name}_{i}"))
        return df.join(there, same, "left")

    return ctx.before_select_step(name, step)


def _key_of(column, kind: T.DataType):
    """A column in the same order whose values pass through Python unchanged, None where there is none."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), column)
    if isinstance(kind, T.StringType) and kind == T.StringType() or isinstance(kind, (T.IntegralType, T.DoubleType, T.FloatType, T.DecimalType, T.DateType, T.BooleanType)):
        return column
    return None


def _before(terms, bound, kinds):
    """Whether a row comes before the bound in the order of the terms, (column, direction)."""
    out = F.lit(False)
    for (key, direction), v, kind in reversed(list(zip(terms, bound, kinds))):
        down = direction.startswith("desc")
        nulls_first = direction.endswith("nulls_first") or down and not direction.endswith("nulls_last")
        if v is None:
            less, same = F.lit(False) if nulls_first else key.isNotNull(), key.isNull()
        else:
            at = F.lit(v).cast(kind)
            less, same = F.coalesce(key > at if down else key < at, F.lit(nulls_first)), F.coalesce(key == at, F.lit(False))
        out = less | same & out
    return out


def _ranked(ctx, name: str, sorting: list[Order]):
    """row_number or rank over a whole table: numbers within ranges of the order, and how many rows the ranges before have.

    Where a table has more than RANGE_ROWS rows a sample gives the ranges' bounds, so no task sorts the whole table. Rows
    that are equal by all terms are in one range.
    """
    held = [ctx.before_select_name(o.expr.build(ctx)) for o in sorting]
    out = ctx.before_select_name(F.lit(None))  # a name; the step below makes the column
    ctx.pending.pop()

    def step(df):
        function = getattr(F, name)()
        by = [ordered(F.col(h), o.direction) for h, o in zip(held, sorting)]
        plain = df.withColumn(out, function.over(Window.orderBy(*by)).cast("long"))
        keys = [_key_of(F.col(h), df.schema[h].dataType) for h in held]
        plan = df._jdf.queryExecution().analyzed()
        # the rows are read several times, so they must be the same each time
        if any(k is None for k in keys) or not plan.deterministic() or re.search(r"Limit |Offset |Sample ", plan.toString()):
            return plain
        only = df.select(*[k.alias(h) for k, h in zip(keys, held)])
        rows = only.count()
        parts = min(-(-rows // RANGE_ROWS), MOST_RANGES)
        if parts < 2:
            return plain
        sample = only.sample(min(1.0, 100 * parts / rows), 7).orderBy(*by).collect()
        bounds = list(dict.fromkeys(tuple(sample[len(sample) * i // parts]) for i in range(1, parts))) if sample else []
        terms = [(k, o.direction) for k, o in zip(keys, sorting)]
        kinds = [only.schema[h].dataType for h in held]

        def place(low: int, high: int):
            if low == high:
                return F.lit(low)
            mid = (low + high) // 2
            return F.when(_before(terms, bounds[mid], kinds), place(low, mid)).otherwise(place(mid + 1, high))

        df = df.withColumn(f"{out}_range", place(0, len(bounds)))
        sizes = df.groupBy(F.col(f"{out}_range").alias(f"{out}_of")).agg(F.count(F.lit(1)).alias(f"{out}_rows"))
        up_to = F.sum(f"{out}_rows").over(Window.orderBy(f"{out}_of")) - F.col(f"{out}_rows")
        skipped = sizes.select(f"{out}_of", up_to.alias(f"{out}_skip"))
        within = function.over(Window.partitionBy(f"{out}_range").orderBy(*by))
        numbered = df.repartition(parts, f"{out}_range").withColumn(out, within)
        numbered = numbered.join(F.broadcast(skipped), F.col(f"{out}_range") == F.col(f"{out}_of"))
        return numbered.withColumn(out, (F.col(out) + F.col(f"{out}_skip")).cast("long"))

    return ctx.before_select_step(out, step)


def _function(ctx, f: WindowFunction, w, whole, terms, parts, sorting):
    ranked = w if terms else whole.orderBy(F.lit(1))
    if f.name in ("percent_rank", "cume_dist"):
        return getattr(F, f.name)().over(ranked)
    if f.name in ("row_number", "rank") and terms and not parts and ctx.parent is None and not ctx.aggregated:
        return _ranked(ctx, f.name, sorting)
    if f.name in ("row_number", "rank", "dense_rank"):
        return getattr(F, f.name)().over(ranked).cast("long")
    if f.name == "ntile":
        return F.ntile(f.args[0]).over(ranked).cast("long")
    value = f.args[0].build(ctx)
    if f.name in ("first_value", "last_value"):
        return getattr(F, f.name)(value).over(w)
    if f.name == "nth_value":
        return F.nth_value(value, f.args[1]).over(ranked)
    offset, default = f.args[1], f.args[2]
    sign = 1 if f.name == "lead" else -1
    if isinstance(offset, int):
        # a default is a value of the row, so it is put in where the partition has no such row
        shifted = getattr(F, f.name)(F.struct(value.alias("v")), offset).over(ranked)
        plain = shifted["v"]
        return plain if default is None else F.when(shifted.isNull(), default.build(ctx)).otherwise(plain)
    if not any(a.has_aggregate() for a in (f.args[0], wrap(offset))):
        found = _shifted(ctx, value, sign * wrap(offset).build(ctx), parts, ranked)
        return found["v"] if default is None else F.when(found.isNull(), default.build(ctx)).otherwise(found["v"])
    nth = F.row_number().over(ranked) + sign * wrap(offset).build(ctx)
    all_rows = F.collect_list(F.struct(value.alias("v"))).over(
        ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    found = F.when(nth >= 1, F.try_element_at(all_rows, nth.cast("int")))
    return found["v"] if default is None else F.when(found.isNull(), default.build(ctx)).otherwise(found["v"])
