"""Queries as text: every clause in the order it was given, functions of bindings as the expressions they make."""

from __future__ import annotations

from tessera.plans import expr as e
from tessera.plans.query import Binding, Query, SubQuery, Values

_ALIASES = "abcdefghijklmnopqrstuvwxyz"


class _Names:
    """A name for each binding: its own, or a letter from its source with its place."""

    def __init__(self, query: Query):
        self.of = {}
        for b, source in zip(query.bindings, [query.source, *(j.source for j in query.joins)]):
            first = source_text(source).lstrip("'")[:1].lower()
            self.of[b._index] = b._name or f"{first if first in _ALIASES else 'b'}{b._index}"

    def __call__(self, binding: Binding) -> str:
        return self.of.get(binding._index, f"b{binding._index}")


def source_text(source) -> str:
    if source.schema is not None and source.kind == "table":
        return source.schema.name
    if source.kind == "query":
        return f"subquery({inspect_query(source.value)})"
    if source.kind == "fragment":
        return expression(source.value, str)
    if source.kind == "values":
        held: Values = source.value
        return f"values({len(held.rows)} rows, {sorted(held.types)})"
    return {"table": repr(source.value), "frame": "DataFrame", "assoc": "assoc"}[source.kind]


def expression(x, name) -> str:
    """Text of an expression; ``name`` gives a binding's name."""
    show = lambda v: expression(v, name)
    if isinstance(x, Binding):
        return name(x)
    if isinstance(x, e.Lit):
        return show(x.value) if isinstance(x.value, (list, tuple, dict)) else repr(x.value)
    if isinstance(x, e.Param):
        return f"^{x.value!r}" + (f" as {x.as_type!r}" if x.as_type else "")
    if isinstance(x, e.Ref):
        return f"{name(x.binding)}.{x.name}"
    if isinstance(x, e.ParentRef):
        return f"parent_as({x.parent!r}).{x.name}"
    if isinstance(x, (e.Compare, e.Arithmetic)):
        return f"{_inner(x.left, show)} {x.op} {_inner(x.right, show)}"
    if isinstance(x, e.Logic):
        return f"{_inner(x.left, show)} {'&' if x.op == 'and' else '|'} {_inner(x.right, show)}"
    if isinstance(x, e.Member):
        return f"{_inner(x.item, show)}.in_({show(x.values)})"
    if isinstance(x, e.Aggregate):
        args = [show(x.arg)] if x.arg is not None else []
        out = f"{x.name}({', '.join(args + ['distinct=True'] * x.distinct)})"
        return out + (f".filter({show(x.condition)})" if x.condition is not None else "")
    if isinstance(x, e.Over):
        return f"{show(x.function)}.over({show(x.window)})"
    if isinstance(x, (e.Function, e.WindowFunction)):
        return f"{x.name}({', '.join(show(a) for a in x.args if a is not None)})"
    if isinstance(x, e.Fragment):
        return f"fragment({', '.join([repr(x.sql), *(show(a) for a in x.args)])})"
    if isinstance(x, e.Identifier):
        return f"identifier({x.name!r})"
    if isinstance(x, e.Splice):
        return f"splice({list(x.values)!r})"
    if isinstance(x, e.TupleOf):
        return f"row({', '.join(show(i) for i in x.items)})"
    if isinstance(x, e.SelectedAs):
        return f"selected_as({show(x.expr)}, {x.name!r})"
    if isinstance(x, e.AliasRef):
        return f"selected_as({x.name!r})"
    if isinstance(x, e.Typed):
        return f"type_({show(x.expr)}, {x.as_type!r})"
    if isinstance(x, e.JsonPath):
        return show(x.expr) + "".join(f"[{show(p) if isinstance(p, e.Expr) else repr(p)}]" for p in x.path)
    if isinstance(x, e.IntervalAdd):
        return f"{x.to}_add({show(x.expr)}, {show(x.n)}, {x.unit!r})"
    if isinstance(x, e.Whole):
        return name(x.binding) if x.fields is None else f"struct({name(x.binding)}, {list(x.fields)!r})"
    if isinstance(x, (e.Exists, e.Quantified)):
        return f"{'exists' if isinstance(x, e.Exists) else x.kind}({show(x.query)})"
    if isinstance(x, e.Sub):
        return show(x.query)
    if isinstance(x, e.Merge):
        return f"merge({show(x.left)}, {show(x.right)})"
    if isinstance(x, e.Updated):
        return f"update({', '.join([show(x.base), *(f'{k}={show(v)}' for k, v in x.changes.items())])})"
    if isinstance(x, e.NewRecord):
        return f"record({', '.join([x.schema.name, *(f'{k}={show(v)}' for k, v in x.values.items())])})"
    if isinstance(x, e.Order):
        return f"({x.direction!r}, {show(x.expr)})"
    if isinstance(x, SubQuery):
        return f"subquery({inspect_query(x.query)})"
    if isinstance(x, Query):
        return inspect_query(x)
    if isinstance(x, dict):
        return "{" + ", ".join(f"{show(k) if isinstance(k, e.Expr) else repr(k)}: {show(v)}" for k, v in x.items()) + "}"
    if isinstance(x, (list, tuple)):
        inner = ", ".join(show(v) for v in x)
        return f"[{inner}]" if isinstance(x, list) else f"({inner}{',' * (len(x) == 1)})"
    return repr(x)


def _inner(x, show) -> str:
    return f"({show(x)})" if isinstance(x, (e.Logic, e.Compare, e.Arithmetic)) else show(x)


def inspect_query(query: Query) -> str:
    """One line: the source, then each clause as the call that would add it."""
    name = _Names(query)
    show = lambda part: expression(query.resolve(part), name)
    label = lambda own: f", as_={own!r}" if own else ""
    out = [f"from_({source_text(query.source)}{label(query.name)})"]
    for cte, held, materialized, operation in query.ctes:
        extra = (f", materialized={materialized}" if materialized is not None else "") + (f", operation={operation!r}" if operation != "all" else "")
        out.append(f"with_cte({cte!r}, {expression(held, name)}{extra})")
    if query.recursive:
        out.append("recursive_ctes()")
    for i, j in enumerate(query.joins, 1):
        if j.assoc is not None:
            to = f"assoc({name.of[j.assoc[0]]}, {j.assoc[1]!r})"
        else:
            to = source_text(j.source)
        on = ""
        if j.on is not None:
            found = query.resolve(j.on)
            on = ", on=" + expression(found, name)
        out.append(f"join({to}, how={j.how!r}{on}{label(j.name)})")
    out += [f"{'where' if op == 'and' else 'or_where'}({show(p)})" for op, p in query.wheres]
    out += [f"group_by({show(p)})" for p in query.group_bys]
    out += [f"{'having' if op == 'and' else 'or_having'}({show(p)})" for op, p in query.havings]
    for w, spec in query.windows_:
        held = {k: query.resolve(v) for k, v in query.resolve(spec).items()}
        out.append(f"windows({w}={expression(held, name)})")
    if query.select_ is not None:
        out.append(f"select({show(query.select_)})")
    out += [f"select_merge({show(p)})" for p in query.merges]
    if query.distinct_ is not None:
        out.append(f"distinct({show(query.distinct_)})")
    out += [f"{kind}({inspect_query(other)})" for kind, other in query.combinations]
    out += [f"order_by({show(p)})" for p in query.order_bys]
    if query.limit_ is not None:
        out.append(f"limit({show(query.limit_)})" + ".with_ties()" * query.ties)
    if query.offset_ is not None:
        out.append(f"offset({show(query.offset_)})")
    out += [f"update({op}={show(fields)})" for op, fields in query.updates]
    out += [f"preload({show(p) if callable(p) else repr(p)})" for p in query.preloads]
    if query.lock_:
        out.append(f"lock({query.lock_!r})")
    if query.prefix_:
        out.append(f"put_query_prefix({query.prefix_!r})")
    return ".".join(out)
