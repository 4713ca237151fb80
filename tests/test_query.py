"""The query layer's golden cases and its errors."""

import datetime as dt

import pytest

from tessera import Changeset, Embed, Engine, Field, Multi, Schema, assoc, belongs_to, from_, has_many, many_to_many, subquery, through, values
from tessera.errors import (
    CastError, CompileError, ConstraintError, InvalidChangesetError, MultipleResultsError, NoPrimaryKeyValueError, NoResultsError, QueryError, StaleEntryError, SubQueryError,
)
from tessera.functions import types
from tessera.operators.associations import assoc_query
from tessera.operators.multi import StepError
from tessera.plans import expr as e
from tessera.plans.expr import avg, count, date_add, datetime_add, desc, exists, fragment, lag, parent_as, row_number, selected_as, sum_, type_, update

STATUS = types.Enum("draft", "published", "deleted")
POST = Schema("Post", "posts", {
    "id": Field("integer", primary_key=True), "title": Field("string", source="post_title"), "visits": "integer", "counter": "integer", "author_id": "integer",
    "posted": "date", "inserted_at": "naive_datetime", "tags": ("array", "integer"), "status": STATUS, "meta": "string", "temp": Field("string", virtual=True),
    "secret": Field("string", load_in_query=False), "fixed": Field("string", writable="never"),
}, {
    "comments": has_many(lambda: COMMENT, "post_id", "id", preload_order=("text",)), "author": belongs_to(lambda: USER, "author_id"),
    "comments_authors": through("comments", "author"), "users": many_to_many(lambda: USER, "posts_users", ("post_id", "user_id")),
})
COMMENT = Schema("Comment", "comments", {"id": Field("integer", primary_key=True), "text": "string", "post_id": "integer", "author_id": "integer"},
    {"post": belongs_to(lambda: POST, "post_id"), "author": belongs_to(lambda: USER, "author_id")})
USER = Schema("User", "users", {"id": Field("integer", primary_key=True), "name": "string"}, {"posts": has_many(lambda: POST, "author_id", "id"), "kept": has_many(lambda: POST, "author_id", "id", where={"status": ("not", None)})})


@pytest.fixture(scope="module")
def engine(spark):
    day, at = dt.date(2014, 1, 1), dt.datetime(2014, 1, 1, 2)
    posts = [(i + 1, f"p{i}", 2**i, i, 1 + i % 3 if i < 6 else None, day, at, [3, 2, 1, 2, 0], "published" if i % 2 else None, '{"a": [{"b": 7}], "n": null}', "s", "x") for i in range(7)]
    comments = [(1, "b", 1, 1), (2, "a", 1, 1), (3, "c", 2, 1), (4, "d", 3, 2)]
    tables = {
        "posts": spark.createDataFrame(posts, "id long, post_title string, visits long, counter long, author_id long, posted date, inserted_at timestamp_ntz, tags array<long>, status string, meta string, secret string, fixed string"),
        "comments": spark.createDataFrame(comments, "id long, text string, post_id long, author_id long"),
        "users": spark.createDataFrame([(1, "ann"), (2, "bob"), (3, "cy")], "id long, name string"),
        "posts_users": spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "post_id long, user_id long"),
    }
    return Engine(spark, tables)


def column(df, name="v"):
    return [r[name] for r in df.collect()]


@pytest.mark.parametrize(
    ("frame", "want"),
    [
        ("ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING", [3, 7, 14, 28, 56, 112, 96]),
        ("ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING", [126, 124, 120, 112, 96, 64, None]),
        ("ROWS CURRENT ROW", [1, 2, 4, 8, 16, 32, 64]),
        ("ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW", [2, 5, 10, 20, 40, 80, 32]),
    ],
)
def test_frames(engine, frame, want):
    q = from_(POST).windows(w={"order_by": lambda p: p.counter, "frame": fragment(frame)})
    assert column(engine.all(q.select(lambda p: {"v": sum_(p.visits).over("w")}).order_by(lambda p: p.counter))) == want


def test_window_counts_and_errors(engine):
    q = from_(COMMENT).order_by("id")
    assert column(engine.all(q.select(lambda c: {"v": count().over()}))) == [4, 4, 4, 4]
    assert column(engine.all(q.select(lambda c: {"v": count().over(partition_by=c.author_id)}))) == [3, 3, 3, 1]
    with pytest.raises(QueryError, match="unknown window"):
        engine.all(q.select(lambda c: {"v": count().over("nope")}))
    with pytest.raises(CompileError, match="needs over"):
        engine.all(q.select(lambda c: {"v": row_number()}))
    with pytest.raises(CompileError, match="there already"):
        q.windows(w={}).windows(w={})
    got = column(engine.all(from_(COMMENT).select(lambda c: {"v": lag(c.text, 1, "none").over(order_by=c.id)}).order_by(lambda c: c.id)))
    assert got == ["none", "b", "a", "c"]


def test_intervals(engine):
    one = from_(POST).where(id=1)
    day = lambda n, unit: column(engine.all(one.select(lambda p: {"v": date_add(p.posted, n, unit)})))[0]
    time = lambda n, unit: column(engine.all(one.select(lambda p: {"v": datetime_add(p.inserted_at, n, unit)})))[0]
    assert day(48, "hour") == dt.date(2014, 1, 3) and day(-1, "month") == dt.date(2013, 12, 1) and day(1, "year") == dt.date(2015, 1, 1)
    assert day(1, "week") == dt.date(2014, 1, 8)
    assert time(1500, "millisecond") == dt.datetime(2014, 1, 1, 2, 0, 1, 500000) and time(1.5, "day") == dt.datetime(2014, 1, 2, 14)
    assert time(-90, "minute") == dt.datetime(2014, 1, 1, 0, 30)
    with pytest.raises(CompileError, match="unknown unit"):
        time(1, "century")
    with pytest.raises(QueryError, match="whole"):
        time(1.5, "month")


def test_aggregates_of_the_engine(engine):
    q = from_(values([{"v": x} for x in (10, 12, 14, 14)], {"v": "integer"})).select(lambda v: {"v": v.v})
    assert engine.aggregate(q, "sum", "v") == 50 and engine.aggregate(q, "avg", "v") == 12.5 and engine.aggregate(q, "count") == 4
    assert engine.aggregate(q.order_by(lambda v: v.v).limit(2), "max", "v") == 12
    assert engine.aggregate(q.distinct(), "count", "v") == 3
    with pytest.raises(QueryError, match="grouped"):
        engine.aggregate(from_(COMMENT).group_by(lambda c: c.post_id), "count")


def test_filters_and_null_rules(engine):
    ids = lambda q: sorted(column(engine.all(q.select(lambda p: {"v": p.id}))))
    assert ids(from_(POST).where(lambda p: p.id.in_([]))) == [] and len(ids(from_(POST).where(lambda p: ~p.id.in_([])))) == 7
    assert ids(from_(POST).where(lambda p: e.wrap(3).in_(p.tags))) == list(range(1, 8))
    assert ids(from_(POST).where(lambda p: p.author_id.is_nil())) == [7]
    assert ids(from_(POST).where(id="3")) == [3]
    for bad in (lambda p: p.id == None, lambda p: p.id != None, lambda p: p.id < None):  # noqa: E711
        with pytest.raises(CompileError, match="is_nil"):
            engine.all(from_(POST).where(bad))
    with pytest.raises(CompileError, match="is_nil"):
        from_(POST).where(id=None)
    with pytest.raises(QueryError, match="comparison"):
        engine.all(from_(POST).where(lambda p: p.id == "1-x"))
    with pytest.raises(QueryError, match="in needs a list"):
        engine.all(from_(POST).where(lambda p: p.id.in_(None)))
    with pytest.raises(QueryError, match="did you mean"):
        engine.all(from_(POST).where(lambda p: p.titel == "x"))
    with pytest.raises(QueryError, match="virtual"):
        engine.all(from_(POST).where(lambda p: p.temp == "x"))
    with pytest.raises(CompileError, match="truth value"):
        engine.all(from_(POST).where(lambda p: p.id == 1 and p.id == 2))


def test_selects(engine):
    one = from_(POST).where(id=1)
    assert "secret" not in engine.all(one).columns and engine.all(one).columns[1] == "title"
    assert engine.one(one.select(lambda p: (p.id, p.title)))[:] == (1, "p0")
    assert engine.one(one.select(lambda p: update(p, title="x"))).title == "x"
    with pytest.raises(QueryError, match="aren't there"):
        engine.all(one.select(lambda p: update(p, nope="x")))
    with pytest.raises(CompileError, match="one select"):
        one.select(["id"]).select(["id"])
    with pytest.raises(QueryError, match="needs a select"):
        engine.all(from_("posts"))
    got = engine.one(one.select(lambda p: {"m": p.meta["a"][0]["b"], "n": p.meta["n"], "t": type_(p.visits, "string"), "s": p.status}))
    assert got[:] == ("7", None, "1", None)
    assert engine.one(from_(POST).where(id=2).select(lambda p: {"s": p.status})).s == "published"
    with pytest.raises(CompileError, match="places"):
        fragment("? + ?", 1)
    assert engine.one(one.select(lambda p: {"v": fragment("concat(?, '\\?', ?)", p.title, "it's")})).v == "p0?it's"
    q = from_(COMMENT).select(lambda c: {"v": selected_as(c.post_id, "k"), "n": count()}).group_by(lambda c: selected_as("k")).order_by(lambda c: selected_as("k"))
    assert [tuple(r) for r in engine.all(q).collect()] == [(1, 2), (2, 1), (3, 1)]


def test_joins(engine):
    q = from_(POST).left_join(COMMENT, as_="c", on=lambda p, c: c.post_id == p.id).where(lambda p: p.id > 2).select(lambda p, *, c: {"p": p.id, "c": c})
    got = sorted(((r.p, r.c and r.c.id) for r in engine.all(q).collect()))
    assert got == [(3, 4), (4, None), (5, None), (6, None), (7, None)]
    with pytest.raises(CompileError, match="takes no on"):
        from_(POST)._join("cross", COMMENT, on=True)
    with pytest.raises(CompileError, match="unknown join"):
        from_(POST).join(COMMENT, how="as_of")
    with pytest.raises(CompileError, match="there already"):
        from_(POST, as_="p").join(COMMENT, as_="p")
    with pytest.raises(QueryError, match="more than the 1"):
        engine.all(from_(POST).where(lambda p, c: c.id == 1))
    with pytest.raises(SubQueryError):
        engine.all(from_(subquery(from_(POST).select(lambda p: (p.id, p.title)))))
    base = from_(POST).join(COMMENT, as_="c", on=lambda p, c: c.post_id == p.id)
    assert base.has_named_binding("c") and not base.exclude("join").has_named_binding("c")
    assert base.with_named_binding("c", lambda q: q) is base
    inner = from_(COMMENT).where(lambda c: (c.post_id == parent_as("p").id) & (c.text > "b")).select({"one": 1})
    assert sorted(column(engine.all(from_(POST, as_="p").where(lambda p: exists(inner)).select(lambda p: {"v": p.id})))) == [2, 3]


def test_order_limits_and_distinct(engine):
    q = from_(POST).order_by(lambda p: desc(p.visits))
    ids = lambda q: column(engine.all(q.select(lambda p: {"v": p.id})))
    assert ids(q.limit(2)) == [7, 6] and ids(q.reverse_order().limit(2)) == [1, 2] and ids(from_(POST).last()) == [7] and ids(from_(POST).first()) == [1]
    assert ids(q.limit(5).first()) == [7] and ids(q.limit(5).last()) == [1]
    tied = from_(COMMENT).order_by(lambda c: c.post_id).limit(1).with_ties().select(lambda c: {"v": c.id})
    assert sorted(column(engine.all(tied))) == [1, 2]
    assert sorted(column(engine.all(from_(COMMENT).order_by(lambda c: c.post_id).offset(1).limit(1).with_ties().select(lambda c: {"v": c.post_id})))) == [1]
    with pytest.raises(QueryError, match="limit"):
        from_(POST).with_ties()
    assert not from_(POST).limit(1).with_ties().limit(2).ties
    first = from_(COMMENT).distinct(lambda c: c.post_id).order_by(lambda c: c.text).select(lambda c: {"v": c.text})
    assert column(engine.all(first)) == ["a", "c", "d"]
    with pytest.raises(QueryError, match="whole number"):
        engine.all(from_(POST).limit("x"))


def test_combinations(engine):
    one = lambda n: from_(values([{"n": n}], {"n": "integer"})).select(lambda v: {"n": v.n})
    both = one(1).union_all(one(2)).union_all(one(1)).union_all(one(2))
    assert sorted(column(engine.all(both), "n")) == [1, 1, 2, 2]
    assert sorted(column(engine.all(one(1).union(one(1)).union(one(3))), "n")) == [1, 3]
    assert column(engine.all(both.except_all(one(1)).order_by(lambda v: v.n)), "n") == [1, 2, 2]


def test_associations_and_preloads(engine):
    q = from_(POST).join(lambda p: assoc(p, "comments_authors"), as_="u").select(lambda p, u: {"p": p.id, "u": u.name})
    assert sorted((r.p, r.u) for r in engine.all(q).collect()) == [(1, "ann"), (2, "ann"), (3, "bob")]
    q = from_(POST).join(lambda p: assoc(p, "users"), as_="u").select(lambda p, u: {"p": p.id, "u": u.name})
    assert sorted((r.p, r.u) for r in engine.all(q).collect()) == [(1, "ann"), (1, "bob"), (2, "cy")]
    posts = {r.id: r for r in engine.all(from_(POST).preload("author", "users", "comments_authors", comments="author")).collect()}
    assert [c.text for c in posts[1].comments] == ["a", "b"] and posts[1].comments[0].author.name == "ann"
    assert posts[7].author is None and posts[7].comments == [] and sorted(u.name for u in posts[1].users) == ["ann", "bob"]
    assert [u.name for u in posts[1].comments_authors] == ["ann"]
    users = {r.id: r for r in engine.all(from_(USER).preload("kept")).collect()}
    assert sorted(p.id for p in users[2].kept) == [2]
    rows = engine.all(from_(POST).where(lambda p: p.id < 3))
    assert sorted(r.id for r in assoc_query(engine, rows, POST, "comments").collect()) == [1, 2, 3]
    own = engine.all(from_(POST).preload(comments=lambda ids: engine.table("comments").where("text <> 'a'"))).where("id = 1").first()
    assert [c.text for c in own.comments] == ["b"]


def test_terminals(engine):
    assert engine.get(POST, 3).title == "p2" and engine.get(POST, 99) is None and engine.get_by(USER, name="bob").id == 2
    with pytest.raises(NoPrimaryKeyValueError):
        engine.get(POST, None)
    with pytest.raises(NoResultsError):
        engine.get_or_fail(POST, 99)
    with pytest.raises(MultipleResultsError):
        engine.one(from_(POST))
    assert engine.exists(from_(POST).where(id=1)) and not engine.exists(from_(POST).where(id=0))
    assert sum(1 for _ in engine.stream(from_(COMMENT))) == 4
    ids = engine.spark.createDataFrame([(3,), (99,), (1,)], "id long").coalesce(1)
    assert [r.record and r.record.title for r in engine.reload(POST, ids).collect()] == ["p2", None, "p0"]
    with pytest.raises(NoResultsError):
        engine.reload(POST, ids, strict=True)
    tenant = Engine(engine.spark, engine.table, prepare=lambda op, q: q.where(lambda first, *_: first.id < 3))
    assert tenant.all(from_(COMMENT)).count() == 2


def test_updates_and_deletes(engine):
    done = engine.update_all(from_(POST).where(id=1).update(set={"title": "new"}, inc={"visits": -1}, push={"tags": "9"}))
    row = done.table.where("id = 1").first()
    assert (row.title, row.visits, row.tags) == ("new", 0, [3, 2, 1, 2, 0, 9]) and done.count == 1 and done.table.count() == 7
    assert engine.update_all(from_(POST).where(id=1).update(pull={"tags": 2})).affected.first().tags == [3, 1, 0]
    with pytest.raises(QueryError, match="twice"):
        engine.update_all(from_(POST).update(set={"visits": 1}, inc={"visits": 1}))
    with pytest.raises(QueryError, match="can't be updated"):
        engine.update_all(from_(POST).update(set={"fixed": "y"}))
    with pytest.raises(QueryError, match="without updates"):
        engine.update_all(from_(POST))
    with pytest.raises(QueryError, match="allows"):
        engine.update_all(from_(POST).limit(1).update(set={"visits": 1}))
    with pytest.raises(CastError):
        engine.update_all(from_(POST).update(set={"visits": "x"}))
    joined = from_(POST).join(COMMENT, on=lambda p, c: c.post_id == p.id)
    done = engine.update_all(joined.update(set=lambda p, c: {"title": c.text}))
    assert done.count == 3 and done.table.count() == 7
    assert engine.delete_all(joined).table.count() == 4 and engine.delete_all(from_(POST)).table.count() == 0
    assert engine.update(POST, 1, {"title": "z"}, lock=("counter", 0)).affected.first().counter == 1
    with pytest.raises(StaleEntryError):
        engine.update(POST, 1, {"title": "z"}, lock=("counter", 5))
    assert engine.delete(POST, 99, allow_stale=True).count == 0


def test_inserts(engine):
    rows = [{"id": 1, "name": "ANN"}, {"id": 9, "name": "new"}]
    with pytest.raises(ConstraintError):
        engine.insert_all(USER, rows)
    again = [{"id": 9, "name": "first"}, {"id": 9, "name": "second"}, {"id": None, "name": "x"}, {"id": None, "name": "y"}]
    with pytest.raises(ConstraintError, match="repeat"):
        engine.insert_all(USER, again, on_conflict="replace_all")
    assert sorted(r.name for r in engine.insert_all(USER, again, on_conflict="nothing").affected.collect()) == ["first", "x", "y"]
    with pytest.raises(QueryError, match="conflict target"):
        engine.insert_all(USER, rows, conflict_target=["id"])
    names = lambda **o: dict(engine.insert_all(USER, rows, **o).table.collect())
    assert names(on_conflict="nothing") == {1: "ann", 2: "bob", 3: "cy", 9: "new"}
    assert names(on_conflict="replace_all")[1] == "ANN"
    upper = from_(USER).where(lambda u: u.id > 1).update(set=lambda u: {"name": fragment("upper(?)", u.name)})
    assert names(on_conflict=upper)[1] == "ann"
    done = engine.insert_all(USER, [{"id": 7, "name": ("placeholder", "n")}, {"id": "8", "name": from_(USER).where(id=2).select(lambda u: {"v": u.name})}], placeholders={"n": "ph"})
    assert dict(done.affected.collect()) == {7: "ph", 8: "bob"}


def test_publish_swaps_the_folder(spark, tmp_path):
    from tessera.operators.dml import publish

    path = str(tmp_path / "t.parquet")
    publish(spark.range(3).toDF("id"), path)
    publish(spark.read.parquet(path).where("id > 0"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2] and [p.name for p in tmp_path.iterdir()] == ["t.parquet"]


def test_multi(engine):
    steps = Multi().put("a", 1).run("b", lambda engine, done: done["a"] + 1).one("c", from_(USER).where(id=2)).exists("d", from_(USER))
    out = steps.merge(lambda done: Multi().put("e", done["b"])).transact(engine)
    assert out.ok and (out.results["b"], out.results["c"].name, out.results["d"], out.results["e"]) == (2, "bob", True, 2)

    def stop(engine, done):
        raise StepError("no")

    out = steps.run("stop", stop).put("after", 1).transact(engine)
    assert (out.ok, out.failed, out.value) == (False, "stop", "no") and "after" not in out.results
    with pytest.raises(CompileError):
        steps.put("a", 2)
    bad = Changeset(engine.table("users")).validate_format("name", "^a")
    out = Multi().run("never", stop).validate("v", bad).transact(engine)
    assert out.failed == "v" and out.results == {} and out.value.count() == 2
    assert [n for n, _ in Multi().put("y", 1).prepend(Multi().put("x", 1)).to_list()] == ["x", "y"]


def test_changesets(spark):
    rows = [("5", "ann@x", 3, [1, 2], True, "p", "p", 1, 3), ("x", " ", -1, [9], False, "p", "q", 2, 5), (None, None, None, None, None, None, None, 5, 6)]
    df = spark.createDataFrame(rows, "age string, email string, n int, tags array<int>, ok boolean, pw string, pw_confirmation string, lo int, hi int")
    schema = Schema("P", None, {"age": "integer", "email": "string"})
    c = Changeset.cast(df, schema, ["age", "email"]).validate_required("email").validate_format("email", "@").validate_number("n", greater_than=0, less_than=3)
    c = c.validate_subset("tags", [1, 2]).validate_acceptance("ok").validate_confirmation("pw").validate_length("email", min_=3, max_=4).exclusion_constraint("lo", "hi", [])
    got = [[(x.field, x.validation) for x in r.errors] for r in c.result().orderBy("lo").collect()]
    assert got[0] == [("n", "number"), ("email", "length"), ("lo", "exclusion")]
    assert got[1] == [("age", "cast"), ("email", "required"), ("email", "format"), ("n", "number"), ("tags", "subset"), ("ok", "acceptance"), ("pw_confirmation", "confirmation"), ("email", "length"), ("lo", "exclusion")]
    assert got[2] == [("email", "required"), ("ok", "acceptance")]
    assert c.result().schema["age"].dataType.simpleString() == "bigint"
    with pytest.raises(InvalidChangesetError):
        c.apply()
    keys = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "e")], "k int, t string")
    taken = spark.createDataFrame([(2,)], "k int")
    assert sorted(r.t for r in Changeset(keys).validate_unique(["k"], taken).result().where("valid").collect()) == ["d", "e"]
    assert sorted(r.t for r in Changeset(keys).foreign_key("k", taken, "k").result().where("valid").collect()) == ["c", "d", "e"]
    assert sorted(r.t for r in Changeset(keys).no_assoc("k", taken, "k").result().where("not valid").collect()) == ["c"]


def test_recursion_goes_deep(engine):
    anchor = from_(values([{"n": 1}], {"n": "integer"})).select(lambda v: {"n": v.n})
    step = from_("t").where(lambda t: t.n < 5).select(lambda t: {"n": t.n + 1})
    q = from_("t").recursive_ctes().with_cte("t", anchor.union_all(step)).select(["n"])
    assert sorted(column(engine.all(q), "n")) == [1, 2, 3, 4, 5]


def test_embedded_schemas_read_paths(engine, spark):
    item = Schema("Item", None, {"price": "integer"})
    order = Schema("O", "o", {"id": Field("integer", primary_key=True)}, embeds={"item": Embed(item), "items": Embed(item, many=True)})
    df = spark.createDataFrame([(1, (5,), [(7,), (8,)])], order.spark_schema(stored=True))
    own = Engine(spark, {"o": df})
    got = own.one(from_(order).select(lambda o: {"a": o.item["price"], "b": o["items"][1]["price"], "avg": o.id}))
    assert (got.a, got.b) == (5, 8)
    assert own.aggregate(from_(order), "avg", "id") == 1 and avg(1).name == "avg"


def test_frames_of_intervals_and_exclusions(spark):
    own = Engine(spark, {"t": spark.createDataFrame([(i, i // 2, dt.datetime(2024, 1, 1 + i // 2), 10**i) for i in range(6)], "id int, g int, at timestamp_ntz, v long")})
    run = lambda f, **spec: [r.v for r in own.all(from_("t").select(lambda t: {"id": t.id, "v": f(t).over(**{k: x(t) if callable(x) else x for k, x in spec.items()})}).order_by("id")).collect()]
    day = "RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW"
    assert run(lambda t: sum_(t.v), order_by=lambda t: t.at, frame=day) == [11, 11, 1111, 1111, 111100, 111100]
    assert run(lambda t: count(), order_by=lambda t: ("desc", t.at), frame="RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND INTERVAL 0 SECOND FOLLOWING") == [4, 4, 4, 4, 2, 2]
    whole = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE "
    assert run(lambda t: sum_(t.v), order_by=lambda t: t.g, frame=whole + "GROUP") == [111100, 111100, 110011, 110011, 1111, 1111]
    assert run(lambda t: sum_(t.v), order_by=lambda t: t.g, frame=whole + "TIES") == [111101, 111110, 110111, 111011, 11111, 101111]
    assert run(lambda t: count(), order_by=lambda t: t.g, frame="GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW EXCLUDE GROUP") == [0, 0, 2, 2, 2, 2]
    assert run(lambda t: sum_(t.v), order_by=lambda t: t.g, frame="GROUPS CURRENT ROW EXCLUDE GROUP") == [None] * 6
    with pytest.raises(QueryError, match="all peers"):
        run(lambda t: count(), order_by=lambda t: t.g, frame="ROWS 1 PRECEDING EXCLUDE TIES")
    with pytest.raises(CompileError, match="intervals"):
        run(lambda t: count(), order_by=lambda t: t.at, frame="RANGE INTERVAL 1 MONTH PRECEDING")


def test_shifts_by_a_column_and_distinct_counts(spark):
    rows = [(i, i % 3 or None, i % 4, "abcab"[i % 5] if i % 7 else None) for i in range(40)]
    own = Engine(spark, {"t": spark.createDataFrame(rows, "id int, p int, k int, s string")})
    q = from_("t").select(lambda t: {"id": t.id, "lead": e.lead(t.id, t.k).over(partition_by=t.p, order_by=t.id), "lag": lag(t.id, t.k, -1).over(partition_by=t.p, order_by=t.id),
        "all": count(t.s, distinct=True).over(partition_by=t.p), "run": count(t.s, distinct=True).over(partition_by=t.p, order_by=t.k), "rows": count(t.s, distinct=True).over(partition_by=t.p, order_by=[t.k, t.id], frame="ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"),
        "near": count(t.s, distinct=True).over(partition_by=t.p, order_by=t.id, frame="ROWS 1 PRECEDING")})
    got = {r.id: r for r in own.all(q).collect()}
    for i, p, k, s in rows:
        mine = [r for r in rows if r[1] == p]
        at = [r[0] for r in mine].index(i)
        values = lambda held: len({r[3] for r in held} - {None})
        assert got[i].lead == (mine[at + k][0] if at + k < len(mine) else None) and got[i].lag == (mine[at - k][0] if at >= k else -1)
        assert got[i].all == values(mine) and got[i].run == values(r for r in mine if r[2] <= k) and got[i].near == values(mine[max(0, at - 1) : at + 1])
        assert got[i].rows == values(r for r in mine if (r[2], r[0]) <= (k, i))
    plan = own.all(q)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and plan.count("collect_set") == 1


def test_ties_rank_only_what_can_be_in(engine, spark):
    own = Engine(spark, {"t": spark.createDataFrame([(i, None if i % 5 == 0 else i % 4) for i in range(50)], "id int, k int")})
    for way in ("asc", "desc", "asc_nulls_first", "desc_nulls_last"):
        for n, skip in ((3, 0), (12, 0), (5, 9), (60, 0)):
            q = from_("t").order_by(lambda t: [(way, t.k)]).limit(n).offset(skip).with_ties().select(lambda t: {"k": t.k})
            null_first = way in ("desc", "desc_nulls_last", "asc_nulls_first") and way != "desc_nulls_last"
            order = sorted((None if i % 5 == 0 else i % 4 for i in range(50)), key=lambda v: ((v is None) != null_first, (v or 0) * (-1 if way.startswith("desc") else 1)))
            last = order[min(len(order), n + skip) - 1]
            want = [v for i, v in enumerate(order) if i >= skip and (i < n + skip or v == last)]
            assert sorted(column(own.all(q), "k"), key=str) == sorted(want, key=str)


def test_records_maps_and_json_nulls(engine):
    one = from_(POST).where(id=1)
    made = engine.one(from_(USER).where(id=1).select(lambda u: e.record(POST, title=u.name, visits=1)))
    assert (made.title, made.visits, made.id, made.temp) == ("ann", 1, None, None)
    with pytest.raises(CompileError, match="aren't fields"):
        e.record(POST, nope=1)
    got = engine.all(from_(USER).select(lambda u: {u.name: u.id, "key": 0})).collect()
    assert sorted(sorted(r.value.items()) for r in got) == [[("ann", 1), ("key", 0)], [("bob", 2), ("key", 0)], [("cy", 3), ("key", 0)]]
    nested = engine.one(from_(POST).where(id=1).left_join(lambda p: assoc(p, "author"), as_="u").select(lambda p, *, u: {"id": p.id, "author": e.struct(u, ["name"])}))
    assert nested.author.name == "ann"
    assert engine.one(one.select(lambda p: {"a": p.meta["n"].is_nil(), "b": p.meta["none"].is_nil(), "c": p.meta["a"][0]["b"].is_nil()}))[:] == (False, True, False)


def test_queries_as_text(engine):
    q = from_(POST, as_="p").left_join(COMMENT, as_="c", on=lambda p, c: c.post_id == p.id).where(lambda p: (p.id > 1) & ~p.title.like("x%")).or_where(id=3)
    q = q.group_by(lambda p: p.id).having(lambda *_: count() > 1).select(lambda p, c: {"id": p.id, "n": count(c.id).filter(c.text == "a")}).order_by(lambda p: desc(p.id)).limit(3).offset(1)
    assert str(q) == (
        "from_(Post, as_='p').join(Comment, how='left', on=c.post_id == p.id, as_='c').where((p.id > 1) & not(like(p.title, 'x%'))).or_where(p.id == 3)"
        ".group_by(p.id).having(count() > 1).select({'id': p.id, 'n': count(c.id).filter(c.text == 'a')}).order_by(('desc', p.id)).limit(3).offset(1)"
    )
    sub = from_(subquery(from_("t").select(["a"]))).join(lambda s: values([{"k": 1}], {"k": "integer"}), on=True).select(lambda s, v: (s.a, e.type_(v.k, "string"), fragment("? + ?", s.a, 1)))
    assert str(sub) == "from_(subquery(from_('t').select(['a']))).join(values(1 rows, ['k']), how='inner', on=True).select((s0.a, type_(v1.k, 'string'), fragment('? + ?', s0.a, 1)))"
    more = from_(USER).with_cte("w", from_("t").select(["a"]), materialized=True).where(lambda u: exists(from_("t").where(lambda t: t.a == parent_as("u").id).select(["a"])))
    more = more.windows(w={"order_by": lambda u: u.id}).select(lambda u: {"n": row_number().over("w"), "d": datetime_add(u.at, 1, "day"), "j": u.meta["a"][0]}).union(from_("t").select(["a"])).lock("FOR UPDATE").preload("posts")
    text = str(more)
    for part in ("with_cte('w', from_('t').select(['a']), materialized=True)", "exists(from_('t').where(t0.a == parent_as('u').id).select(['a']))", "row_number().over('w')", "datetime_add(u0.at, 1, 'day')", "u0.meta['a'][0]", "union(from_('t')", "preload('posts')", "lock('FOR UPDATE')"):
        assert part in text


def test_recursion_over_local_and_staged_steps(engine, monkeypatch):
    anchor = from_(values([{"n": 1, "s": "a"}, {"n": 3, "s": None}], {"n": "integer", "s": "string"})).select(lambda v: {"n": v.n, "s": v.s})
    step = from_("t").select(lambda t: {"n": fragment("(? * 2) % 11", t.n), "s": t.s})
    q = from_("t").recursive_ctes().with_cte("t", anchor.union(step)).select(["n", "s"])
    want = sorted({(pow(2, k, 11) * n % 11, s) for k in range(10) for n, s in ((1, "a"), (3, None))}, key=str)
    for rows in (Engine.LOCAL_ROWS, 1):
        monkeypatch.setattr(Engine, "LOCAL_ROWS", rows)
        assert sorted((tuple(r) for r in engine.all(q).collect()), key=str) == want


def test_tables_of_folders(spark, tmp_path):
    from tessera.sources import folder

    at = str(tmp_path)
    spark.range(2).toDF("id").write.parquet(f"{at}/t.parquet")
    spark.createDataFrame([(1, "x")], "a int, b string").write.option("header", True).csv(f"{at}/c.csv")
    own = Engine(spark, folder(spark, at))
    assert own.all(from_("t").select(["id"])).count() == 2
    spark.range(3).selectExpr("id", "id * 2 AS twice").write.mode("overwrite").parquet(f"{at}/t.parquet")
    assert sorted(column(own.all(from_("t").select(["twice"])), "twice")) == [0, 2, 4]
    assert Engine(spark, folder(spark, at, "csv", header=True)).all(from_("c").select(["b"])).first().b == "x"
    assert folder(spark, at)("none") is None
    spark.range(1).createOrReplaceTempView("only_in_the_catalog")
    assert own.all(from_("only_in_the_catalog").select(["id"])).count() == 1
