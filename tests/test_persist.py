"""Writing single records: constraints, associations, embeds, locks, cascades, named steps, preloads from joins, publishing."""

import re

import pytest

from tessera import Embed, Engine, Field, Multi, RecordChange, Schema, assoc, belongs_to, change, check, foreign_key, from_, has_many, has_one, many_to_many, unique
from tessera.errors import ConstraintError, InvalidChangesetError, QueryError, StaleEntryError
from tessera.operators.associations import assoc_loaded, build_assoc
from tessera.operators.dml import Folders, publish, publish_all
from tessera.plans.expr import fragment

AUTHOR = Schema("Author", "authors", {"id": Field("integer", primary_key=True), "name": "string", "age": Field("integer", default=18), "born": Field("string", writable="insert"), "version": "integer"}, {
    "books": has_many(lambda: BOOK, "author_id", "id", on_replace="delete", on_delete="delete_all"),
    "kept": has_many(lambda: BOOK, "author_id", "id", where={"title": "kept"}, on_replace="nilify"),
    "card": has_one(lambda: CARD, "author_id", "id", on_replace="update"),
    "tags": many_to_many(lambda: TAG, "authors_tags", ("author_id", "tag_id"), on_replace="delete", on_delete="delete_all"),
}, constraints=[unique("authors_name_index", "name"), check("age_is_positive", "age > 0")])
BOOK = Schema("Book", "books", {"id": Field("integer", primary_key=True), "title": Field("string", source="book_title"), "author_id": "integer"},
    {"author": belongs_to(lambda: AUTHOR, "author_id")}, constraints=[foreign_key("books_author_id_fkey", "author_id", lambda: AUTHOR)])
CARD = Schema("Card", "cards", {"id": Field("integer", primary_key=True), "code": "string", "author_id": "integer"}, {"author": belongs_to(lambda: AUTHOR, "author_id")})
TAG = Schema("Tag", "tags", {"id": Field("integer", primary_key=True), "name": "string"})


@pytest.fixture
def engine(spark):
    return Engine(spark, {
        "authors": spark.createDataFrame([(1, "ann", 30, "x", 1), (2, "bob", 40, "y", None)], "id long, name string, age long, born string, version long"),
        "books": spark.createDataFrame([(1, "one", 1), (2, "two", 1), (3, "kept", 2)], "id long, book_title string, author_id long"),
        "cards": spark.createDataFrame([(1, "c1", 1)], "id long, code string, author_id long"),
        "tags": spark.createDataFrame([(1, "red"), (2, "blue")], "id long, name string"),
        "authors_tags": spark.createDataFrame([(1, 1)], "author_id long, tag_id long"),
    })


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_insert_and_its_constraints(engine):
    new = change(AUTHOR, {}, {"name": "cy"})
    done = engine.insert(new)
    assert done.ok and done.record == {"name": "cy", "id": 3, "age": 18}
    assert rows(done.tables["authors"], "id", "name") == [(1, "ann"), (2, "bob"), (3, "cy")]
    with pytest.raises(ConstraintError, match="authors_name_index"):
        engine.insert(change(AUTHOR, {}, {"name": "ann"}))
    for options in ({}, {"name": "name_index", "match": "suffix"}, {"name": "authors_", "match": "prefix"}, {"name": re.compile("_name_")}):
        taken = engine.insert(change(AUTHOR, {}, {"name": "ann"}).unique_constraint("name", **options))
        assert not taken.ok and taken.change.errors == (("name", "has already been taken"),) and not taken.tables
    low = engine.insert(change(AUTHOR, {}, {"name": "dy", "age": -1}).check_constraint("age", "age_is_positive"))
    assert low.change.errors == (("age", "is invalid"),)
    lost = engine.insert(change(BOOK, {}, {"title": "t", "author_id": 9}).foreign_key_constraint("author_id"))
    assert lost.change.errors == (("author_id", "does not exist"),)
    again = engine.insert(change(AUTHOR, {"id": 1, "name": "z"}, state="built").unique_constraint("id", "authors_pkey"))
    assert again.change.errors == (("id", "has already been taken"),)
    assert not engine.insert(RecordChange(AUTHOR, {}).add_error("name", "bad")).ok
    assert engine.insert((AUTHOR, {"id": 1, "name": "ANN"}), on_conflict="replace_all").tables["authors"].count() == 2
    with pytest.raises(ConstraintError):
        engine.insert_all(AUTHOR, [{"id": 7, "name": "ann"}])
    assert engine.insert_all(AUTHOR, [{"id": 7, "name": "gil"}], returning=["id"]).affected.columns == ["id"]
    same = engine.insert_all(BOOK, [{"id": 1, "title": "one", "author_id": 1}, {"id": 2, "title": "new", "author_id": 1}], on_conflict="replace_all")
    assert rows(same.affected, "id") == [(2,)]


def test_update_lock_and_states(engine):
    ann = {"id": 1, "name": "ann", "age": 30, "version": 1}
    done = engine.update(change(AUTHOR, ann, {"age": 31}).optimistic_lock("version"))
    assert done.ok and done.record["version"] == 2 and rows(done.tables["authors"], "id", "age", "born") == [(1, 31, "x"), (2, 40, "y")]
    old = change(AUTHOR, ann | {"version": 7}, {"age": 31}).optimistic_lock("version")
    with pytest.raises(StaleEntryError):
        engine.update(old)
    assert engine.update(old.stale_error("id")).change.errors == (("id", "is stale"),)
    assert engine.update(old, allow_stale=True).ok
    assert engine.update(change(AUTHOR, ann)).tables == {}
    clash = change(AUTHOR, ann, {"name": "bob"}).unique_constraint("name")
    assert engine.update(clash).change.errors == (("name", "has already been taken"),)
    assert engine.update(change(AUTHOR, ann, {"born": "z"})).tables == {}
    strict = Schema("S", "authors", {"id": Field("integer", primary_key=True), "born": Field("string", writable="insert", on_writable_violation="raise")})
    with pytest.raises(QueryError, match="isn't written"):
        engine.update(change(strict, {"id": 1, "born": "x"}, {"born": "z"}))
    assert engine.insert_or_update(change(AUTHOR, ann, {"age": 5})).tables["authors"].count() == 2
    assert engine.insert_or_update(change(AUTHOR, {}, {"name": "new"})).tables["authors"].count() == 3
    seen = engine.update(change(AUTHOR, ann).prepare_changes(lambda c: c.put_change("age", 99)))
    assert seen.record["age"] == 99
    with pytest.raises(QueryError, match="by its key"):
        engine.update(change(AUTHOR, {"name": "x"}, {"age": 1}))


def test_cast_assoc_inserts_updates_and_replaces(engine):
    made = change(AUTHOR, {}, {"name": "cy"}).cast_assoc("books", {"books": [{"title": "a"}, {"title": "b"}]}).cast_assoc("card", {"card": {"code": "k"}})
    done = engine.insert(made)
    assert done.ok and [b["author_id"] for b in done.record["books"]] == [3, 3] and done.record["card"]["author_id"] == 3
    assert rows(done.tables["books"].where("author_id = 3"), "id", "book_title") == [(4, "a"), (5, "b")]
    ann = {"id": 1, "name": "ann", "books": [{"id": 1, "title": "one", "author_id": 1}, {"id": 2, "title": "two", "author_id": 1}], "card": {"id": 1, "code": "c1", "author_id": 1}}
    edit = change(AUTHOR, ann).cast_assoc("books", {"books": {"0": {"id": "1", "title": "uno"}, "1": {"title": "new"}}}).cast_assoc("card", {"card": {"code": "c2"}})
    done = engine.update(edit)
    assert rows(done.tables["books"], "id", "book_title", "author_id") == [(1, "uno", 1), (3, "kept", 2), (4, "new", 1)]
    assert rows(done.tables["cards"], "id", "code") == [(1, "c2")]
    bad = change(AUTHOR, ann).cast_assoc("books", {"books": [{"id": 1, "title": 5}]}, with_=lambda c, p: c.cast(p, ["title"]))
    assert not bad.valid and bad.traverse_errors() == {"books": [{}, {"title": ["is invalid"]}]}
    with pytest.raises(InvalidChangesetError):
        bad.apply_action()
    assert change(AUTHOR, ann).cast_assoc("books", {"books": "x"}).errors == (("books", "is invalid"),)
    assert change(AUTHOR, {}).cast_assoc("books", {}, required=True).errors == (("books", "can't be blank"),)
    with pytest.raises(QueryError, match="preloaded"):
        change(AUTHOR, {"id": 1}).cast_assoc("books", {"books": []})
    nil = change(AUTHOR, {"id": 2, "name": "bob", "kept": [{"id": 3, "title": "kept", "author_id": 2}]}).put_assoc("kept", [])
    assert rows(engine.update(nil).tables["books"], "id", "author_id")[2] == (3, None)
    up = change(BOOK, {}, {"title": "t"}).put_assoc("author", {"name": "zed"})
    done = engine.insert(up)
    assert done.record["author_id"] == 3 and rows(done.tables["authors"], "name")[-1] == ("zed",)
    below = engine.insert(change(BOOK, {}, {"title": "t"}).put_assoc("author", change(AUTHOR, {}, {"name": "bob"}).unique_constraint("name")))
    assert not below.ok and below.change.traverse_errors() == {"author": {"name": ["has already been taken"]}}
    tags = change(AUTHOR, {"id": 1, "name": "ann", "tags": [{"id": 1, "name": "red"}]}).put_assoc("tags", [{"name": "green"}])
    done = engine.update(tags)
    assert rows(done.tables["authors_tags"], "author_id", "tag_id") == [(1, 3)] and done.tables["tags"].count() == 3
    with pytest.raises(QueryError, match="on_replace"):
        change(BOOK, {"id": 1, "author": {"id": 1, "name": "ann"}}).put_assoc("author", {"name": "other"})


def test_embeds_are_cast_and_stored(spark):
    item = Schema("Item", None, {"id": Field("integer", primary_key=True), "price": "integer"})
    order = Schema("O", "o", {"id": Field("integer", primary_key=True)}, embeds={"item": Embed(item, on_replace="update"), "items": Embed(item, many=True, on_replace="delete")})
    own = Engine(spark, {"o": spark.createDataFrame([(1, (1, 5), [(1, 7), (2, 8)])], order.spark_schema(stored=True))})
    done = own.insert(change(order, {}, {}).cast_embed("item", {"item": {"price": "3"}}).put_embed("items", [{"id": 4, "price": 4}]))
    row = done.tables["o"].where("id = 2").first()
    assert row.item.price == 3 and [x.price for x in row["items"]] == [4]
    old = {"id": 1, "item": {"id": 1, "price": 5}, "items": [{"id": 1, "price": 7}, {"id": 2, "price": 8}]}
    edit = change(order, old).cast_embed("items", {"items": [{"id": 2, "price": 9}]}).cast_embed("item", {"item": {"price": 6}})
    row = own.update(edit).tables["o"].first()
    assert (row.item.id, row.item.price) == (1, 6) and [(x.id, x.price) for x in row["items"]] == [(2, 9)]
    assert change(order, {}).cast_embed("item", {"item": {"price": "x"}}).traverse_errors() == {"item": {"price": ["is invalid"]}}


def test_deletes_cascade(engine):
    done = engine.delete(change(AUTHOR, {"id": 1, "name": "ann"}))
    assert rows(done.tables["books"], "id") == [(3,)] and done.tables["authors_tags"].count() == 0 and done.tables["authors"].count() == 1
    owner = Schema("Owner", "authors", {"id": Field("integer", primary_key=True)}, {"books": has_many(lambda: held, "author_id", "id")})
    held = Schema("Held", "books", {"id": Field("integer", primary_key=True), "author_id": "integer"}, constraints=[foreign_key("books_author_id_fkey", "author_id", lambda: owner)])
    blocked = engine.delete(change(owner, {"id": 1}).no_assoc_constraint("books"))
    assert blocked.change.errors == (("books", "are still associated with this entry"),)
    with pytest.raises(ConstraintError):
        engine.delete(change(owner, {"id": 1}))
    freed = Schema("Freed", "authors", {"id": Field("integer", primary_key=True)}, {"books": has_many(lambda: BOOK, "author_id", "id", on_delete="nilify_all")})
    assert rows(engine.delete(change(freed, {"id": 1})).tables["books"].where("author_id is null"), "id") == [(1,), (2,)]
    with pytest.raises(StaleEntryError):
        engine.delete(change(TAG, {"id": 99}))


def test_named_steps_see_earlier_ones_and_are_published_together(engine, spark, tmp_path):
    paths = {n: str(tmp_path / n) for n in ("authors", "books")}
    publish_all(spark, {p: engine.table(n) for n, p in paths.items()})
    own = Engine(spark, lambda n: spark.read.parquet(paths[n]) if n in paths else engine.table(n))
    steps = Multi().insert("author", (AUTHOR, {"name": "cy"})).insert("book", lambda done: (BOOK, {"title": "t", "author_id": done["author"]["id"]}))
    steps = steps.update("older", lambda done: change(AUTHOR, done["author"], {"age": 50})).delete("gone", change(AUTHOR, {"id": 2, "name": "bob"}))
    steps = steps.delete_all("rest", from_(BOOK).join(AUTHOR, on=lambda b, a: b.author_id == a.id).where(lambda b, a: a.name == "ann"))
    out = own.transact(steps, paths)
    assert out.ok and out.results["older"]["age"] == 50
    assert rows(spark.read.parquet(paths["authors"]), "name", "age") == [("ann", 30), ("cy", 50)]
    assert rows(spark.read.parquet(paths["books"]), "book_title", "author_id") == [("t", 3)]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["authors", "books"]
    bad = Multi().put("a", 1).insert("x", change(AUTHOR, {}, {"name": "ann"}).unique_constraint("name")).put("never", 1)
    out = own.transact(bad, paths)
    assert (out.ok, out.failed, out.value.errors) == (False, "x", (("name", "has already been taken"),)) and "never" not in out.results
    early = Multi().run("ran", lambda *_: 1 / 0).insert("x", RecordChange(AUTHOR, {}).add_error("name", "no"))
    assert own.transact(early).failed == "x"


def test_failed_renames_are_undone(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "none" / "b")
    publish(spark.range(3).toDF("id"), a)
    (tmp_path / "none").write_text("a file where a folder should be")
    with pytest.raises(Exception):
        publish_all(spark, {a: spark.range(1).toDF("id"), b: spark.range(1).toDF("id")})
    assert spark.read.parquet(a).count() == 3 and [p.name for p in tmp_path.iterdir() if p.is_dir()] == ["a"]


def test_a_rename_that_the_file_system_refuses(spark, tmp_path, monkeypatch):
    paths = [str(tmp_path / n) for n in "ab"]
    publish_all(spark, {p: spark.range(3).toDF("id") for p in paths})
    calls, rename = [], Folders.rename
    monkeypatch.setattr(Folders, "rename", lambda self, a, b: calls.append(1) or len(calls) != 4 and rename(self, a, b))
    with pytest.raises(OSError, match="can't be renamed"):
        publish_all(spark, {p: spark.range(1).toDF("id") for p in paths})
    assert [spark.read.parquet(p).count() for p in paths] == [3, 3] and sorted(p.name for p in tmp_path.iterdir()) == ["a", "b"]


def test_fragments_leave_session_views_alone(engine, spark):
    spark.range(5).createOrReplaceTempView("t")
    q = from_("t").with_cte("t", fragment("SELECT ? AS n, 'it''s t' AS s", 1.5)).select(["n", "s"])
    assert [tuple(r) for r in engine.all(q).collect()] == [(1.5, "it's t")] and dict(engine.all(q).dtypes)["n"] == "double"
    assert spark.table("t").count() == 5
    inner = from_("u").with_cte("t", from_("tags").select(["name"])).with_cte("u", fragment("SELECT t.name AS n FROM t")).select(["n"])
    assert rows(engine.all(inner), "n") == [("blue",), ("red",)] and spark.table("t").count() == 5
    odd = from_("x").with_cte("x", fragment("SELECT ? AS a, ? AS b", float("nan"), float("-inf"))).select(["a", "b"])
    got = engine.one(odd)
    assert got.a != got.a and got.b == float("-inf")


def test_preloads_from_joins(engine):
    q = from_(AUTHOR).left_join(lambda a: assoc(a, "books"), as_="b").order_by(lambda a: [("desc", a.name)]).preload(lambda a, *, b: {"books": b})
    got = engine.all(q).collect()
    assert [(r.name, [x.title for x in r.books]) for r in got] == [("bob", ["kept"]), ("ann", ["one", "two"])]
    few = engine.all(from_(AUTHOR).left_join(lambda a: assoc(a, "books"), as_="b").where(lambda a, b: b.title != "two").preload(lambda a, *, b: {"books": b}, "card")).collect()
    assert {r.name: ([x.title for x in r.books], r.card and r.card.code) for r in few} == {"ann": (["one"], "c1"), "bob": (["kept"], None)}
    deep = from_(AUTHOR).join(lambda a: assoc(a, "books"), as_="b").left_join(lambda a, b: assoc(b, "author"), as_="w").preload(lambda a, *, b, w: {"books": (b, {"author": w})})
    assert {r.name: [(x.title, x.author.name) for x in r.books] for r in engine.all(deep).collect()} == {"ann": [("one", "ann"), ("two", "ann")], "bob": [("kept", "bob")]}
    many = from_(BOOK).left_join(lambda b: assoc(b, "author"), as_="a").left_join(lambda b, a: assoc(a, "books"), as_="o").preload(lambda b, *, a, o: {"author": (a, {"books": o})})
    assert {r.title: [x.title for x in r.author.books] for r in engine.all(many).collect()} == {"one": ["one", "two"], "two": ["one", "two"], "kept": ["kept"]}
    authors = engine.all(AUTHOR)
    loaded = engine.preload(authors, AUTHOR, "books")
    again = engine.preload(loaded, AUTHOR, "books")
    assert again.columns == loaded.columns and assoc_loaded(loaded.first(), "books") and not assoc_loaded(authors.first(), "books")
    forced = engine.preload(loaded, AUTHOR, ("books", from_(BOOK).where(title="one")), force=True)
    assert sorted(len(r.books) for r in forced.collect()) == [0, 1]
    assert build_assoc(AUTHOR, {"id": 4}, "kept") == {"id": None, "title": "kept", "author_id": 4}
    falling = Schema("A2", "authors", {"id": Field("integer", primary_key=True)}, {"books": has_many(lambda: BOOK, "author_id", "id", preload_order=(("desc", "title"),))})
    assert [[x.title for x in r.books] for r in engine.all(from_(falling).order_by("id").preload("books")).collect()] == [["two", "one"], ["kept"]]


def test_hooks(spark, engine):
    seen = []
    own = Engine(spark, engine.table, default_options=lambda op: seen.append(op) or ({"on_conflict": "nothing"} if op == "insert_all" else {}),
        prepare_transaction=lambda multi, options: (multi.put("hook", 1), options))
    assert own.insert_all(AUTHOR, [{"id": 1, "name": "zz"}]).count == 0 and seen == ["insert_all"]
    assert own.transact(Multi().put("a", 2)).results == {"a": 2, "hook": 1}


def test_custom_types_are_compared_and_stored(spark):
    from tessera.functions import types

    level = types.Enum(low=1, high=2)
    schema = Schema("L", "levels", {"id": Field("integer", primary_key=True), "level": Field(level, source="lv")})
    own = Engine(spark, {"levels": spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id long, lv long")})
    assert rows(own.all(from_(schema).where(level="high")), "id", "level") == [(2, "high")]
    assert rows(own.all(from_(schema).where(lambda x: x.level.in_(["low", 2]))), "id") == [(1,), (2,)]
    done = own.update_all(from_(schema).where(id=1).update(set={"level": "high"}))
    assert rows(done.affected, "level") == [("high",)] and rows(done.stored(), "id", "lv")[:2] == [(1, 2), (2, 2)]
    done = own.insert_all(schema, [{"id": 4, "level": "low"}])
    assert rows(done.affected, "id", "level") == [(4, "low")] and rows(done.stored().where("id = 4"), "lv") == [(1,)]
    assert own.insert(change(schema, {}, {"level": "low"})).tables["levels"].where("id = 4").first().lv == 1


def test_conflict_targets_by_constraint_and_joined_queries(engine):
    new = [{"id": 50, "name": "ann", "age": 77}]
    done = engine.insert_all(AUTHOR, new, on_conflict=("replace", ["age"]), conflict_target=("constraint", "authors_name_index"))
    assert rows(done.table, "id", "name", "age") == [(1, "ann", 77), (2, "bob", 40)]
    with pytest.raises(QueryError, match="no unique constraint"):
        engine.insert_all(AUTHOR, new, on_conflict="nothing", conflict_target=("constraint", "nope"))
    late = from_(BOOK).where(lambda b: b.title != "one")
    q = from_(AUTHOR).join(late, on=lambda a, b: b.author_id == a.id).select(lambda a, b: {"t": b.title})
    assert rows(engine.all(q), "t") == [("kept",), ("two",)]
    with pytest.raises(QueryError, match="filters only"):
        engine.all(from_(AUTHOR).join(late.limit(1), on=lambda a, b: b.author_id == a.id).select(lambda a, b: {"t": b.title}))
