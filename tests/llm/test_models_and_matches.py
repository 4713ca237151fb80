"""op5 and op6 by held-out accuracy, op10 against brute force, and their special cases."""

import os
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontamination as decon
from tessera.llm import hashing, language_id, queries, toxicity

SF, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def distance(pattern, text):
    """Least edit distance of pattern to a substring of text, row by row."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(r, text, n):
    out = list(text)
    for _ in range(n):
        i = r.randrange(len(out))
        kind = r.randrange(3)
        out[i : i + (kind != 0)] = [] if kind == 1 else [r.choice("abcxyz")]
    return "".join(out)


def test_myers_equals_dynamic_programming():
    r = random.Random(3)
    for _ in range(200):
        p = "".join(r.choice("abc ") for _ in range(r.randint(1, 80)))
        t = "".join(r.choice("abc ") for _ in range(r.randint(0, 120)))
        best, end = decon.myers(decon.masks(p), len(p), t)
        assert best == distance(p, t)
        assert best == min(distance(p, t[max(0, end - 2 * len(p)) : end]), len(p))


def test_matches_equal_brute_force(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(r.randint(8, 30)))) for i in range(12)]
    items += [(50, None), (51, ""), (52, "too short"), (53, items[0][1]), (54, "one of seven words is here quoted"), (55, "é")]
    docs = [(0, None), (1, ""), (2, "Too  SHORT!"), (3, "this is too short a text"), (4, "..."), (5, "not too shorter"), (6, "caf é, café")]
    docs += [(7, "it says: One of seven words is here quoted. So"), (8, "one of seven words is here quotes"), (9, "x " * 60_000 + items[3][1] + " y" * 60_000)]
    for i in range(10, 60):
        body = " ".join(word() for _ in range(r.randint(0, 60)))
        if i % 2:
            _, t = items[r.randrange(12)]
            body = body + "! " + edited(r, t.upper() if i % 3 else t, r.randint(0, len(t) // 12)) + "; " + body
        docs.append((i, body))
    docs.append((10, docs[10][1]))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("m", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((x.doc_id, x.item_id, x.distance) for x in decon.decontaminate(df, bench).collect())
    want = []
    for i, t in docs:
        t = decon.normalise(t)
        for k, item in items:
            item = decon.normalise(item)
            errors = int(len(item) * decon.RATE)
            if i == 9:
                want += [(i, k, 0)] if item and f" {item} " in f" {t} " else []
            elif not errors:
                want += [(i, k, 0)] if item and f" {item} " in f" {t} " else []
            elif (d := distance(item, t)) <= errors:
                want.append((i, k, d))
    assert got == sorted(want) and len(got) > 15
    assert {(i, k) for i, k, _ in got} >= {(2, 52), (3, 52), (6, 55), (7, 54), (8, 54), (9, 3)} and (5, 52, 0) not in got


def test_decontamination_of_empty_tables_and_in_blocks(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine")], "doc_id long, text string")
    bench = spark.createDataFrame([(i, "one two three four five six seven eight" + " x" * i) for i in range(3)], "item_id long, text string")
    assert decon.decontaminate(docs.limit(0), bench).count() == 0
    assert decon.decontaminate(docs, bench.limit(0)).count() == 0
    assert len(list(decon.blocks(bench, limit=50))) == 3
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    whole = rows(decon.decontaminate(docs, bench))
    assert whole and rows(decon.decontaminate(docs, bench, limit=50)) == whole
    both = docs.union(spark.createDataFrame([(2, "nothing of it"), (None, None)], docs.schema))
    for limit in (50, 10_000):
        assert [r.doc_id for r in decon.clean_documents(both, bench, limit=limit).orderBy("doc_id").collect()] == [None, 2]
    assert decon.clean_documents(both, bench.limit(0)).count() == 3


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_language_id_on_held_out_rows(spark):
    out = queries.QUERIES["op5_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").collect()
    assert len(out) == 1000
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97


def test_language_id_special_cases(spark):
    rows = [(i, t, g) for i in range(40) for t, g in (("the cat and the dog are in the house " * 4, "en"), ("der hund und die katze ist nicht im haus " * 4, "de"))]
    rows = [(2 * i + j, t, g) for i, (_, t, g) in enumerate(rows) for j in (0,)]
    rows += [(900, None, "en"), (901, "", "de"), (902, "123 !!", "en"), (903, "the cat and the dog", None), (904, "der hund und die katze ist nicht im haus " * 5_000, "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("found", F.lit(1))
    net = language_id.train(df)
    out = {r.doc_id: r.x for r in df.select("doc_id", language_id.language(F.col("text"), net).alias("x")).collect()}
    assert [out[i].lang for i in (900, 901, 902)] == ["und"] * 3 and out[903].lang == "en" and out[904].lang == "de"
    none = language_id.train(df.withColumn("lang", F.lit(None).cast("string")))
    assert none is None
    assert {r.x.lang for r in df.select(language_id.language(F.col("text"), none).alias("x")).collect()} == {"und"}
    assert df.limit(0).select(language_id.language(F.col("text"), net)).count() == 0


def test_network_gradients_are_right():
    net = language_id.Network(["a", "b", "c"])
    import numpy as np

    for name in ("embedding", "filters", "bias", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    rng = np.random.default_rng(1)
    batch, truth = rng.integers(97, 103, (6, language_id.WINDOW)).astype(np.uint8), rng.integers(0, 3, 6)
    loss = lambda: -net.log_probabilities(batch)[np.arange(6), truth].mean()
    for p, g in zip(net.parameters(), net.gradients(batch, truth)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, e = p[at], 1e-5
        p[at] = old + e
        up = loss()
        p[at] = old - e
        down = loss()
        p[at] = old
        assert (up - down) / (2 * e) == pytest.approx(g[at], rel=1e-2, abs=1e-5)


def test_toxicity_learns_words_and_their_misspellings():
    r = random.Random(9)
    word = lambda: "".join(r.choice(["an", "the", "er", "on", "re", "ti"]) for _ in range(r.randint(1, 4)))
    bad = ["worthless", "disgusting", "pathetic"]

    def text(toxic, words):
        out = [word() for _ in range(r.randint(5, 150))]
        if toxic:
            for _ in range(r.randint(1, 6)):
                out.insert(r.randrange(len(out) + 1), r.choice(words))
        return " ".join(out)

    labels = [i % 4 == 0 for i in range(800)]
    model = toxicity.fit([text(y, bad) for y in labels], [int(y) for y in labels])
    score = lambda words, y: model.score(pa.array([text(y, words) for _ in range(200)]))
    assert (score(bad, True) >= 0.5).mean() > 0.95
    assert (score(bad, False) >= 0.5).mean() < 0.05
    assert (score(["worthlesss", "disgustting", "pathetik"], True) >= 0.5).mean() > 0.8
    assert list(model.score(pa.array([None, "", "!!"], pa.string()))) == [0, 0, 0]


def test_toxicity_fit_works_in_parts(monkeypatch):
    """What the fit holds at once is a small multiple of its texts, and the parts that it works in change no score."""
    r = np.random.default_rng(4)
    letters = r.choice([*b"abcdefghijklmnopqrst"], (50_000, 7)).astype(np.uint8)
    letters[:, 6] = 32
    letters = letters[r.integers(0, len(letters), 1_000_000)]
    texts = [letters[a : a + 500].tobytes().decode() + "worthless pathetic" * (a % 1000 > 0) for a in range(0, len(letters), 500)]
    labels = [int("worthless" in t) for t in texts]
    some = pa.array(["", *texts[:60], "worthless", None], pa.large_string())
    tracemalloc.start()
    toxicity.fit(texts, labels, rounds=2, steps_each=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * letters.nbytes
    one = toxicity.fit(texts[:100], labels[:100]).score(some)
    monkeypatch.setattr(toxicity, "steps", lambda offsets: hashing.steps(offsets, 9000))
    parts = toxicity.fit(texts[:100], labels[:100]).score(some)
    assert np.allclose(one, parts, atol=1e-3) and set(parts[1:61] >= 0.5) == {False, True}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_toxicity_query(spark):
    out = queries.QUERIES["op6_toxicity"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = out.join(labels, "doc_id", "left").collect()
    assert len(rows) == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5)
    clean = [r for r in rows if r.toxic == 0 and r.held_out]
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="needs the driver's tables")
def test_toxicity_recall_on_held_out_labels(spark):
    """Some texts are labelled toxic without a word that tells so; of those with one, nearly all must be found."""
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    rows = queries.QUERIES["op6_toxicity"](spark, LARGER).join(labels, "doc_id").where("toxic is not null").collect()
    texts = {r.doc_id: set(re.findall(r"\w+", (r.text or "").lower())) for r in spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text").collect()}
    fitted = [r for r in rows if not r.held_out]
    harmless = set().union(*(texts[r.doc_id] for r in fitted if r.toxic == 0))
    seen = Counter(w for r in fitted if r.toxic == 1 for w in texts[r.doc_id] - harmless)
    telling = {w for w, n in seen.items() if n >= 20}
    toxic = [r for r in rows if r.held_out and r.toxic == 1 and texts[r.doc_id] & telling]
    clean = [r for r in rows if r.held_out and r.toxic == 0]
    assert len(toxic) >= 50 and sum(r.predicted for r in toxic) >= 0.9 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)


def test_models_on_long_repeated_and_clashing_rows(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice(["an", "the", "er", "on", "re", "ti"]) for _ in range(r.randint(1, 4)))
    rows = [(i, " ".join([*(word() for _ in range(20)), *(["worthless", "pathetic"] if i % 2 else [])]), i % 2) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").withColumn("toxic", F.lit("clash")).withColumn("score", F.lit("clash"))
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int").withColumn("text", F.lit("clash")))
    long = " ".join(word() for _ in range(200_000))
    odd = spark.createDataFrame([(1, long), (2, long + " worthless pathetic"), (3, rows[1][1]), (3, rows[1][1]), (4, None)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = [(x.doc_id, x.s) for x in odd.select("doc_id", toxicity.toxicity(F.col("text"), model).alias("s")).collect()]
    assert got[0][1] < 0.5 <= got[1][1] and got[2] == got[3] and got[4][1] == 0
    assert odd.limit(0).select(toxicity.toxicity(F.col("text"), model)).count() == 0
    langs = spark.createDataFrame([(i, "the house and the garden " * 3 if i % 2 else "das haus und der garten " * 3, "en" if i % 2 else "de") for i in range(200)], "doc_id long, text string, lang string")
    net = language_id.train(langs.union(langs))
    odd = spark.createDataFrame([(1, "the garden and the house " * 40_000), (2, "der garten"), (2, "der garten")], "doc_id long, text string").withColumn("lang", F.lit("xx"))
    got = [tuple(x.x) for x in odd.select(language_id.language(F.col("text"), net).alias("x")).collect()]
    assert [g for g, _ in got] == ["en", "de", "de"] and got[1] == got[2]


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert [r[0] for r in docs.select(toxicity.toxicity(F.col("text"), model)).collect()] == [0.0, 0.0]
    one = toxicity.train(docs, spark.createDataFrame([(1, 1), (2, 1), (1, None)], "doc_id long, toxic int"))
    assert [r[0] for r in docs.select(toxicity.toxicity(F.col("text"), one)).collect()] == [1.0, 0.0]
