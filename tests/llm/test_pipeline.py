"""The pipeline's stages against brute force."""

import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipe
from tessera.llm import decontamination
from tests.llm.test_jaccard_join import brute
from tests.llm.test_native import brute_base

SF = "/root/testdata/sf0.001"
need = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@need
def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    bench = [(r.item_id, decontamination.normalise(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert [n for n, _ in pipe.STAGES] == ["toxicity", "jaccard_join", "decontamination", "secret_scans", "mixing"]

    out = {r.doc_id for r in pipe.drop_toxic(spark, docs, SF).collect()}
    clean = {i for i, t in labels.items() if t == 0}
    assert len(clean - out) <= 0.1 * len(clean) and out <= rows.keys()
    toxic = {i for i, t in labels.items() if t == 1}
    assert len(toxic - out) >= 0.7 * len(toxic) > 0

    kept = pipe.keep_one_of_each_group(spark, docs, SF)
    want = {i for i, (_, root) in brute([(i, r.text) for i, r in rows.items()], 5, 80).items() if i == root}
    assert kept.columns == columns and sorted(r.doc_id for r in kept.collect()) == sorted(want)

    items = [(decontamination.masks(b), len(b), int(len(b) * decontamination.RATE)) for _, b in bench]

    def leaks(text):
        text = decontamination.normalise(text)
        return any(decontamination.myers(peq, n, text)[0] <= errors for peq, n, errors in items)

    held = {r.doc_id for r in pipe.drop_benchmark_copies(spark, docs, SF).collect()}
    assert held == {i for i, r in rows.items() if not leaks(r.text)} and 0 < len(held) < len(rows)

    redacted = pipe.redact_secrets(spark, docs, SF)
    assert redacted.columns == columns
    for r in redacted.collect():
        assert not brute_base(r.text) and r.n_chars == len(r.text)
        if not brute_base(rows[r.doc_id].text) and "<SECRET>" not in r.text:
            assert r.text == rows[r.doc_id].text

    mixed = pipe.mix_sources(spark, docs, SF).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    assert all(r.taken == r.copies * words(rows[r.doc_id].text) and r.text == rows[r.doc_id].text and 1 <= r.copies <= 3 for r in mixed)
    assert sum(r.taken for r in mixed) <= sum(words(r.text) for r in rows.values())


@need
def test_run_applies_all_stages(spark):
    out = pipe.run(spark, SF)
    rows = out.collect()
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copies", "taken"] and rows
    assert max(Counter(r.doc_id for r in rows).values()) == 1
    assert not any(brute_base(r.text) for r in rows)


@need
def test_stages_on_odd_rows(spark):
    line = "one two three four five six seven eight nine ten"
    odd = [(None, line, "en", "s", 4), (1, None, None, None, None), (2, "", "en", "s", 0), (3, line, "en", "s", 48), (3, line, "en", "s", 48)]
    long = " ".join(f"word{i % 5003}x{i}" for i in range(60_000))
    odd += [(4, long, "en", "t", len(long))]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long").withColumn("size", F.lit("x"))
    for name, stage in pipe.STAGES:
        got = stage(spark, docs, SF)
        empty = stage(spark, docs.limit(0), SF)
        assert empty.count() == 0, name
        if name == "jaccard_join":
            assert sorted((r.doc_id or 0) for r in got.collect()) == [0, 1, 2, 3, 4]
        elif name != "mixing":
            assert got.count() == 6 and got.columns == docs.columns
        else:
            assert sum(r.taken for r in got.collect()) <= 60_030 and got.columns == [*docs.columns, "copies", "taken"]
            clash = stage(spark, docs.withColumn("copies", F.lit("own")), SF)
            assert clash.columns[-3:] == ["copies", "mix_copies", "taken"] and {r.copies for r in clash.collect()} == {"own"}


def test_texts_that_share_an_id_are_kept_apart(spark):
    text = lambda w, n=40: " ".join(f"{w}{i}" for i in range(n))
    near = text("a") + " more"
    rows = [(1, text("a")), (1, text("b")), (1, near), (3, near), (2, text("c")), (2, text("c") + " end"), (5, ""), (5, text("d")), (5, text("d")), (4, text("b")), (None, text("b"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("x")).repartition(3)
    got = [(r.doc_id, r.text) for r in pipe.keep_one_of_each_group(spark, docs, SF).collect()]
    a = [r for r in got if r[1] and r[1].startswith("a0 ")]
    c = [r for r in got if r[1] and r[1].startswith("c0 ")]
    assert len(a) == 1 and a[0][0] == 1 and len(c) == 1 and c[0][0] == 2
    assert sorted((r for r in got if r not in a + c), key=str) == sorted([(1, text("b")), (5, ""), (5, text("d")), (None, text("b"))], key=str)


@need
def test_texts_are_shuffled_once_to_keep_one_of_each_group(spark):
    kept = pipe.keep_one_of_each_group(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    plan = kept._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert sum("row_key" in d for d in dealt) <= 2 and not any(d.startswith("row#") for d in dealt), dealt
