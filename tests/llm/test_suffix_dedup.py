"""Suffix arrays against sorting, and the suffix-array dedup against brute force."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import suffix_array as sa
from tessera.llm.suffix_dedup import suffix_dedup


def test_suffix_arrays_equal_sorting():
    r = random.Random(1)
    for _ in range(150):
        k = r.choice([1, 2, 3, 26])
        t = [r.randint(1, k) for _ in range(r.randint(0, 300))]
        if r.random() < 0.5:
            t = t + t[: len(t) // 2] + t
        t = np.array([*t, 0])
        got = sa.suffix_array(t)
        raw = bytes(t.astype(np.uint8))
        want = sorted(range(len(raw)), key=lambda i: raw[i:])
        assert list(got) == want
        plcp = sa.permuted_lcp(t.astype(np.uint8), got, np.array([0]), 4096)
        for a, b in zip(want[:-1], want[1:]):
            n = 0
            while raw[a + n : a + n + 1] == raw[b + n : b + n + 1] != b"":
                n += 1
            assert plcp[b] == n


def test_large_alphabets_are_sorted():
    r = np.random.default_rng(2)
    half = r.integers(1, 5000, 9000)
    t = np.concatenate([half, half[:4000], half, [0]])
    got = sa.suffix_array(t)
    rank = np.empty(len(t), int)
    rank[got] = np.arange(len(t))
    assert sorted(got) == list(range(len(t)))
    for a, b in zip(got[:-1], got[1:]):
        assert t[a] < t[b] or (t[a] == t[b] and rank[a + 1] < rank[b + 1])


def brute(rows, size):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda x: (x[0] is not None, x[0])):
        data = (text or "").encode()
        mark = bytearray(len(data))
        for p in range(len(data) - size + 1):
            w = data[p : p + size]
            if w in seen:
                mark[p : p + size] = b"\1" * size
            seen.add(w)
        kept = bytes(b for b, m in zip(data, mark) if not m)
        spans = sum(m and not mark[p - 1] if p else m for p, m in enumerate(mark))
        out[i] = (len(data), sum(mark), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["an", "the", "é", "on", "re", "ti", "ß"]) for _ in range(r.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(r.randint(15, 60)) for _ in range(6)]
    rows = []
    for i in range(120):
        t = text(r.randint(0, 120))
        for _ in range(r.randint(0, 2)):
            at = r.randint(0, len(t))
            p = r.choice(passages)
            t = t[:at] + p[r.randint(0, 9) : len(p) - r.randint(0, 9)] + t[at:]
        rows.append((i, t))
        if r.random() < 0.2:
            rows.append((1000 + i, t))
        if r.random() < 0.1:
            rows.append((2000 + i, t[3:] + "x" + t[50:]))
    rows += [(5000, None), (5001, ""), (5002, "a" * 99), (5003, "a" * 100), (5004, "a" * 3000), (5005, "ab" * 900 + "a" * 700)]
    rows += [(5006, "x" + "abc" * 40 + "y" + "abc" * 50), (5007, text(30) * 3), (-5, passages[0]), (5008, "é" * 400)]
    return rows


def test_removed_bytes_equal_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash")).repartition(5)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(df).collect()}
        want = brute(rows, 100)
        assert {k: v for k, v in got.items() if v != want[k]} == {} and got.keys() == want.keys()


def test_strings_of_names_are_sorted_by_recursion(monkeypatch):
    """Induced sorting recurses on names whatever their number is; both ways to walk the buckets agree."""
    r = np.random.default_rng(3)
    depths, plain = [], sa.suffix_array
    monkeypatch.setattr(sa, "suffix_array", lambda t, sigma=None: depths.append(sigma) or plain(t, sigma))
    half = r.integers(97, 123, 30_000)
    t = np.concatenate([half, half[:20_000], half, [0]])
    got = sa.suffix_array(t)
    assert len(depths) >= 2 and max(d or 0 for d in depths) > 2048
    monkeypatch.setattr(sa, "LARGE_BUCKET", 0)
    assert list(sa.suffix_array(t)) == list(got)
    raw = bytes(t.astype(np.uint8))
    for a, b in zip(got[:-1][::50], got[1:][::50]):
        assert raw[a:] < raw[b:]


def test_small_shards_many_names_and_hot_names(spark):
    rows = corpus(3)
    phrase = "a phrase that very many texts have in common "
    rows += [(6000 + i, f"{'abcdefghij'[i % 10] * 60} {phrase}{'klmnopqrst'[i // 10] * 60}{i}") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 100)
    for options in ({"shard_bytes": 2000, "bloom_names": 50}, {"shard_segments": 3}, {"bloom_names": 0, "shard_segments": 2}):
        out = suffix_dedup(df, **options)
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()} == want


def test_repeated_rows_and_empty_tables(spark):
    t = "word one two three four five six seven eight nine ten " * 2
    df = spark.createDataFrame([(1, t), (1, t), (2, t), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in suffix_dedup(df).collect())
    alone = brute([(1, t)], 100)[1][1]
    assert got == [(0, 0), (1, alone), (1, alone), (2, len(t))]
    assert suffix_dedup(df.limit(0)).count() == 0
