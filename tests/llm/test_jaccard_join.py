"""The n-gram Jaccard join against brute force."""

import os
import random
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import common, jaccard_join
from tessera.llm.connected import components
from tessera.llm.jaccard_join import JaccardJoin, jaccard_components


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}


def roots_of(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    where = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            where[x].add(i)
    pairs = {(a, b) for own in where.values() for a in own for b in own if a < b}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    roots = roots_of(sets, links)
    return {i: (len(sets[i]), roots[i]) for i in sets}


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    shared = [r.choice(words) for _ in range(30)]
    for _ in range(60):
        base = [r.choice(words) for _ in range(r.randint(1, 120))]
        if r.random() < 0.3:
            base[len(base) // 2 :] = shared
        for _ in range(r.choice([1, 1, 2, 5])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((n, r.choice([" ", "\n", " \t "]).join(copy)))
            n += 1
    hot = [r.choice(words) for _ in range(100)]
    for _ in range(80):
        copy = list(hot)
        for _ in range(r.randint(0, 4)):
            copy[r.randrange(100)] = f"x{r.randrange(10**6)}"
        rows.append((n, " ".join(copy)))
        n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "One two"), (n + 4, "one TWO"), (n + 5, "one two three é"), (n + 6, "É x")]
    long = [r.choice(words) for _ in range(9000)]
    rows += [(n + 20, " ".join(long)), (n + 21, " ".join(long[:8900])), (n + 22, " ".join(long[:5000]))]
    rows += [(n + 7, "w1 " * 20_000), (n + 8, "w1 " * 30_000)]
    return rows


def test_components_equal_brute_force(spark):
    for seed, k, percent in ((1, 4, 85), (2, 5, 80)):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).repartition(3)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, k, percent).collect()}
        assert got == brute(rows, k, percent)


def test_repeated_rows_and_empty_tables(spark):
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (9, "a b c d e f"), (1, "other words in this one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df, 4, 85).collect())
    assert got == [(1, 2, 1), (3, 3, 3), (3, 3, 3), (9, 3, 3)]
    assert jaccard_components(df.limit(0), 4, 85).count() == 0


def test_components_of_paths_and_stars(spark):
    r = random.Random(5)
    ids = r.sample(range(10**9), 200)
    links = [(ids[i], ids[i + 1]) for i in range(99)] + [(ids[100], x) for x in ids[101:150]] + [(ids[160], ids[161])]
    df = spark.createDataFrame(links, "a long, b long")
    got = defaultdict(set)
    for x in components(df).collect():
        got[x.root].add(x.node)
    want = defaultdict(set)
    for node, root in roots_of({x for p in links for x in p}, links).items():
        want[root].add(node)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert components(df.limit(0)).count() == 0


def test_texts_without_an_id_link_others(spark):
    words = [f"w{i}" for i in range(40)]
    one, two = " ".join(["x", "y", "z", *words[3:]]), " ".join([*words[:37], "p", "q", "r"])
    rows = [(1, one), (2, two)] + [(None, " ".join(words))] * 3 + [(None, " ".join(reversed(words))), (None, "nothing near this"), (None, None), (7, "far from it")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df, 1, 85).collect()), key=str)
    want = [(1, 40, 1), (2, 40, 1)] + [(None, 40, 1)] * 4 + [(None, 3, None), (None, 0, None), (7, 3, 7)]
    assert got == sorted(want, key=str)
    apart = jaccard_components(df.where("doc_id is not null"), 1, 85).collect()
    assert all(r.component_id == r.doc_id for r in apart)


def test_large_groups_are_settled_by_leaders_and_differences(spark, monkeypatch):
    """Near copies of one text that mostly don't link with each other, with small groups and hot shingles made rare."""
    monkeypatch.setattr(jaccard_join, "SMALL", 2)
    monkeypatch.setattr(jaccard_join, "HOT", 3)
    for seed in (1, 2, 3):
        r = random.Random(seed)
        base = [f"b{i}" for i in range(60)]
        rows = []
        for n in range(90):
            copy = list(base[: r.choice([45, 60, 60, 60])])
            for _ in range(r.choice([0, 1, 2, 3, 4])):
                at = r.randrange(len(copy))
                copy[at : at + r.choice([0, 1, 1, 2])] = [f"e{r.randrange(4)}"] if r.random() < 0.5 else [f"u{n}"]
            rows.append((n, " ".join(copy)))
        rows += [(100 + n, " ".join([*base[:20], *(f"v{r.randrange(6)}" for _ in range(20))])) for n in range(30)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_components(df, 3, 85).collect()}
        assert got == brute(rows, 3, 85)
        assert len(set(got.values())) > 20


def test_suffix_bound_never_exceeds_the_difference():
    r = np.random.default_rng(4)
    for _ in range(300):
        x, y = (np.unique(r.integers(0, 80, r.integers(1, 60)).astype(np.uint64)) for _ in range(2))
        assert jaccard_join.suffix_bound(x, y) <= len(np.setxor1d(x, y))
    assert jaccard_join.suffix_bound(np.arange(10), np.arange(100, 110)) == 18


class Noted(JaccardJoin):
    """Shingles in the order of their hashes, as where counters tell nothing; the pairs that are verified are noted."""

    def measure(self):
        super().measure()
        self.counters = self.spark.sparkContext.broadcast(np.zeros(jaccard_join.COUNTERS, np.uint32))
        self.pairs = 0

    def _compared(self, pairs):
        self.pairs += pairs.count()
        return super()._compared(pairs)


def test_long_texts_that_share_a_few_shingles_are_not_verified(spark):
    r = random.Random(7)
    new = lambda n: [f"q{r.randrange(10**9)}" for _ in range(n)]
    passage, rows = new(60), []
    for n in range(12):
        rows.append((n, " ".join([*new(r.randrange(900, 1000)), *passage, *new(1000)])))
    near = [new(size) for size in (930, 1400, 3000, 5000)]
    for n, base in enumerate(near):
        for i, share in enumerate((0.0, 0.05, 0.095, 0.105, 0.12)):
            cut = int(share * len(base))
            rows.append((100 + 10 * n + i, " ".join([*base[: 300 + n], *new(cut), *base[300 + n + cut :]])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    join = Noted(df, 5, 80)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in join.link().collect()}
    assert got == brute(rows, 5, 80)
    # ten pairs of each four texts and copies at most; the twelve texts that share a passage would make 66 more
    assert join.pairs <= 40


def test_linked_sets_share_as_many_shingles_of_their_prefixes_as_needed():
    r = np.random.default_rng(2)
    for _ in range(200):
        percent = int(r.choice([80, 85]))
        n, m = int(r.integers(600, 4000)), int(r.integers(0, 900))
        items = r.permutation(6000)
        x, y = np.sort(items[:n]), np.sort(items[m // 4 : m // 4 + n - m % 50])
        if 100 * len(np.intersect1d(x, y)) < percent * len(np.union1d(x, y)):
            continue
        needs = [jaccard_join.needed(len(s), percent) for s in (x, y)]
        heads = [s[: len(s) - (percent * len(s) + 99) // 100 + need] for s, need in zip((x, y), needs)]
        assert len(np.intersect1d(*heads)) >= min(needs)


def test_copies_in_several_tasks_make_no_groups(spark):
    text = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(n, text) for n in range(30)], "doc_id long, text string").repartition(3)
    join = JaccardJoin(df, 4, 85)
    join.measure()
    assert [x.count() for x in join._grouped(join.first_rows())] == [0, 0]


def test_fine_parities_never_exceed_the_difference():
    r = np.random.default_rng(6)
    for _ in range(100):
        pool = r.integers(0, 1 << 63, 6000).astype(np.uint64) * np.uint64(2)
        n, m = (int(r.integers(512, 3000)) for _ in range(2))
        x, y = np.unique(pool[:n]), np.unique(pool[n // 3 : n // 3 + m])
        own = [jaccard_join.parities(s, 1 << (len(s) - 1).bit_length()).tobytes() for s in (x, y)]
        assert jaccard_join.fine_bound(*own) == jaccard_join.fine_bound(*own[::-1]) <= len(np.setxor1d(x, y))


def test_long_texts_that_share_a_third_are_not_verified_and_steps_leave_no_tables(spark):
    r = random.Random(8)
    new = lambda n: [f"q{r.randrange(10**9)}" for _ in range(n)]
    passage = new(700)
    rows = [(n, " ".join([*new(600 + 40 * n), *passage, *new(700)])) for n in range(12)]
    df = spark.createDataFrame(rows + [(50, rows[3][1] + " and more")], "doc_id long, text string").repartition(3)
    join, before = Noted(df, 5, 80), set(common._STAGED)
    got = {x.doc_id: x.component_id for x in join.link().collect()}
    assert got == {n: n for n in range(12)} | {50: 3}
    assert join.pairs <= 5 and not join.passing
    left = set(os.listdir(f"{common.shared_dir(spark)}/staged".removeprefix("file://"))) - {os.path.basename(p) for p in before}
    assert left and not [p for p in left if re.match("jaccard-(groups|pairs|items|wanted|leaders)-", p)]
