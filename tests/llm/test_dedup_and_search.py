"""op1 and op9 against brute force, and their special cases."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from tessera.llm.substring_dedup import MIN_UNIT, MIN_WORDS, substring_dedup
from tessera.llm.topk_search import Cells, MTree, top_k


def normalise(line):
    return re.sub(r"[ \t\r]+", " ", line).strip(" ").translate({i: i + 32 for i in range(65, 91)})


def brute_lines(rows, min_words=MIN_WORDS):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        gone, at = set(), 0
        lines = (text or "").split("\n")
        for k, line in enumerate(lines):
            end = at + len(line) + (k + 1 < len(lines))
            clean = normalise(line)
            if len(clean) >= MIN_UNIT:
                if ("line", clean) in seen:
                    gone |= set(range(at, end))
                seen.add(("line", clean))
            start = 0
            for m in [*re.finditer(r"[.!?][ \t\r]+", line), None]:
                stop = m.end() if m else len(line)
                clean = normalise(line[start:stop])
                if len(clean) >= MIN_UNIT:
                    if ("sentence", clean) in seen:
                        gone |= set(range(at + start, at + stop))
                    seen.add(("sentence", clean))
                start = stop
            at = end
        starts = sorted(p for p in gone if p - 1 not in gone)
        runs = [(a, next(p for p in range(a, len(text) + 1) if p not in gone)) for a in starts]
        for a, b in runs:
            if len(re.findall(r"[^\x20\x09-\x0D]+", text[a:b])) < min_words:
                gone -= set(range(a, b))
        runs = sum(p - 1 not in gone for p in gone)
        out.append((i, None if text is None else "".join(c for p, c in enumerate(text) if p not in gone), runs))
    return sorted(out, key=str)


def test_lines_equal_brute_force(spark):
    r = random.Random(7)
    pool = [" ".join(r.choice(["Alpha", "bêta", "gamma", "DELTA"]) for _ in range(r.randint(1, 9))) for _ in range(60)]
    rows = []
    for i in range(150):
        lines = [r.choice(pool) if r.random() < 0.4 else f"own line {i} {k} with more words" for k in range(r.randint(1, 12))]
        rows.append((i, r.choice(["\n", "\n\n", " \t\n"]).join(x.upper() if r.random() < 0.1 else x for x in lines)))
    passage = "One sentence of the passage that has many words in it. Another one of its sentences is here! A third, the last of all of them?"
    for i in range(200, 240):
        cut = r.randint(0, 20)
        rows.append((i, f"own words {i} and {i * 7} more. {passage[cut:]} and the end {i}.\nshort. {passage}"))
    rows += [(500, None), (501, ""), (502, "\n\n\n"), (503, "a line that says one thing\n" * 3000), (None, pool[0] + " and some more words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash")).repartition(4)
    for least in (0, 9):
        got = substring_dedup(df, min_words=least).collect()
        assert sorted(((x.doc_id, x.text, x.n_removed) for x in got), key=str) == brute_lines(rows, least)
    got = substring_dedup(df).collect()
    assert sorted(((x.doc_id, x.text, x.n_removed) for x in got), key=str) == brute_lines(rows)
    texts = dict(rows)
    for x in got:
        if x.text is not None:
            cut, at = [], 0
            for s in x.spans:
                cut.append(texts[x.doc_id][at : s.start])
                at = s.end
            assert "".join(cut) + texts[x.doc_id][at:] == x.text
            assert sum(s.end - s.start for s in x.spans) == x.n_removed_chars


def test_repeated_rows_and_empty_tables(spark):
    line = "a line that is long enough to count"
    df = spark.createDataFrame([(1, line), (1, line), (2, line)], "doc_id long, text string")
    assert sorted((x.doc_id, x.n_removed) for x in substring_dedup(df, min_words=8).collect()) == [(1, 0), (1, 0), (2, 1)]
    assert sorted((x.doc_id, x.n_removed) for x in substring_dedup(df).collect()) == [(1, 0), (1, 0), (2, 0)]
    assert substring_dedup(df.limit(0)).count() == 0


def brute_top(vectors, k):
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in good:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_search_equals_brute_force(spark):
    r = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in r.normal(0, 0.3, 8)]) for i in range(700)]
    vectors += [(1000 + i, vectors[50][1]) for i in range(60)]  # ties
    vectors += [(2000, None), (2050, [0.1] * 7 + [None]), (2100, [float("nan")] * 8), (2150, [float("inf")] * 8), (2200, [0.0] * 8)]
    vectors += [(2250, [1.0, 2.0]), (2251, [0.5, 0.5]), (2300, [])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    f32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in vectors]
    for shard_rows in (16_384, 100):
        got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in top_k(df, F.col("vec_id") % 50 == 0, shard_rows=shard_rows).collect())
        assert got == brute_top(f32, 5)


def test_search_of_empty_and_small_tables(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [0.5])], "vec_id long, embedding array<float>")
    got = [(x.query_id, x["rank"], x.vec_id, x.score) for x in top_k(df, F.col("vec_id") % 50 == 0).collect()]
    assert got == [(0, 1, 1, 256 * 128)]
    assert top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_tree_prunes_by_bounds():
    r = np.random.default_rng(6)
    centres = r.integers(-2000, 2000, (40, 16))
    rows = np.concatenate([c + r.integers(-5, 6, (100, 16)) for c in centres])
    tree = MTree(np.arange(len(rows)), rows)
    seen = []

    class Counted(np.ndarray):
        def __matmul__(self, other):
            seen.append(len(self))
            return np.asarray(self) @ other

    tree.rows = tree.rows.view(Counted)
    best = tree.search(rows[5], 5, 5)
    scores = rows @ rows[5]
    want = sorted(((-s, i) for i, s in enumerate(scores) if i != 5))[:5]
    assert best == [(-s, i) for s, i in want]
    assert sum(seen) < 0.75 * len(rows)


def test_repeated_and_null_ids_in_a_search(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [0.5, 0.0]), (1, [0.5, 0.0]), (2, [0.0, 0.5]), (None, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for shard_rows in (100, 2):
        got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in top_k(df, F.col("vec_id") % 50 == 0, k=2, shard_rows=shard_rows).collect())
        assert got == [(0, 1, 1, 256 * 128), (0, 1, 2, 256 * 128), (0, 2, 1, 0), (0, 2, 1, 256 * 128)]


def test_cells_leave_out_only_what_cannot_win():
    r = np.random.default_rng(7)
    centres = r.integers(-2000, 2000, (12, 16))
    rows = np.concatenate([c + r.integers(-40, 41, (60, 16)) for c in centres])
    cells = Cells([list(map(int, v)) for v in rows[::60]])
    at = [cells.nearest(v) for v in rows]
    cell, apart = np.array([c for c, _ in at]), np.array([d for _, d in at])
    cells.fill([(int(c), int((cell == c).sum()), float(apart[cell == c].max())) for c in np.unique(cell)], 25)
    sent = 0
    for q in rows[::17].astype(float):
        done, shards = cells.first_round(q)
        scores = rows @ q
        least = np.sort(scores[cell == done])[-5] if (cell == done).sum() >= 5 else None
        more = cells.second_round(q, done, least)
        needed = {int(c) for c in np.unique(cell[scores >= (least if least is not None else -np.inf)])} - {done}
        assert all(set(cells.shards[c]) <= set(more) for c in needed) and not set(shards) & set(more)
        sent += len(shards) + len(more)
    assert sent < 0.6 * len(rows[::17]) * sum(map(len, cells.shards))
