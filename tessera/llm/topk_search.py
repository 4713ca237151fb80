"""Exact top-k search by inner product: M-trees of paged metric nodes, searched best-first.

With every vector lengthened by one component, sqrt(M - |x|^2) for rows and 0 for queries, where M is the largest squared
length, all rows have one length and the nearest rows are those with the largest inner products. So a metric tree
serves an inner product: d(q, x)^2 = |q|^2 + M - 2 <q, x>.

Rows go to the cell of their nearest pivot, cells being split by a hash into shards of bounded size; each shard is bulk-loaded into
pages. A page has a pivot, a covering radius, and for each entry the distance to the pivot; a page of pages likewise. A query visits
pages in the order of their bounds and stops at the first that can't beat its k-th score; an entry whose stored distance to its pivot
already rules it out, by the triangle inequality, isn't computed. Scores are integer inner products, computed exactly; bounds have
room for rounding.

Cells are searched best-first too, in two rounds: a query goes to the cell whose pivot has the largest inner product with it, then, with the
k-th score found there, to the cells that can still beat that: <q, x> <= <q, pivot> + |q| * radius. A task holds one shard at a time;
queries stream past it.

Results by case: null vectors and ones with null or non-finite components take no part; vectors whose length differs from the
query's are no candidates; ties go to the smaller id; rows that repeat an id are candidates of their own, except for the query of
that id; a query's id that has several vectors gets the ranks of each; rows without an id take no part; a query with fewer than k
candidates gets all; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import staged

SCALE, PAGE, SHARD_ROWS, PIVOTS = 256, 128, 16_384, 1024


class MTree:
    """Bulk-loaded tree over integer rows; ``top`` is the squared length that all lengthened rows have."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, page: int = PAGE, seed: int = 3):
        norms = (rows * rows).sum(1)
        self.top = float(norms.max())
        long = np.concatenate([rows.astype(np.float64), np.sqrt(np.maximum(self.top - norms, 0.0))[:, None]], 1)
        self.rng = np.random.default_rng(seed)
        nodes = [self._node(part, long) for part in self._split(np.arange(len(rows)), long, page)]
        # leaves hold their rows one after the other, so a run of entries is one slice; products of integers below 2**53 are exact
        order, at = np.concatenate([part for _, _, part, _ in nodes]), 0
        self.leaves = []
        for pivot, radius, part, apart in nodes:
            self.leaves.append((pivot, radius, at, apart))
            at += len(part)
        self.ids, self.rows = ids[order], rows[order].astype(np.float64)
        self.limit = float(np.sqrt(norms.max()))
        pivots = np.stack([p for p, _, _, _ in self.leaves])
        # one level of routing pages above the leaves
        self.routers = []
        for part in self._split(np.arange(len(pivots)), pivots, page):
            centre = pivots[part].mean(0)
            apart = np.sqrt(((pivots[part] - centre) ** 2).sum(1))
            radii = np.array([self.leaves[i][1] for i in part])
            self.routers.append((centre, float((apart + radii).max()), part, apart, radii))
        self.pivots = pivots

    def _node(self, part, long):
        pivot = long[part].mean(0)
        apart = np.sqrt(((long[part] - pivot) ** 2).sum(1))
        order = np.argsort(apart)
        return pivot, float(apart.max()), part[order], apart[order]

    def _split(self, part: np.ndarray, points: np.ndarray, page: int) -> list[np.ndarray]:
        """Balanced halving by the distances to two far points, until a part fits a page."""
        out, waiting = [], [part]
        while waiting:
            own = waiting.pop()
            if len(own) <= page:
                out.append(own)
                continue
            x = points[own]
            far = x[((x - x[self.rng.integers(len(own))]) ** 2).sum(1).argmax()]
            other = x[((x - far) ** 2).sum(1).argmax()]
            side = ((x - far) ** 2).sum(1) - ((x - other) ** 2).sum(1)
            order, half = np.argsort(side, kind="stable"), len(own) // 2
            waiting += [own[order[:half]], own[order[half:]]]
        return out

    def search(self, query: np.ndarray, k: int, but: int | None, least: float = -np.inf) -> list[tuple[int, int]]:
        """The k best (score, id) of ``least`` or more, ties to smaller ids, without rows of id ``but``."""
        exact = query.astype(np.float64)
        if self.limit * float(np.sqrt((exact * exact).sum())) >= 2.0**52:
            raise OverflowError("components are too large for exact scores")
        q = np.append(exact, 0.0)
        base = float((q * q).sum()) + self.top
        slack = 1e-6 * (base + 1)
        best: list[tuple[int, int]] = []  # heap: worst on top, as (score, -id)
        floor_score = lambda: max(best[0][0], least) if len(best) == k else least

        def farthest() -> float:
            """Distance beyond which nothing can enter."""
            s = floor_score()
            return np.inf if s == -np.inf else float(np.sqrt(max(0.0, base - 2 * s + slack)))

        queue, n = [], 0
        for node in self.routers:
            d = float(np.sqrt(((node[0] - q) ** 2).sum()))
            heapq.heappush(queue, (max(0.0, d - node[1]), n, True, node, d))
            n += 1
        while queue:
            bound, _, routing, node, d = heapq.heappop(queue)
            reach = farthest()
            if bound > reach:
                break
            if routing:
                _, _, part, apart, radii = node
                part = part[np.abs(d - apart) - radii <= reach]  # by the stored distance, before any is computed
                ds = np.sqrt(((self.pivots[part] - q) ** 2).sum(1))
                for i, own in zip(part, ds):
                    low = max(0.0, float(own) - self.leaves[i][1])
                    if low <= reach:
                        heapq.heappush(queue, (low, n, False, self.leaves[i], float(own)))
                        n += 1
                continue
            _, _, at, apart = node
            first, last = at, at + len(apart)
            if d - reach > apart[0] or d + reach < apart[-1]:
                first, last = at + np.searchsorted(apart, d - reach), at + np.searchsorted(apart, d + reach, side="right")
            scores = self.rows[first:last] @ exact
            for i in np.flatnonzero(scores >= floor_score()):
                row = int(self.ids[first + i])
                if row == but:
                    continue
                item = (int(scores[i]), -row)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def quantised(df: DataFrame, vec_id: str, embedding: str, scale: int, asked: Column) -> DataFrame:
    """vec_id, v: array<long> of floor(scale * x), asked; only vectors whose components are all finite."""
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"), F.coalesce(asked, F.lit(False)).alias("asked"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & finite)
    return rows.select("vec_id", F.transform("e", lambda x: F.floor(x * float(scale)).cast("long")).alias("v"), "asked")


class Cells:
    """Pivots by length of vectors; cell 0 is for vectors whose length no pivot has."""

    def __init__(self, pivots: list[list[int]]):
        own = defaultdict(list)
        for v in dict.fromkeys(map(tuple, pivots)):
            own[len(v)].append(v)
        self.pivots, self.first, n = {}, {}, 1
        for dim, held in own.items():
            self.pivots[dim] = np.array(held, dtype=np.float64).reshape(len(held), dim)
            self.first[dim] = n
            n += len(held)
        self.n = n
        self.radius, self.shards = np.zeros(n), [[] for _ in range(n)]

    def nearest(self, v: np.ndarray) -> tuple[int, float]:
        if len(v) not in self.pivots:
            return 0, 0.0
        apart = ((self.pivots[len(v)] - v) ** 2).sum(1)
        at = int(apart.argmin())
        return self.first[len(v)] + at, float(np.sqrt(apart[at]))

    def fill(self, stats, shard_rows: int) -> list[tuple[int, int, int]]:
        """Radii and shards from (cell, rows, radius); gives (cell, first shard, shards)."""
        out, at = [], 0
        for cell, rows, radius in sorted(stats):
            parts = -(-rows // shard_rows)
            self.radius[cell], self.shards[cell] = radius, list(range(at, at + parts))
            out.append((cell, at, parts))
            at += parts
        return out

    def first_round(self, q: np.ndarray) -> tuple[int, list[int]]:
        """The cell to begin with, and its shards."""
        if len(q) not in self.pivots:
            return 0, self.shards[0]
        first, pivots = self.first[len(q)], self.pivots[len(q)]
        held = [c for c in range(first, first + len(pivots)) if self.shards[c]]
        if not held:
            return 0, self.shards[0]
        cell = held[int((pivots[np.array(held) - first] @ q).argmax())]
        return cell, self.shards[cell]

    def second_round(self, q: np.ndarray, done: int, least: float | None) -> list[int]:
        """Shards of the cells that may hold a score of ``least`` or more."""
        out = [] if done == 0 or len(q) in self.pivots else list(self.shards[0])
        if len(q) in self.pivots:
            first, pivots = self.first[len(q)], self.pivots[len(q)]
            bound = pivots @ q + np.sqrt(q @ q) * self.radius[first : first + len(pivots)]
            bound += 1e-9 * np.abs(bound) + 1e-6
            for c in np.flatnonzero(bound >= (-np.inf if least is None else least)) + first:
                if c != done:
                    out += self.shards[c]
        return out


def _vectors(column: pa.Array) -> list[np.ndarray]:
    flat, cuts = column.values.to_numpy(), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def _placed(held):
    @F.arrow_udf("struct<cell:int,apart:double>")
    def run(v: pa.Array) -> pa.Array:
        found = [held.value.nearest(x) for x in _vectors(v)]
        return pa.StructArray.from_arrays([pa.array([c for c, _ in found], pa.int32()), pa.array([d for _, d in found], pa.float64())], names=["cell", "apart"])

    return run


def _first_shards(held):
    @F.arrow_udf("struct<cell:int,shards:array<int>>")
    def run(v: pa.Array) -> pa.Array:
        found = [held.value.first_round(x.astype(np.float64)) for x in _vectors(v)]
        return pa.StructArray.from_arrays([pa.array([c for c, _ in found], pa.int32()), pa.array([s for _, s in found], pa.list_(pa.int32()))], names=["cell", "shards"])

    return run


def _other_shards(held):
    @F.arrow_udf("array<int>")
    def run(v: pa.Array, cell: pa.Array, least: pa.Array) -> pa.Array:
        own = zip(_vectors(v), cell.to_pylist(), least.to_pylist())
        return pa.array([held.value.second_round(x.astype(np.float64), c, s) for x, c, s in own], pa.list_(pa.int32()))

    return run


def _search(k: int):
    """shard, id, v, query, least; a shard's rows, then its queries -> query_id, same, vec_id, score."""

    def run(batches):
        shard, ids, rows, trees = None, [], [], None
        for batch in batches:
            columns = (batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5))
            out = []
            for own, i, query, least, same, v in zip(*columns, _vectors(batch.column(2))):
                if own != shard:
                    shard, ids, rows, trees = own, [], [], None
                if not query:
                    ids.append(i)
                    rows.append(v.copy())
                    continue
                if trees is None:
                    trees = _trees(ids, rows)
                if len(v) in trees:
                    found = trees[len(v)].search(v if len(v) else np.zeros(1, np.int64), k, i, -np.inf if least is None else least)
                    out += [(i, same, x, s) for s, x in found]
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "same", "vec_id", "score"])

    return run


def _trees(ids: list[int], rows: list[np.ndarray]) -> dict[int, MTree]:
    by = defaultdict(list)
    for at, v in enumerate(rows):
        by[len(v)].append(at)
    ids_ = np.array(ids, dtype=np.int64)
    return {dim: MTree(ids_[at], np.stack([rows[i] for i in at]) if dim else np.zeros((len(at), 1), np.int64)) for dim, at in by.items()}


def top_k(
    df: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE, shard_rows: int = SHARD_ROWS, pivots: int = PIVOTS
) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of ``df`` for which the condition ``queries`` holds; at most ``pivots`` cells."""
    spark = df.sparkSession
    rows = staged(quantised(df, vec_id, embedding, scale, queries), "search-rows")
    count = -(-rows.count() // shard_rows)
    chosen = rows.orderBy(F.xxhash64("v"), "vec_id").limit(min(pivots, count)).select("v").collect() if count > 1 else []
    cells = Cells([r.v for r in chosen])
    placed = staged(rows.withColumn("at", _placed(spark.sparkContext.broadcast(cells))(F.col("v"))).select("vec_id", "v", "asked", "at.*"), "search-placed")
    stats = [tuple(r) for r in placed.groupBy("cell").agg(F.count(F.lit(1)), F.max("apart")).collect()]  # a row a cell
    shards = spark.createDataFrame(cells.fill(stats, shard_rows), "cell int, first int, parts int")
    held = spark.sparkContext.broadcast(cells)
    none = F.lit(None).cast("long")
    data = placed.join(F.broadcast(shards), "cell").select(
        (F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), F.col("parts"))).cast("int").alias("shard"), F.col("vec_id").alias("id"), "v", F.lit(False).alias("query"), none.alias("least"), none.alias("same")
    )
    asked = placed.where("asked").select(F.col("vec_id").alias("id"), "v", F.xxhash64("v").alias("same")).distinct()
    asked = staged(asked.withColumn("at", _first_shards(held)(F.col("v"))).select("id", "v", "same", "at.cell", "at.shards"), "search-asked")

    def searched(sent: DataFrame) -> DataFrame:
        """Each query at the shards it is sent to."""
        sent = sent.select(F.explode("shards").alias("shard"), "id", "v", F.lit(True).alias("query"), "least", "same")
        both = data.join(F.broadcast(sent.select("shard").distinct()), "shard", "left_semi").unionByName(sent)
        dealt = both.repartition("shard").sortWithinPartitions("shard", "query").select("shard", "id", "v", "query", "least", "same")
        return dealt.mapInArrow(_search(k), "query_id long, same long, vec_id long, score long")

    order = Window.partitionBy("query_id", "same").orderBy(F.col("score").desc(), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    found = ranked(searched(asked.withColumn("least", none)))
    if len(cells.shards) > 1:
        found = staged(found.drop("rank"), "search-found")
        worst = ranked(found).where(F.col("rank") == k).select(F.col("query_id").alias("id"), "same", F.col("score").alias("least"))
        more = asked.drop("shards").join(worst, ["id", "same"], "left")
        more = more.withColumn("shards", _other_shards(held)(F.col("v"), F.col("cell"), F.col("least")))
        found = ranked(found.union(searched(more)))
    return found.select("query_id", "rank", "vec_id", "score")
