"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A text is the set of its distinct k-word shingles, as 64-bit hashes; texts with equal sets count as one node,
named by a hash of the set. A node's shingles are ordered rare-first by a table of 2**23 hashed counters over the
whole corpus, then by hash: a fixed-size table and one total order for all. (Any order gives the same result; the counters
only keep frequent shingles out of prefixes.) A linked pair shares a shingle of both prefixes. Pairs that pass the length
and positional filters are made distinct and verified once: first by the suffix filter, then exactly.

Parities (below) tell nothing of long sets, and unrelated long texts often share one rare shingle by chance. So prefixes of long sets
are longer by ``need`` - 1 shingles, and a linked pair shares ``need`` or more of them (the ``need``-th shared one comes after at most
size - overlap + ``need`` - 1 others in either set). Shared ones in large groups aren't counted, but such groups link by leaders.

A group is the nodes that have one prefix shingle in common. Small groups are paired off. A large one isn't: its nodes, band of
length by band, are compared with one leader only, the node whose prefix is most common in the corpus. Nodes that link with the
leader need no links to each other. For the rest let D(x) be what only one of x and the leader has. Two nodes differ by
D(x) and D(y) without what these share, and if x does not link with the leader, x and any y that links with x have a shingle of
D(x) and D(y) in common (|D(x)| is over the bound, and |D(y)| is at least the difference of the lengths). So the rest
is a join of the same kind on the sets D, ordered by their shingles' number within the leader's group: what all members share is
gone from them, and groups get smaller. This goes on until no group has a node that isn't linked with its leader.

The suffix filter works in two steps. A string of ``PARITY`` bits for each node holds the parity of its shingles' number in as
many hash ranges; then the sorted sets are cut at ``PIVOTS`` of one set's shingles, and the differences of the parts' sizes are
summed up. Both are lower bounds of the number of shingles that only one of two sets has. So is a finer string of parities, with as many
bits as a long set has shingles or more; it parts unrelated long sets, which meet by chance ever more often, before the sets themselves are sent.

Results by case: null text, empty text and text without words make an empty set, linked with nothing; repeated rows are
rows of their own with one component; a text without an id links like any other, and its component's id is the least of the
ids there, null where there are none; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import forget, small, staged
from tessera.llm.connected import components
from tessera.llm.hashing import mix, shingle_sets, steps, utf8

#: A shingle is known to be frequent if it is counted more often than its counter's other shingles vary: the more counters, the rarer the prefixes.
COUNTERS = 1 << 23
BLOCK = 1 << 13
#: Counts beyond this are equal in the order of shingles.
MOST = (1 << 16) - 1
#: Groups of up to so many nodes are paired off.
SMALL = 128
#: Shingles counted more often than this, and than four times the average counter, are never brought together in one task.
HOT = 1 << 12
PARITY, PIVOTS = 512, 7
#: Sets of so many shingles or more have a finer string of parities as well.
LONG = 512
_WORDS = PARITY // 64
_BINS = pa.list_(pa.int64())
#: Documents to verify are looked up by broadcasting their ids up to this many, by a shuffle beyond.
BROADCAST_IDS = 1_000_000


def _signature(own: np.ndarray) -> int:
    return int(mix(mix(own).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own))).view(np.int64)[0])


def _packed(counts: np.ndarray) -> bytes:
    """Counts of a block, most of them small, in few bytes."""
    kind = next(t for t in (np.uint8, np.uint16, np.uint32) if counts.max() <= np.iinfo(t).max)
    return zlib.compress(counts.astype(kind).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    data = zlib.decompress(data)
    return np.frombuffer(data, f"u{len(data) // BLOCK}")


def parities(own: np.ndarray, bits: int) -> np.ndarray:
    """Of a set's hashes, the parity of their number in each of as many hash ranges (a power of two), packed."""
    flips = np.bincount((own >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8))


def fine_bound(x: bytes, y: bytes) -> int:
    """At least so many items are in one of two sets only, by their fine parities; the longer string is folded to the other's length."""
    x, y = (np.unpackbits(np.frombuffer(z, np.uint8)) for z in sorted((x, y), key=len))
    while len(y) > len(x):
        y = y[::2] ^ y[1::2]
    return int((x ^ y).sum())


def _near(percent: int):
    """a, b, total (of their sizes), a_fine, b_fine -> the pairs a, b that may link."""

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))
            may = [x is None or y is None or (100 + percent) * fine_bound(x, y) <= (100 - percent) * total for total, x, y in rows]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(may, pa.bool_()))

    return run


def _measure(k: int):
    """doc_id, text, key -> a row for each document (key, n, sig, bins, fine) and, at the end, the counters in blocks."""

    def run(batches):
        counters = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            n, sig, bins, fine = [], [], [], []
            for first, last in steps(offsets):
                hashes, at = shingle_sets(data, offsets[first : last + 1], k)
                for i in range(last - first):
                    own = hashes[at[i] : at[i + 1]]
                    n.append(len(own))
                    sig.append(_signature(own) if len(own) else None)
                    bins.append(parities(own, PARITY).view(np.int64))
                    fine.append(parities(own, 1 << (len(own) - 1).bit_length()).tobytes() if len(own) >= LONG else None)
                np.add.at(counters, (hashes & np.uint64(COUNTERS - 1)).astype(np.int64), np.uint32(1))
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int32()), pa.array(sig, pa.int64()), pa.array(bins, _BINS)]
                + [pa.array(fine, pa.binary()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())],
                names=["doc_id", "key", "n", "sig", "bins", "fine", "block", "counts"],
            )
        used = [b for b in range(COUNTERS // BLOCK) if counters[b * BLOCK : (b + 1) * BLOCK].any()]
        for b in used:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, _BINS)]
                + [pa.nulls(1, pa.binary()), pa.array([b], pa.int32()), pa.array([_packed(counters[b * BLOCK : (b + 1) * BLOCK])], pa.binary())],
                names=["doc_id", "key", "n", "sig", "bins", "fine", "block", "counts"],
            )

    return run


def _add_blocks(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if b in sums:
                sums[b] += _unpacked(counts)
            else:
                sums[b] = _unpacked(counts).astype(np.int64)
    for b, total in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([_packed(np.minimum(total, MOST))], pa.binary())], names=["block", "counts"])


def needed(n: int, percent: int) -> int:
    """So many shingles are shared by the prefixes of linked sets of this size: 1, more where parities can't part unrelated sets."""
    if 2 * (100 - percent) * n < (100 + percent) * PARITY * 2 // 5:
        return 1
    return 1 + (n - (percent * n + 99) // 100 + 1) // 8


def _prefixes(k: int, percent: int, counts, hot: int):
    """doc_id, text -> a row for each shingle of the probe prefix of each set that the task hasn't had yet."""

    def run(batches):
        counters, seen = counts.value, set()
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for first, last in steps(offsets):
                hashes, at = shingle_sets(data, offsets[first : last + 1], k)
                h, sig, size, pos, rank, often, least = [], [], [], [], [], [], []
                for i in range(last - first):
                    own = hashes[at[i] : at[i + 1]]
                    n = len(own)
                    if n == 0 or (s := _signature(own)) in seen:
                        continue
                    if len(seen) < 1 << 20:
                        seen.add(s)
                    need = needed(n, percent)
                    length = min(n, n - (percent * n + 99) // 100 + need)
                    counted = counters[(own & np.uint64(COUNTERS - 1)).astype(np.int64)]
                    order = np.argsort(counted, kind="stable")[:length]
                    counted = counted[order]
                    h.append(own[order])
                    sig.append(np.full(length, s, np.int64))
                    size.append(np.full(length, n, np.int32))
                    pos.append(np.arange(length, dtype=np.int32))
                    rank.append(np.full(length, -int(100 * np.log2(1.0 + counted).mean()), np.int32))
                    often.append(counted > hot)
                    least.append(np.full(length, need, np.int32))
                if h:
                    cols = [np.concatenate(x) for x in ([y.view(np.int64) for y in h], sig, size, pos, rank, often, least)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["key", "sig", "n", "pos", "rank", "hot", "need"])

    return run


def _sets(k: int):
    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            ids = batch.column(0)
            for first, last in steps(offsets):
                hashes, at = shingle_sets(data, offsets[first : last + 1], k)
                sig = [_signature(hashes[at[i] : at[i + 1]]) if at[i + 1] > at[i] else None for i in range(last - first)]
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, last - first), pa.array(sig, pa.int64()), lists], names=["doc_id", "sig", "items"]
                )

    return run


def suffix_bound(x: np.ndarray, y: np.ndarray) -> int:
    """At least so many items are in one of the two sorted sets only: cut at items of y, by the differences of the parts' sizes."""
    cuts = y[len(y) * np.arange(1, PIVOTS + 1) // (PIVOTS + 1)]
    ends = (np.concatenate([[0], np.searchsorted(z, cuts), [len(z)]]) for z in (x, y))
    mine, other = (np.diff(e) for e in ends)
    return int(np.abs(mine - other).sum())


def _compare(percent: int):
    """a, b, star, rank, a_items, b_items -> whether each pair links; of pairs with a leader (b) also what only one of the two has."""

    def run(batches):
        for batch in batches:
            left, right = batch.column(4), batch.column(5)
            sets = []
            for column in (left, right):
                flat = column.values.to_numpy().view(np.uint64)
                cuts = column.offsets.to_numpy()
                sets.append([flat[p:q] for p, q in zip(cuts[:-1], cuts[1:])])
            star = batch.column(2).to_pylist()
            linked, sizes, deltas, at = [], [], [], [0]
            for x, y, with_leader in zip(*sets, star):
                may = (100 - percent) * (len(x) + len(y))
                if with_leader or (100 + percent) * suffix_bound(x, y) <= may:
                    only = np.setxor1d(x, y, assume_unique=True)
                    linked.append((100 + percent) * len(only) <= may)
                else:
                    only = x[:0]
                    linked.append(False)
                if with_leader:
                    deltas.append(only)
                sizes.append(len(x))
                at.append(at[-1] + len(only) * with_leader)
            flat = np.concatenate(deltas) if deltas else np.zeros(0, np.uint64)
            delta = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(linked, pa.bool_()), pa.array(sizes, pa.int32()), delta],
                names=["a", "b", "star", "rank", "linked", "n", "delta"],
            )

    return run


class JaccardJoin:
    """One join: ``link()`` gives the documents with their sizes and components.

    percent: texts link when 100 * intersection >= percent * union of their k-word shingle sets.
    """

    def __init__(self, docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text"):
        self.k, self.percent = k, percent
        self.docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text).cast("string")).alias("key"))
        self.spark = docs.sparkSession
        #: Staged tables that go as soon as the step that reads them has ended.
        self.passing: list[DataFrame] = []

    def _may_link(self, x: str, y: str) -> Column:
        """Length and positional filters on one shared item of x and y, which are sets of ``size`` items that stand for ones of n.

        Where several shared items are needed each is counted, so it need not be the first that x and y share.
        """
        p = self.percent
        c = lambda side, name: F.col(f"{side}.{name}").cast("long")
        xn, yn = c(x, "n"), c(y, "n")
        overlap = F.floor(((100 + p) * (c(x, "size") + c(y, "size")) - (100 - p) * (xn + yn) + 2 * (100 + p) - 1) / (2 * (100 + p)))
        before = F.when((c(x, "need") > 1) & (c(y, "need") > 1), F.least(c(x, "pos"), c(y, "pos"))).otherwise(F.lit(0))
        reach = before + F.least(c(x, "size") - c(x, "pos"), c(y, "size") - c(y, "pos"))
        return (100 * F.least(xn, yn) >= p * F.greatest(xn, yn)) & (reach >= overlap)

    def measure(self) -> None:
        kinds = "doc_id long, key long, n int, sig long, bins array<bigint>, fine binary, block int, counts binary"
        out = staged(self.docs.mapInArrow(_measure(self.k), kinds), "jaccard-sets")
        self.rows = out.where("block is null").select("doc_id", "key", "n", "sig", "bins", "fine")
        blocks = out.where("block is not null").select("block", "counts").repartition("block")
        summed = blocks.mapInArrow(_add_blocks, "block int, counts binary").collect()
        counters = np.zeros(COUNTERS, np.uint16)
        for r in summed:
            counters[r.block * BLOCK : (r.block + 1) * BLOCK] = _unpacked(r.counts)
        self.hot = int(min(max(HOT, 4 * counters.mean()), MOST - 1))
        self.counters = self.spark.sparkContext.broadcast(counters)
        named = self.rows.where("sig is not null").groupBy("sig")
        least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "key"))).alias("least")
        self.nodes = staged(named.agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bins").alias("bins"), F.first("fine").alias("fine"), least), "jaccard-nodes")

    def first_rows(self) -> DataFrame:
        """The rows of the first join: each node by the shingles of its prefix."""
        kinds = "key long, sig long, n int, pos int, rank int, hot boolean, need int"
        rows = self.docs.select("doc_id", "text").mapInArrow(_prefixes(self.k, self.percent, self.counters, self.hot), kinds)
        return rows.select("key", "sig", "n", "pos", F.col("n").alias("size"), "rank", F.lit(True).alias("out"), "hot", "need")

    def _grouped(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Small groups, each with its nodes, and the rows of large ones."""
        # a key that isn't hot has a bounded number of rows; hot ones are dealt out, and go to leaders without being brought together
        dealt = F.when(F.col("hot"), F.col("sig")).otherwise(F.lit(0)).alias("dealt")
        group = Window.partitionBy("key", "dealt")
        # one select over a column, so that the rows are dealt out and sorted once
        several = (F.min("sig").over(group) < F.max("sig").over(group)).alias("several")
        held = rows.select("*", dealt).select("*", several).where("hot or several")
        # copies of a text in several tasks are rows of one node; gathered where they are, so that pairs need no shuffle of the rows again
        node = F.struct(*[c for c in rows.columns if c != "key"])
        held = staged(held.groupBy("key", "dealt").agg(F.collect_set(node).alias("nodes")), "jaccard-groups")
        self.passing.append(held)
        few = (F.size("nodes") <= SMALL) & ~F.col("nodes")[0]["hot"]
        return held.where(few), held.where(~few).select("key", F.inline("nodes"))

    def _small_pairs(self, small: DataFrame) -> DataFrame:
        """a, b: the pairs of small groups that pass all filters before the sets are there."""
        met = small.select("nodes", F.explode("nodes").alias("x")).select("x", F.explode("nodes").alias("y"))
        met = met.where((F.col("x.sig") < F.col("y.sig")) & (F.col("x.out") | F.col("y.out"))).where(self._may_link("x", "y"))
        met = met.select(F.col("x.sig").alias("a"), F.col("y.sig").alias("b"), F.least("x.need", "y.need").alias("need"))
        pairs = met.groupBy("a", "b", "need").agg(F.count(F.lit(1)).alias("shared")).where("shared >= need").select("a", "b")
        node = lambda c: self.nodes.select(F.col("sig").alias(c), F.struct("n", "bins").alias(f"{c}_"))
        apart = sum((F.bit_count(F.col("a_.bins")[i].bitwiseXOR(F.col("b_.bins")[i])) for i in range(_WORDS)), F.lit(0))
        near = (100 + self.percent) * apart <= (100 - self.percent) * (F.col("a_.n").cast("long") + F.col("b_.n"))
        total = (F.col("a_.n").cast("long") + F.col("b_.n")).alias("total")
        pairs = pairs.join(node("a"), "a").join(node("b"), "b").where(near).select("a", "b", total)
        for c in "ab":
            fine = self.nodes.where("fine is not null").select(F.col("sig").alias(c), F.col("fine").alias(f"{c}_fine"))
            pairs = pairs.join(fine, c, "left")
        return pairs.select("a", "b", "total", "a_fine", "b_fine").mapInArrow(_near(self.percent), "a long, b long")

    def _leader_pairs(self, large: DataFrame) -> DataFrame:
        """a, rank, b: each node of a large group with its leaders b; a group's nodes are taken two neighbouring bands of length at a time.

        Leaders are the least by one order of all nodes, so those of later joins come after those of earlier ones, and the joins end.
        """
        # a little wider than the ratio of lengths, so that rounding can't part two bands
        band = F.floor(F.log("n") / (math.log(100 / self.percent) * (1 + 1e-9))) if self.percent < 100 else F.col("n")
        rows = large.select("key", "sig", "rank", "out", F.explode(F.array(band.cast("long"), band.cast("long") - 1)).alias("band"))
        lead = rows.groupBy("key", "band").agg(F.min(F.struct("rank", "sig")).alias("lead"), F.max("out").alias("any"))
        lead = staged(lead.where("any").select("key", "band", F.col("lead.sig").alias("b")), "jaccard-leaders")
        self.passing.append(lead)
        pairs = rows.join(small(lead), ["key", "band"]).where("sig <> b")
        return pairs.select(F.col("sig").alias("a"), "b", "rank").distinct()

    def _next_rows(self, compared: DataFrame) -> DataFrame:
        """The rows of the next join: nodes of groups that have one not linked with the leader, by the prefixes of their differences."""
        p = self.percent
        open_ = small(staged(compared.where("star and not linked").select("b").distinct(), "jaccard-open"))
        sets = compared.where("star").join(open_, "b", "left_semi").select("b", F.col("a").alias("sig"), "n", "rank", (~F.col("linked")).alias("out"), "delta")
        items = sets.select("b", "sig", "n", "rank", "out", F.size("delta").alias("size"), F.explode("delta").alias("item"))
        often = items.groupBy("b", "item").agg(F.count(F.lit(1)).alias("times"), F.max("out").alias("any"))
        own = F.array_sort(F.collect_list(F.struct("times", "item", "any"))).alias("items")
        wide = items.join(often, ["b", "item"]).groupBy("b", "sig", "n", "rank", "out", "size").agg(own)
        size, n = F.col("size").cast("long"), F.col("n").cast("long")
        overlap = F.greatest(F.lit(1), size - F.floor(n * (100 - p) / p))
        overlap = F.when(F.col("out"), overlap).otherwise(F.greatest(overlap, F.floor(size * p / (100 + p)) + 1))
        prefix = F.posexplode(F.slice("items", F.lit(1), (size - overlap + 1).cast("int"))).alias("pos", "i")
        rows = wide.where(size >= overlap).select("b", "sig", "n", "size", "rank", "out", prefix).where("i.times > 1 and i.any")
        key, hot = F.xxhash64("b", "i.item").alias("key"), (F.col("i.times") > self.hot).alias("hot")
        return rows.select(key, "sig", "n", "pos", "size", "rank", "out", hot, F.lit(1).alias("need"))

    def _items(self, sigs: DataFrame) -> DataFrame:
        """sig, items: the sets of these nodes, made again from one document of each."""
        wanted = staged(sigs.distinct().join(self.nodes.select("sig", "doc_id"), "sig"), "jaccard-wanted")
        self.passing.append(wanted)
        ids = wanted.select("doc_id").distinct()
        total, with_id = wanted.agg(F.count(F.lit(1)), F.count("doc_id")).first()
        if total <= BROADCAST_IDS:
            ids, wanted = F.broadcast(ids), F.broadcast(wanted)
        sets = self.docs.join(ids, "doc_id", "left_semi").select("doc_id", "text")
        kinds = "doc_id long, sig long, items array<bigint>"
        found = sets.mapInArrow(_sets(self.k), kinds).join(wanted, ["sig", "doc_id"], "left_semi").select("sig", "items")
        if with_id < total:
            # no id leads to these, so all texts without an id are made into sets, each text once
            texts = self.docs.where("doc_id is null").select("doc_id", "text").distinct()
            left = texts.mapInArrow(_sets(self.k), kinds).join(wanted.where("doc_id is null"), "sig", "left_semi")
            found = found.union(left.select("sig", "items").dropDuplicates(["sig"]))
        found = staged(found, "jaccard-items")
        self.passing.append(found)
        return found

    def _compared(self, pairs: DataFrame) -> DataFrame:
        """a, b, star, rank (of a), linked, n (of a), delta for pairs a, b, star, rank; each pair comes here once."""
        kinds = "a long, b long, star boolean, rank int, linked boolean, n int, delta array<bigint>"
        items = self._items(pairs.select(F.col("a").alias("sig")).union(pairs.select("b")))
        few = pairs.count() <= BROADCAST_IDS
        first = items.select(F.col("sig").alias("a"), F.col("items").alias("a_items"))
        met = first.join(F.broadcast(pairs) if few else pairs, "a")
        met = met.join(items.select(F.col("sig").alias("b"), F.col("items").alias("b_items")), "b")
        met = met.select("a", "b", "star", "rank", "a_items", "b_items")
        return staged(met.mapInArrow(_compare(self.percent), kinds), "jaccard-compared")

    def _pass(self) -> None:
        forget(*self.passing)
        self.passing.clear()

    def link(self) -> DataFrame:
        """doc_id, n_shingles, component_id for every document."""
        self.measure()
        rows, links = self.first_rows(), None
        while True:
            small, large = self._grouped(rows)
            pairs = self._small_pairs(small).select("a", "b", F.lit(False).alias("star"), F.lit(None).cast("int").alias("rank"))
            pairs = pairs.union(self._leader_pairs(large).select("a", "b", F.lit(True), "rank"))
            pairs = staged(pairs.groupBy("a", "b").agg(F.max("star").alias("star"), F.max("rank").alias("rank")), "jaccard-pairs")
            self._pass()  # the groups, before the sets come
            self.passing.append(pairs)
            compared = self._compared(pairs)
            self._pass()
            found = compared.where("linked").select("a", "b")
            links = found if links is None else links.union(found)
            if compared.where("star and not linked").isEmpty():
                break
            rows = self._next_rows(compared)
        links = staged(links.distinct(), "jaccard-links")
        roots = components(links)
        self.links, self.roots = links, roots
        nodes = self.nodes.select("sig", "doc_id").join(roots.withColumnRenamed("node", "sig"), "sig", "left")
        nodes = nodes.withColumn("root", F.coalesce("root", "sig"))
        least = nodes.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        named = nodes.join(least, "root").select("sig", "component_id")
        return self.rows.join(named, "sig", "left").select(
            "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
        )

    def survivors(self) -> DataFrame:
        """doc_id, key: of each component the row with the least id, then text hash, and each row without words; after ``link()``. Null ids are left out."""
        nodes = self.nodes.select("sig", "least").join(self.roots.withColumnRenamed("node", "sig"), "sig", "left")
        least = nodes.groupBy(F.coalesce("root", "sig").alias("root")).agg(F.min("least").alias("least")).where("least is not null")
        alone = self.rows.where("sig is null and doc_id is not null").select("doc_id", "key").distinct()
        return least.select("least.doc_id", "least.key").union(alone)


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return JaccardJoin(docs, k, percent, doc_id, text).link()
