"""Suffix-array dedup: remove every byte covered by a string of ``size`` bytes that also starts earlier.

Texts that are equal to one with a smaller id go whole (if they hold a window); only first copies are looked into.

A window of ``size`` bytes is named by the least hash of its ``GRAM``-byte strings, so equal windows have equal names. A run of windows
with one name is a segment; long runs are cut into pieces of ``PIECE`` windows. Three steps, all by name:

1. Names are counted; a Bloom filter of fixed size holds those that occur twice. Where they are too many for it, the segments are
   joined to them by a shuffle instead.
2. Segments with such names are written out by digest. Equal segments are one: its first occurrence (by document id, then start) stands
   for all, and the others are removed whole. This is a partial aggregation, so a passage with many copies is one row a task.
3. The bytes of names that still have several different segments (or a segment that repeats its own name) go to shards. A shard's segments are joined into
   one string; its suffix array is built by induced sorting, and permuted common prefixes of ``size`` or more show the equal
   windows, of which the earliest stays. A name with more than ``SHARD_SEGMENTS`` different segments (a very common phrase in
   as many surroundings) is more than one shard's work: its windows are dealt out by 128-bit hashes of their own.

Results by case: null text is empty; texts shorter than ``size`` lose nothing; matches never cross documents; null ids rank first;
rows that repeat an id and a text are one document (each row gets its result); an empty table gives no rows; very long texts
are handled whole; only the named columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small, staged
from tessera.llm.hashing import mix, powers, steps, utf8
from tessera.llm.suffix_array import permuted_lcp, suffix_array

SIZE, GRAM, PIECE = 100, 40, 256
#: Bits of the Bloom filter, names that it serves, bytes of a shard's string, and segments of one name in a shard.
BLOOM_BITS, BLOOM_NAMES, SHARD_BYTES, SHARD_SEGMENTS = 1 << 26, 8_000_000, 1_000_000, 4096
#: Later copies are kept out of the scans by broadcasting their ids up to this many, by a shuffle beyond.
BROADCAST_IDS = 1_000_000
_BASE = 0x9E3779B97F4A7C15 | 1


class Segments:
    """Segments of some rows: row, start in the row, windows, name, and whether the name occurs twice inside."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, size: int):
        base = offsets[0]
        part, offs = data[base : offsets[-1]], offsets - base
        n, span = len(part), size - GRAM + 1
        self.row = self.start = self.windows = np.zeros(0, np.int64)
        self.name, self.again = np.zeros(0, np.uint64), np.zeros(0, bool)
        if n < size:
            return
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=sums[1:])
        gram = mix((sums[GRAM:] - sums[:-GRAM]) * powers(pow(_BASE, -1, 1 << 64), n)[: n - GRAM + 1])
        least, have = gram, 1
        while 2 * have <= span:
            least, have = np.minimum(least[:-have], least[have:]), 2 * have
        if have < span:
            least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
        valid = np.zeros(len(least) + 1, dtype=np.int32)
        first, last = offs[:-1], offs[1:] - size + 1
        long = last > first
        np.add.at(valid, first[long], 1)
        np.add.at(valid, last[long], -1)
        inside = np.cumsum(valid[:-1]) > 0
        new = inside.copy()
        opens = np.zeros(len(least), dtype=bool)
        opens[first[long]] = True
        new[1:] &= (least[1:] != least[:-1]) | ~inside[:-1] | opens[1:]
        at = np.flatnonzero(new)
        stop = np.zeros(len(least) + 1, dtype=bool)
        stop[last[long]] = True
        stops = np.flatnonzero(stop)
        ends = np.minimum(np.append(at[1:], len(least)), stops[np.searchsorted(stops, at, side="right")])
        count = -(-(ends - at) // PIECE)
        owner = np.repeat(np.arange(len(at)), count)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        begin = at[owner] + nth * PIECE
        end = np.minimum(begin + PIECE, ends[owner])
        # a window that starts with its name and is followed by one of the same name: the name occurs again
        twice = np.zeros(len(least) + 1, dtype=np.int64)
        hit = (gram[: len(least) - 1] == least[:-1]) & (least[1:] == least[:-1])
        np.cumsum(hit, out=twice[1 : len(least)])
        twice[len(least)] = twice[len(least) - 1]
        self.again = (twice[np.maximum(begin, end - 1)] - twice[begin]) > 0
        self.row = np.searchsorted(offs, begin, side="right") - 1
        self.start = begin - offs[self.row]
        self.windows = end - begin
        self.name = least[begin]


def _names(size: int):
    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            names, counts = [], []
            for first, last in steps(offsets):
                s = Segments(data, offsets[first : last + 1], size)
                names.append(s.name)
                counts.append(1 + s.again.astype(np.int32))
            names = np.concatenate(names) if names else np.zeros(0, np.uint64)
            if not len(names):
                continue
            own, at = np.unique(names, return_inverse=True)
            total = np.bincount(at, weights=np.concatenate(counts)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(total)], names=["name", "n"])

    return run


def _kept_segments(size: int, bloom, with_bytes: bool):
    """Segments whose names the filter holds; all of them without one."""

    def run(batches):
        bits, top = bloom.value if bloom is not None else None, np.uint64(BLOOM_BITS - 1)
        has = lambda at: (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for first, last in steps(offsets):
                offs = offsets[first : last + 1]
                s = Segments(data, offs, size)
                if bits is None:
                    at = np.arange(len(s.name))
                else:
                    at = np.flatnonzero(has(s.name & top) & has((s.name >> np.uint64(32)) & top))
                if not len(at):
                    continue
                low = offs[s.row[at]] + s.start[at]
                length = s.windows[at] + size - 1
                cut = np.concatenate([[0], np.cumsum(length)])
                flat = data[np.repeat(low - cut[:-1], length) + np.arange(cut[-1])]
                digests = b"".join(
                    hashlib.blake2b(flat[a:b], digest_size=16).digest() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())
                )
                digests = np.frombuffer(digests, np.int64).reshape(-1, 2)
                rows = pa.array(first + s.row[at])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(s.start[at].astype(np.int32))]
                    + [pa.array(s.windows[at].astype(np.int32)), pa.array(s.name[at].view(np.int64)), pa.array(s.again[at])]
                    + [pa.array(digests[:, 0]), pa.array(digests[:, 1])]
                    + ([pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(flat)])] if with_bytes else []),
                    names=["doc_id", "copy", "start", "windows", "name", "again", "d1", "d2"] + ["bytes"] * with_bytes,
                )

    return run


def later_windows(parts: list[bytes], order: np.ndarray, starts: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Runs (part, first, last) of windows of the parts that occur earlier, by (order of the part's document, start)."""
    length = np.array([len(p) for p in parts])
    t = np.frombuffer(b"\0".join(parts) + b"\0\0", dtype=np.uint8)
    text = t.astype(np.int64) + 2
    base = np.concatenate([[0], np.cumsum(length + 1)])[:-1]
    text[base + length] = 1  # between parts; data are 2 or more
    text[-1] = 0
    sa = suffix_array(text, 258)
    n = len(text)
    part = np.repeat(np.arange(len(parts)), length + 1)
    part = np.append(part, len(parts) - 1)[:n]
    for_start = np.arange(n) - base[part]
    whole = for_start + size <= length[part]
    whole[-1] = False
    prefix = permuted_lcp(text.astype(np.uint16), sa, base, PIECE + 2 * size)
    # suffixes with equal first ``size`` bytes are neighbours
    chained = whole[sa] & (prefix[sa] >= size)
    group = np.cumsum(~chained)
    ok = whole[sa]
    at = sa[ok]
    group = group[ok]
    when = np.lexsort((starts[part[at]] + for_start[at], order[part[at]], group))
    at, group = at[when], group[when]
    later = at[1:][group[1:] == group[:-1]]
    if not len(later):
        return []
    flag = np.zeros(n + 1, dtype=bool)
    flag[later] = True
    first = np.flatnonzero(flag[:-1] & ~np.concatenate([[False], flag[:-2]]))
    last = np.flatnonzero(flag[:-1] & ~flag[1:])
    return [(int(part[a]), int(for_start[a]), int(for_start[b])) for a, b in zip(first, last)]


def _shards(size: int, limit: int):
    """Rows (name, doc_id, copy, start, again, bytes), sorted by name -> removed spans of their first occurrences."""

    def spans(rows):
        # one order of the documents: null first, then id, then the copy's hash
        docs = sorted({(r[1] is not None, r[1] or 0, r[2]) for r in rows})
        place = {d: i for i, d in enumerate(docs)}
        order = np.array([place[(r[1] is not None, r[1] or 0, r[2])] for r in rows])
        found = later_windows([r[5] for r in rows], order, np.array([r[3] for r in rows]), size)
        for k, a, b in found:
            r = rows[k]
            yield r[1], r[2], r[3] + a, r[3] + b + size

    def batch_of(out):
        cols = list(zip(*out))
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())],
            names=["doc_id", "copy", "start", "end"],
        )

    def run(batches):
        shard, held, group = [], 0, []

        def close():
            nonlocal held
            if len(group) > 1 or group and group[0][4]:
                shard.extend(group)
                held += sum(len(r[5]) for r in group)
            group.clear()

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if group and r[0] != group[0][0]:
                    close()
                    if held >= limit:
                        if out := list(spans(shard)):
                            yield batch_of(out)
                        shard.clear()
                        held = 0
                group.append(r)
        close()
        if shard and (out := list(spans(shard))):
            yield batch_of(out)

    return run


def _bloom(names: DataFrame):
    """Two bits for each name, in words of 64; at most BLOOM_BITS / 64 rows come to the driver."""
    at = F.explode(F.array(F.col("name").bitwiseAND(BLOOM_BITS - 1), F.shiftrightunsigned("name", 32).bitwiseAND(BLOOM_BITS - 1)))
    bits = names.select(at.alias("p")).select(
        F.shiftright("p", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit")
    )
    got = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(BLOOM_BITS // 64, dtype=np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return names.sparkSession.sparkContext.broadcast(out)


def _window_hashes(size: int):
    """name, doc_id, copy, start, bytes -> each window by two hashes, and where it starts."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(4))
            length = np.diff(offsets)
            count = length - size + 1
            owner = np.repeat(np.arange(len(length)), count)
            within = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            first = offsets[owner] - offsets[0] + within
            part = data[offsets[0] : offsets[-1]].astype(np.uint64) + np.uint64(1)
            hashes = []
            for base in (_BASE, 0xD1342543DE82EF95):
                sums = np.zeros(len(part) + 1, dtype=np.uint64)
                np.cumsum(part * powers(base, len(part)), out=sums[1:])
                inverse = powers(pow(base, -1, 1 << 64), len(part) + 1)
                hashes.append(mix((sums[first + size] - sums[first]) * inverse[first]))
            rows = pa.array(owner)
            start = batch.column(3).to_numpy()[owner] + within
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(rows) for i in (0, 1, 2)), pa.array(start.astype(np.int32)), *(pa.array(h.view(np.int64)) for h in hashes)],
                names=["name", "doc_id", "copy", "start", "h1", "h2"],
            )

    return run


def _hot_spans(rows: DataFrame, size: int) -> DataFrame:
    """Later windows of names with very many different segments."""
    kinds = "name long, doc_id long, copy long, start int, h1 long, h2 long"
    windows = staged(rows.select("name", "doc_id", "copy", "start", "bytes").mapInArrow(_window_hashes(size), kinds), "suffix-windows")
    where = F.struct("doc_id", "copy", "start")
    first = windows.groupBy("name", "h1", "h2").agg(F.min(where).alias("first"), F.max(where).alias("last")).where(F.col("first") != F.col("last"))
    later = windows.join(first, ["name", "h1", "h2"]).where(where != F.col("first"))
    return later.select("doc_id", "copy", "start", (F.col("start") + size).alias("end"))


def removed_spans(docs: DataFrame, size: int, shard_bytes: int, bloom_names: int, shard_segments: int) -> DataFrame:
    """doc_id, copy, start, end: byte ranges (overlapping) that occur earlier."""
    names = docs.select("text").mapInArrow(_names(size), "name long, n int")
    names = staged(names.groupBy("name").agg(F.sum("n").alias("n")).where("n > 1").select("name"), "suffix-names")
    kinds = "doc_id long, copy long, start int, windows int, name long, again boolean, d1 long, d2 long"
    where = F.struct("doc_id", "copy", "start")
    scan = docs.select("doc_id", "copy", "text")
    few = names.count() <= bloom_names
    kept = scan.mapInArrow(_kept_segments(size, _bloom(names) if few else None, False), kinds)
    kept = staged(kept if few else kept.join(names, "name", "left_semi"), "suffix-segments")
    firsts = kept.groupBy("d1", "d2").agg(
        F.min(where).alias("first"), F.max(where).alias("last"), F.min("name").alias("name"), F.max("again").alias("again"), F.min("windows").alias("windows")
    )
    firsts = staged(firsts, "suffix-firsts")
    copied = firsts.where(F.col("first") != F.col("last")).select("d1", "d2", "first")
    later = kept.select("d1", "d2", "doc_id", "copy", "start", "windows").join(copied, ["d1", "d2"]).where(where != F.col("first"))
    out = later.select("doc_id", "copy", "start", (F.col("start") + F.col("windows") + (size - 1)).alias("end"))
    mixed = firsts.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("again")).where("n > 1 or again")
    mixed = staged(mixed.select("name", "n"), "suffix-mixed")
    if few:
        cut = scan.mapInArrow(_kept_segments(size, _bloom(mixed), True), kinds + ", bytes binary")
        cut = cut.groupBy("d1", "d2").agg(
            F.min(where).alias("first"), F.any_value("bytes").alias("bytes"), F.min("name").alias("name"), F.max("again").alias("again")
        )
        rows = cut.select("name", "first.doc_id", "first.copy", "first.start", "again", "bytes")
    else:
        wanted = firsts.join(mixed, "name", "left_semi").select("name", "first.*", "again", (F.col("windows") + (size - 1)).alias("length"))
        own = wanted.groupBy(F.col("doc_id").alias("s_id"), F.col("copy").alias("s_copy")).agg(F.collect_list(F.struct("name", "start", "again", "length")).alias("own"))
        held = scan.join(own, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("copy") == F.col("s_copy")))
        held = held.select("doc_id", "copy", F.col("text").cast("binary").alias("text"), F.explode("own").alias("s"))
        rows = held.select("s.name", "doc_id", "copy", "s.start", "s.again", F.substring("text", F.col("s.start") + 1, F.col("s.length")).alias("bytes"))
        rows = rows.dropDuplicates(["name", "doc_id", "copy", "start"])
    hot = mixed.where(F.col("n") > shard_segments).select("name")
    n_hot = hot.count()
    if n_hot:
        hot = F.broadcast(hot) if n_hot <= BROADCAST_IDS else hot
        rows = staged(rows, "suffix-bytes")
        out = out.union(_hot_spans(rows.join(hot, "name", "left_semi"), size))
        rows = rows.join(hot, "name", "left_anti").select("name", "doc_id", "copy", "start", "again", "bytes")
    sharded = rows.repartition("name").sortWithinPartitions("name")
    return out.union(sharded.mapInArrow(_shards(size, shard_bytes), "doc_id long, copy long, start int, end int"))


def cut_bytes(text, spans):
    """struct<n_bytes, n_removed, n_spans, kept>: what is left of the text's bytes without the spans."""
    kind = "struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept:binary>"

    @F.arrow_udf(kind)
    def run(texts: pa.Array, removed: pa.Array) -> pa.Array:
        data, offsets = utf8(texts)
        flat, at = removed.values.flatten(), removed.offsets.to_numpy()
        lows, highs = (x.to_numpy(zero_copy_only=False) for x in flat)
        sizes, gone, runs, kept = [], [], [], []
        for i in range(len(texts)):
            own = data[offsets[i] : offsets[i + 1]]
            a, b = at[i], at[i + 1]
            sizes.append(len(own))
            if a == b or not removed[i].is_valid:
                gone.append(0)
                runs.append(0)
                kept.append(own.tobytes())
                continue
            step = np.zeros(len(own) + 1, dtype=np.int32)
            np.add.at(step, lows[a:b], 1)
            np.add.at(step, highs[a:b], -1)
            cut = np.cumsum(step[:-1]) > 0
            gone.append(int(cut.sum()))
            runs.append(int(cut[0]) + int((cut[1:] & ~cut[:-1]).sum()))
            kept.append(own[~cut].tobytes())
        return pa.StructArray.from_arrays(
            [pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())],
            names=["n_bytes", "n_removed", "n_spans", "kept"],
        )

    return run(text, spans)


def suffix_dedup(
    df: DataFrame, size: int = SIZE, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES,
    bloom_names: int = BLOOM_NAMES, shard_segments: int = SHARD_SEGMENTS,
) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that are left)."""
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    docs = docs.withColumn("copy", F.xxhash64("text"))
    ids = docs.select("doc_id", "copy", F.octet_length("text").alias("end"), F.sha2("text", 256).alias("whole"))
    ids = staged(ids.where(F.col("end") >= size), "suffix-texts")
    first = ids.groupBy("whole").agg(F.min(F.struct("doc_id", "copy")).alias("first"), F.max(F.struct("doc_id", "copy")).alias("last"))
    first = staged(first.where(F.col("first") != F.col("last")).select("whole", "first"), "suffix-copied")
    again = ids.join(small(first), "whole").where(F.struct("doc_id", "copy") != F.col("first"))
    again = staged(again.select("doc_id", "copy", F.lit(0).alias("start"), "end").distinct(), "suffix-copies")
    gone = again.select(F.col("doc_id").alias("s_id"), F.col("copy").alias("s_copy"))
    if again.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    fresh = docs.join(gone, (F.col("doc_id") == F.col("s_id")) & (F.col("copy") == F.col("s_copy")), "left_anti")
    spans = removed_spans(fresh, size, shard_bytes, bloom_names, shard_segments).union(again)
    spans = spans.groupBy("doc_id", "copy").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("s_id"), F.col("copy").alias("s_copy"), "spans")
    out = docs.join(spans, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("copy") == F.col("s_copy")), "left")
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    out = out.select("doc_id", cut_bytes(F.col("text"), F.coalesce("spans", none)).alias("x"))
    return out.select("doc_id", "x.n_bytes", "x.n_removed", "x.n_spans", F.sha2("x.kept", 256).alias("kept_sha256"), "x.kept")
