"""Benchmark decontamination: pigeonhole edit matching with exact piece hits and Myers' bit-parallel distance.

Texts and items are normalised alike: lower case, each run of anything but letters and digits one blank. An item of L
characters may differ by e = floor(L * rate) edits from a stretch of a document. Cut into e + 1 pieces, at least one
piece occurs there unchanged; an Aho-Corasick automaton finds all pieces, and each hit's window is verified once. An item too
short for an edit (e = 0) matches where it stands exactly, between word boundaries.

Items come to the driver and go to the tasks in blocks of bounded size, one after the other: with several, each block's
result is written before the next block is fetched.

Results by case: null, empty or wordless texts match nothing; an item without words matches nothing, one of a single word
matches every document with that word; repeated documents and repeated items are matched each on their own; an empty table on
either side gives no rows; very long texts are scanned whole; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import staged

RATE = 0.06
#: Items are shipped to the tasks in blocks of at most so many characters (or one item); each block is one scan of the documents.
BLOCK_CHARS = 8_000_000

_JUNK = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    return _JUNK.sub(" ", (text or "").lower()).strip()


def pieces(length: int, errors: int) -> list[tuple[int, int]]:
    """errors + 1 pieces of near equal length, as (start, end)."""
    n = errors + 1
    return [(length * i // n, length * (i + 1) // n) for i in range(n)]


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | (1 << i)
    return out


def myers(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any substring of text, and the first end (exclusive) where it is met."""
    pv, mv, score, full, top = (1 << m) - 1, 0, m, (1 << m) - 1, 1 << (m - 1)
    best, at = m, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1, mh << 1
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv & full
        if score < best:
            best, at = score, j
    return best, at


class Matcher:
    """All items of a block, ready to scan normalised texts."""

    def __init__(self, items: Iterable[tuple[int, str | None]], rate: float = RATE):
        self.items, found = [], {}
        for item_id, text in items:
            t = normalise(text)
            if not t:
                continue
            errors = int(len(t) * rate)
            for start, end in pieces(len(t), errors):
                found.setdefault(t[start:end], []).append((len(self.items), start))
            self.items.append((item_id, t, errors, masks(t) if errors else None))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()

    def scan(self, raw: str | None) -> list[tuple[int, int, int]]:
        """(item_id, distance, end in the normalised text) of each item found, at its best place."""
        text, best, tried = normalise(raw), {}, {}
        if not self.items:
            return []
        for last, (size, places) in self.automaton.iter(text):
            for k, offset in places:
                item_id, item, errors, peq = self.items[k]
                start = last + 1 - size - offset
                if best.get(k, (1,))[0] == 0 or start in tried.setdefault(k, set()):
                    continue
                tried[k].add(start)
                if not errors:
                    stop = start + len(item)
                    if text[start - 1 : start] in ("", " ") and text[stop : stop + 1] in ("", " "):
                        best[k] = (0, stop)
                    continue
                if text.startswith(item, max(start, 0)) and start >= 0:
                    best[k] = (0, start + len(item))
                    continue
                low = max(0, start - errors)
                distance, end = myers(peq, len(item), text[low : start + len(item) + errors])
                if distance <= errors and (distance, low + end) < best.get(k, (errors + 1, 0)):
                    best[k] = (distance, low + end)
        return [(self.items[k][0], *found) for k, found in sorted(best.items())]


KIND = "array<struct<item_id:bigint,distance:int,end:int>>"
_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("end", pa.int32())]))


def blocks(bench: DataFrame, item_id: str = "item_id", text: str = "text", limit: int = BLOCK_CHARS) -> Iterator[list[tuple]]:
    """The items in blocks of bounded size, in a stream from the executors; the driver holds a block and a partition at a time."""
    own, held = [], 0
    for r in bench.select(F.col(item_id).cast("long").alias("i"), F.col(text).cast("string").alias("t")).toLocalIterator():
        if own and held + len(r.t or "") > limit:
            yield own
            own, held = [], 0
        own.append((r.i, r.t))
        held += len(r.t or "")
    yield own


def matches(text: Column, items: list[tuple], rate: float = RATE) -> Column:
    """array<struct<item_id, distance, end>>: the items of one block that occur in the text."""
    held: list[Matcher] = []

    @F.arrow_udf(KIND)
    def scan(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(Matcher(items, rate))
        rows = [
            [{"item_id": i, "distance": d, "end": e} for i, d, e in held[0].scan(t.as_py())] for t in texts
        ]
        return pa.array(rows, _ARROW)

    return scan(text)


def decontaminate(docs: DataFrame, bench: DataFrame, rate: float = RATE, limit: int = BLOCK_CHARS) -> DataFrame:
    """One row a document and item that occurs in it: doc_id, item_id, distance, end (in the normalised text)."""

    def scanned(items: list[tuple]) -> DataFrame:
        found = docs.select("doc_id", F.explode(matches(F.col("text"), items, rate)).alias("m"))
        return found.select("doc_id", "m.item_id", "m.distance", "m.end")

    parts = blocks(bench, limit=limit)
    first = next(parts)
    second = next(parts, None)
    if second is None:
        return scanned(first)
    out = [staged(scanned(first), "decontamination"), staged(scanned(second), "decontamination")]
    out += [staged(scanned(items), "decontamination") for items in parts]
    return reduce(DataFrame.union, out)


def clean_documents(docs: DataFrame, bench: DataFrame, rate: float = RATE, limit: int = BLOCK_CHARS) -> DataFrame:
    """The documents in which no item occurs, all columns kept."""
    parts = blocks(bench, limit=limit)
    items = next(parts)
    while True:
        docs = docs.where(F.size(matches(F.col("text"), items, rate)) == 0)
        items = next(parts, None)
        if items is None:
            return docs
        docs = staged(docs, "decontamination")
