"""Substring dedup: line and sentence hashing with one global table of digests.

A text is cut at line feeds, and each line after a full stop, exclamation or question mark that blanks follow (a line often holds a
whole paragraph, and repeated passages start and end within it). Lines and sentences are normalised (A-Z in lower case, runs of
blanks, tabs and carriage returns to one blank, both ends stripped) and digested apart; units with fewer than ``MIN_UNIT``
characters after that are not compared. Of each digest the earliest occurrence, by document id, then position, is kept. Later
occurrences, a line with its line feed and a sentence with its blanks, make up runs; a run of ``MIN_WORDS`` words or more is
removed, and its code point offsets in the original text are kept. Shorter runs, such as single stock lines, stay.

Units are made once, and written with their digests. Digests are grouped with partial sums, so a line that a third of the documents
share is one row a task; units that occur once are not joined again.

Results by case: null text has no lines and stays null; empty lines stay; null ids rank first; rows that repeat an id and a text
are one occurrence (all of them keep or lose a line alike); an empty table gives no rows; very long texts are cut whole; only the
named columns are read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import staged

MIN_UNIT, MIN_WORDS = 20, 15
_STOPS = re.compile(rb"[.!?][ \t\r]+")
_BLANKS = re.compile(rb"[ \t\r]+")
_UNEVEN = re.compile(rb"[\t\r]|  ")
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _places(data: bytes) -> np.ndarray | None:
    """The code point that each byte belongs to; None where bytes are code points."""
    if data.isascii():
        return None
    return np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])


def _units_of(data: bytes, min_unit: int):
    """(start, end, digest) in bytes of each unit long enough to be compared."""
    plain, low = data.isascii(), data.lower()
    uneven = _UNEVEN.search(data) is not None

    def clean(start: int, end: int) -> bytes | None:
        own = low[start:end]
        if uneven:
            own = _BLANKS.sub(b" ", own)
        own = own.strip(b" ")
        return own if (len(own) if plain else len(own.decode())) >= min_unit else None

    at = 0
    while at <= len(data):
        stop = data.find(b"\n", at)
        last = stop < 0
        stop = len(data) if last else stop
        if stop - at >= min_unit:
            if (own := clean(at, stop)) is not None:
                yield at, stop + (not last), hashlib.blake2b(own, digest_size=16, person=b"line").digest()
            cut = at
            for m in _STOPS.finditer(data, at, stop):
                if m.end() - cut >= min_unit and (own := clean(cut, m.end())) is not None:
                    yield cut, m.end(), hashlib.blake2b(own, digest_size=16, person=b"sentence").digest()
                cut = m.end()
            if stop - cut >= min_unit and (own := clean(cut, stop)) is not None:
                yield cut, stop, hashlib.blake2b(own, digest_size=16, person=b"sentence").digest()
        at = stop + 1


def _units(min_unit: int):
    """doc_id, copy, text -> doc_id, copy, start, end, d1, d2 of the units; a line's end includes the line feed."""

    def run(batches):
        for batch in batches:
            rows, starts, ends, digests = [], [], [], []
            for i, text in enumerate(batch.column(2)):
                data = (text.as_py() or "").encode()
                own = list(_units_of(data, min_unit))
                if not own:
                    continue
                lows, highs, found = zip(*own)
                places = _places(data)
                rows.append(np.full(len(own), i))
                starts.append(np.array(lows) if places is None else places[list(lows)])
                ends.append(np.array(highs) if places is None else places[list(highs)])
                digests += found
            if not rows:
                continue
            at = pa.array(np.concatenate(rows))
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at)]
                + [pa.array(np.concatenate(x).astype(np.int32)) for x in (starts, ends)]
                + [pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1]))],
                names=["doc_id", "copy", "start", "end", "d1", "d2"],
            )

    return run


def cut_out(text: Column, spans: Column, min_words: int = 0) -> Column:
    """struct<text, spans>: the text without the spans' maximal runs of ``min_words`` or more, and these runs."""

    @F.arrow_udf("struct<text:string,spans:array<struct<start:int,end:int>>>")
    def run(texts: pa.Array, removed: pa.Array) -> pa.Array:
        out, runs = [], []
        for text, own in zip(texts.to_pylist(), removed.to_pylist()):
            merged = []
            for s in sorted((s["start"], s["end"]) for s in own or ()):
                if merged and s[0] <= merged[-1]["end"]:
                    merged[-1]["end"] = max(merged[-1]["end"], s[1])
                else:
                    merged.append({"start": s[0], "end": s[1]})
            if merged and text is not None:
                merged = [m for m in merged if len(_WORDS.findall(text[m["start"] : m["end"]])) >= min_words]
                kept, at = [], 0
                for s in merged:
                    kept.append(text[at : s["start"]])
                    at = s["end"]
                text = "".join([*kept, text[at:]])
            out.append(text)
            runs.append(merged)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(runs, kind)], names=["text", "spans"])

    return run(text, spans)


def substring_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_unit: int = MIN_UNIT, min_words: int = MIN_WORDS) -> DataFrame:
    """One row a document: doc_id, text (deduplicated), n_removed (runs), n_removed_chars, spans (array<struct<start, end>>)."""
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    docs = docs.withColumn("copy", F.xxhash64("text"))
    kinds = "doc_id long, copy long, start int, end int, d1 long, d2 long"
    units = staged(docs.select("doc_id", "copy", "text").mapInArrow(_units(min_unit), kinds), "substring-units")
    where = F.struct("doc_id", "copy", "start")
    repeated = units.groupBy("d1", "d2").agg(F.min(where).alias("first"), F.max(where).alias("last"))
    repeated = repeated.where(F.col("first") != F.col("last")).select("d1", "d2", "first")
    later = units.join(repeated, ["d1", "d2"]).where(where != F.col("first"))
    # rows that repeat an id and a text give equal spans
    spans = later.groupBy("doc_id", "copy").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("s_id"), F.col("copy").alias("s_copy"), "spans")
    out = docs.join(spans, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("copy") == F.col("s_copy")), "left")
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    out = out.select("doc_id", cut_out(F.col("text"), F.coalesce("spans", none), min_words).alias("x")).select("doc_id", "x.text", "x.spans")
    chars = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "text", F.size("spans").cast("long").alias("n_removed"), chars.alias("n_removed_chars"), "spans")
