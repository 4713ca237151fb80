"""Secret scans: base patterns plus sliding-window entropy, in Spark expressions only.

Results by case: a null or empty text has no span; several rows with one id are scanned
row by row; very long texts are scanned whole; an empty table gives an empty table; only
the named columns are read, so other columns and their names don't matter.

Positions come from cutting a text at a pattern's matches: a match starts where the pieces
and matches before it end. Offsets count code points, the end is exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import in_chunks

#: In this order where two spans start together.
KINDS = ("assign", "access", "hex", "entropy")

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE_MIN = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

#: Candidate strings for the entropy scan and the alphabet whose counts are kept.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
WINDOW = 20
#: Bits a character over the best window, by character class: hex digits, letters of both cases, letters with digits.
#: Candidates of other classes (digits alone, letters of one case) are no secrets.
THRESHOLDS = {"hex": 2.9, "letters": 3.9, "mixed": 3.6}
#: Candidates that match one of these are no secrets.
ALLOW_LIST = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}",
    r"(?i)(example|sample|placeholder|dummy|changeme|redacted|x{6,})",
    r"(?i)(abcdefgh|01234567|12345678)",
    r"^([A-Za-z]{2,}[-_/+])+[A-Za-z0-9]*$",
)


def _located(text: Column, pattern: str, kind: str, keep_group: tuple[int, int] | None = None) -> Column:
    """array<struct<start, end, rank, kind, text>> of the pattern's matches, leftmost and non-overlapping.

    keep_group: (group, least length); matches whose group is shorter are dropped after matching.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(pattern), F.lit(keep_group[0] if keep_group else 0))
    pieces = F.arrays_zip(
        F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)).alias("gap"), whole.alias("hit"), group.alias("value")
    )
    rank = KINDS.index(kind)
    none = F.expr("cast(array() as array<struct<start:int,end:int,rank:int,kind:string,text:string>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(
            start.alias("start"), end.alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["hit"].alias("text")
        )
        add = F.array(span)
        if keep_group:
            add = F.when(F.length(x["value"]) >= keep_group[1], add).otherwise(none)
        return F.struct(end.alias("at"), F.concat(acc["out"], add).alias("out"))

    found = in_chunks(pieces, F.lit(0), none, step)
    return F.when(text.rlike(pattern), found).otherwise(none)


def window_entropy(value: Column, window: int = WINDOW) -> Column:
    """Highest Shannon entropy (bits a character) of the string's windows of ``window`` characters.

    One pass keeps the counts of the characters in the window and the sum of c*log2(c); each step adds the character that
    enters and takes out the one that leaves. Both come from the string cut into characters once, so the pass is linear.
    """
    cost = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    chars = F.slice(F.split(value, ""), F.lit(1), F.length(value))
    codes = F.transform(chars, lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    steps = F.transform(
        F.array(codes),
        lambda own: F.arrays_zip(own.alias("enters"), F.concat(F.array_repeat(F.lit(-1), window), own).alias("leaves")),
    )[0]
    zero = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"), F.lit(0).alias("n")
    )

    def step(acc: Column, x: Column) -> Column:
        enters, leaves = x["enters"], x["leaves"]
        c_in = F.get(acc["counts"], enters)
        c_out = F.when(leaves >= 0, F.get(acc["counts"], leaves)).otherwise(F.lit(0))
        change = (
            F.when(enters == leaves, F.lit(0.0))
            .when(leaves >= 0, F.get(cost, c_in + 1) - F.get(cost, c_in) + F.get(cost, c_out - 1) - F.get(cost, c_out))
            .otherwise(F.get(cost, c_in + 1) - F.get(cost, c_in))
        )
        counts = F.transform(
            acc["counts"], lambda c, k: c + F.when(k == enters, 1).otherwise(0) - F.when(k == leaves, 1).otherwise(0)
        )
        total, n = acc["total"] + change, acc["n"] + 1
        bits = F.when(n >= window, F.lit(math.log2(window)) - total / window).otherwise(F.lit(0.0))
        return F.struct(counts.alias("counts"), total.alias("total"), F.greatest(acc["best"], bits).alias("best"), n.alias("n"))

    return F.aggregate(F.filter(steps, lambda x: x["enters"].isNotNull()), zero, step, lambda acc: acc["best"])


def _is_secret(value: Column, allow_list: tuple[str, ...], thresholds: dict[str, float]) -> Column:
    allowed = F.lit(False)
    for pattern in allow_list:
        allowed = allowed | value.rlike(pattern)
    digits, upper, lower = value.rlike("[0-9]"), value.rlike("[A-Z]"), value.rlike("[a-z]")
    least = (
        F.when(value.rlike("^([0-9a-f]+|[0-9A-F]+)$") & digits & (upper | lower), thresholds["hex"])
        .when(digits & (upper | lower), thresholds["mixed"])
        .when(upper & lower, thresholds["letters"])
    )
    return F.when(least.isNotNull() & ~allowed, window_entropy(value) >= least).otherwise(F.lit(False))


def base_spans(text: Column) -> Column:
    """Spans of the base patterns, by start, then kind."""
    text = F.coalesce(text, F.lit(""))
    return F.array_sort(
        F.concat(
            _located(text, ASSIGN, "assign", (2, ASSIGN_VALUE_MIN)), _located(text, ACCESS, "access"), _located(text, HEX, "hex")
        )
    )


def entropy_spans(text: Column, base: Column, allow_list=ALLOW_LIST, thresholds=THRESHOLDS) -> Column:
    """Candidate strings of high entropy that no base span covers wholly."""
    text = F.coalesce(text, F.lit(""))
    return F.filter(
        _located(text, CANDIDATE, "entropy"),
        lambda x: ~F.exists(base, lambda b: (b["start"] <= x["start"]) & (x["end"] <= b["end"]))
        & _is_secret(x["text"], allow_list, thresholds),
    )


def secret_scan(df: DataFrame, text: str = "text", allow_list=ALLOW_LIST, thresholds=THRESHOLDS) -> DataFrame:
    """``df`` with ``base_spans`` and ``secret_spans`` (array<struct<start, end, rank, kind, text>>) put in place of any such columns."""
    found = df.withColumn("base_spans", base_spans(F.col(text)))
    extra = entropy_spans(F.col(text), F.col("base_spans"), allow_list, thresholds)
    return found.withColumn("secret_spans", F.array_sort(F.concat(F.col("base_spans"), extra)))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mark: str = "<SECRET>") -> Column:
    """The text with each span, or run of overlapping spans, replaced by ``mark``; null stays null.

    The text is cut into characters once; the pieces between spans are slices of that, joined at the end.
    """
    none = F.expr("cast(array() as array<struct<low:int,high:int>>)")

    def step(acc: Column, s: Column) -> Column:
        gap = F.array(F.struct(acc["at"].alias("low"), s["start"].alias("high")))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap)).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    end = F.struct(last.alias("low"), F.length(text).alias("high"))
    gaps = F.concat(in_chunks(spans, F.lit(0), none, step), F.array(end))
    cut = F.transform(
        F.array(F.struct(F.split(text, "").alias("chars"), gaps.alias("gaps"))),
        lambda x: F.array_join(
            F.transform(x["gaps"], lambda g: F.array_join(F.slice(x["chars"], g["low"] + 1, g["high"] - g["low"]), "")), mark
        ),
    )[0]
    return F.when(F.size(spans) > 0, cut).otherwise(text)
