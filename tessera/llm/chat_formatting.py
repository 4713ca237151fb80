"""Chat formatting: turns of a conversation to one training string and back, in Spark expressions only.

A run of adjacent turns with one role becomes one block, each turn of it closed on its own:

    ### role
    text</turn>text</turn>

In texts a backslash, ``</`` and ``##`` are escaped, so neither a closing mark nor a header can
occur inside a text, and unescaping restores every text exactly.

Results by case: null text is empty; a null role is an empty role; turns sort by turn (nulls
first), then role and text, so ties and repeated rows have one order; a null conversation id is a
conversation of its own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import in_chunks

HEADER = "### "
CLOSE = "</turn>"
#: Ends a block; it can't occur in a text either, for it holds "</".
BLOCK_END = "</end>\n"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    for plain, marked in (("\\", "\\\\"), ("</", "<\\/"), ("##", "#\\#")):
        text = F.replace(text, F.lit(plain), F.lit(marked))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\/#])", "$1")


def escape_role(role: Column) -> Column:
    for plain, marked in (("%", "%25"), ("\n", "%0A"), ("#", "%23"), ("<", "%3C")):
        role = F.replace(role, F.lit(plain), F.lit(marked))
    return role


def unescape_role(role: Column) -> Column:
    for plain, marked in (("<", "%3C"), ("#", "%23"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(marked), F.lit(plain))
    return role


def _merged(turns: Column) -> Column:
    """Adjacent turns of one role merged: array<struct<head, text, loss>>, where head closes the block before and opens a new one."""
    none = F.expr("cast(array() as array<struct<head:string,text:string,loss:boolean>>)")

    def step(acc: Column, t: Column) -> Column:
        before = acc["at"]
        opens = before["none"] | (before["role"] != t["role"])
        header = F.concat(F.when(before["none"], "").otherwise(BLOCK_END), F.lit(HEADER), escape_role(t["role"]), F.lit("\n"))
        piece = F.struct(F.when(opens, header).otherwise("").alias("head"), escape(t["text"]).alias("text"), (t["role"] == LOSS_ROLE).alias("loss"))
        at = F.struct(F.lit(False).alias("none"), t["role"].alias("role"))
        return F.struct(at.alias("at"), F.concat(acc["out"], F.array(piece)).alias("out"))

    return in_chunks(turns, F.struct(F.lit(True).alias("none"), F.lit("").alias("role")), none, step)


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: ``conv``, ``formatted`` and ``loss_mask``.

    loss_mask: array<struct<start, length>> of code points of ``formatted`` (from 0) that belong to texts of the loss role.
    """
    rows = df.select(
        F.col(conv).alias(conv),
        F.struct(
            F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")
        ).alias("t"),
    )
    grouped = rows.groupBy(conv).agg(F.array_sort(F.collect_list("t"), _order).alias("turns"))
    own = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    merged = grouped.select(conv, _merged(own).alias("pieces"))
    body = F.transform("pieces", lambda x: F.concat(x["head"], x["text"], F.lit(CLOSE)))
    return merged.select(conv, F.concat(F.array_join(body, ""), F.lit(BLOCK_END)).alias("formatted"), _mask(F.col("pieces")).alias("loss_mask"))


def _order(a: Column, b: Column) -> Column:
    """Turn with nulls first, then role, then text."""
    first = (
        F.when(a["turn"].isNull() & b["turn"].isNull(), 0)
        .when(a["turn"].isNull(), -1)
        .when(b["turn"].isNull(), 1)
        .when(a["turn"] < b["turn"], -1)
        .when(a["turn"] > b["turn"], 1)
        .otherwise(0)
    )
    rest = (
        F.when(a["role"] < b["role"], -1)
        .when(a["role"] > b["role"], 1)
        .when(a["text"] < b["text"], -1)
        .when(a["text"] > b["text"], 1)
        .otherwise(0)
    )
    return F.when(first != 0, first).otherwise(rest)


def _mask(pieces: Column) -> Column:
    none = F.expr("cast(array() as array<struct<start:int,length:int>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["head"])
        span = F.when(x["loss"], F.array(F.struct(start.alias("start"), F.length(x["text"]).alias("length")))).otherwise(none)
        return F.struct((start + F.length(x["text"]) + len(CLOSE)).alias("at"), F.concat(acc["out"], span).alias("out"))

    return in_chunks(pieces, F.lit(0), none, step)


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string: array<struct<role, text>>."""
    blocks = F.filter(F.split(formatted, BLOCK_END, -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = unescape_role(F.regexp_extract(block, r"^### ([^\n]*)\n", 1))
        body = F.regexp_replace(block, r"^### [^\n]*\n", "")
        texts = F.split(body, CLOSE, -1)
        return F.transform(
            F.slice(texts, F.lit(1), F.size(texts) - 1), lambda x: F.struct(role.alias("role"), unescape(x).alias("text"))
        )

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, mask: Column) -> Column:
    """What the loss mask covers, unescaped: the texts one after the other."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(formatted, m["start"] + 1, m["length"]))), "")
