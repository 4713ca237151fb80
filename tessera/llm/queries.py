"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm import language_id, oracles, toxicity
from tessera.llm.chat_formatting import format_chats, loss_text, read_turns
from tessera.llm.common import table
from tessera.llm.decontamination import decontaminate
from tessera.llm.jaccard_join import jaccard_components
from tessera.llm.mixing import mix
from tessera.llm.secret_scans import secret_scan, spans_text
from tessera.llm.substring_dedup import substring_dedup
from tessera.llm.suffix_dedup import suffix_dedup
from tessera.llm.topk_search import top_k

QUERIES = {}
ORACLES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    if sql := getattr(oracles, fn.__name__.upper(), None):
        ORACLES[fn.__name__] = sql
    return fn


@query
def op1_substring_dedup(spark, sf_dir):
    out = substring_dedup(table(spark, sf_dir, "documents"))
    pairs = F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"]))
    return out.select("doc_id", "n_removed", "n_removed_chars", F.array_join(pairs, ",").alias("spans"), "text")


@query
def op2_secret_scans(spark, sf_dir):
    found = secret_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(spans_text(F.col("base_spans")), 256).alias("base_sha256"),
        spans_text(F.col("secret_spans")).alias("spans"),
    )


@query
def op3_source_mixing(spark, sf_dir):
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op4_suffix_dedup(spark, sf_dir):
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op5_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = language_id.train(docs)
    found = docs.withColumn("found", language_id.language(F.col("text"), net))
    return found.select(
        "doc_id",
        (toxicity.fold(F.col("doc_id"), 3) == 1).alias("held_out"),
        F.col("found.lang").alias("lang_pred"),
        F.col("found.score").alias("score"),
    )


@query
def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", toxicity.toxicity(F.col("text"), model).alias("score"))
    return scored.select(
        "doc_id",
        (toxicity.fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op7_chat_formatting(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    row = lambda turn, role: spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(turn).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(hard).alias("text"))
    extra = row(0, "user").union(row(1, "assistant"))
    out = format_chats(turns.unionByName(extra)).select(
        "conv_id",
        "formatted",
        read_turns(F.col("formatted")).alias("turns"),
        loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query
def op8_jaccard_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85)


@query
def op9_topk_search(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op10_decontamination(spark, sf_dir):
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
