"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source's documents are shuffled by a hash of their id and repeated for up to ``EPOCHS`` passes.
A copy's virtual finish time is the source's cumulative words up to its end divided by the source's
target. All copies are ordered by finish time across the sources, and the order is cut where the
running total of words would pass the budget, the words of the whole corpus.

Nothing is ordered in one task: cumulative sums are taken per (source, hash bucket), then the
buckets' sums are accumulated; the global order is cut by finish-time ranges, of which only the
one that holds the cut is ordered row by row.

Results by case: null text has size 0; a document of size 0 and a source without words take 0;
null is a source of its own, sorted last; repeated rows are documents of their own; ties in finish
time go by source, hash, id, text hash, row and pass (rows that agree in id and text are alike, so which of them
comes first doesn't matter); an empty table gives no rows; very long texts count like others, and one that passes
what is left of the budget ends the mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, staged

EPOCHS = 3
WEIGHTS = (1, 2, 3)
#: Finish-time ranges of the global order: so many for each unit up to 2, and for each doubling after that.
RANGES = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """One row a source: source, rank, source_size, target.

    Weights repeat over the sources by code point, null last. A target stops at ``epochs`` times the source's size;
    the excess goes to the others by weight. With the sources in order of cap / weight the level at which the
    budget is used up follows from running sums.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = running(per, [F.col("source").asc_nulls_last()], one=F.lit(1)).withColumn("rank", F.col("one_before") + 1).drop("one_before")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (1 + (F.col("rank") - 1) % len(weights)).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(epochs))
    per = running(per, [(F.col("cap") / F.col("weight")).asc(), F.col("rank").asc()], cap=F.col("cap"), weight=F.col("weight"))
    whole = per.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("heavy"))
    share = (F.col("words") - F.col("cap_before")) / (F.col("heavy") - F.col("weight_before"))
    level = per.crossJoin(F.broadcast(whole)).agg(F.max(F.when(share <= F.col("cap") / F.col("weight"), share)).alias("level"))  # one row each
    return per.crossJoin(F.broadcast(level)).select(
        "source", "rank", "source_size", F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target")
    )


def running(df: DataFrame, order: list[Column], **values: Column) -> DataFrame:
    """``df`` with <name>_before: the sum of each value over the rows before, in this order.

    Rows are dealt out by ranges; sums go over a range's rows, and over the ranges, which are few.
    """
    parts = max(1, -(-df.count() // 100_000))
    held = staged(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "mix-ranges")
    sums = held.groupBy("__part").agg(*[F.sum(v).alias(f"__{n}") for n, v in values.items()])
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__part", *[F.coalesce(F.sum(f"__{n}").over(ahead), F.lit(0)).alias(f"__{n}") for n in values])
    own = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = held.join(F.broadcast(sums), "__part")
    return out.select(*df.columns, *[(F.col(f"__{n}") + F.coalesce(F.sum(v).over(own), F.lit(0))).alias(f"{n}_before") for n, v in values.items()])


def _order() -> list[Column]:
    return [F.col(c) for c in ("finish", "rank", "key", "doc_id", "same", "row", "epoch")]


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    epochs: int = EPOCHS,
    carry: tuple[str, ...] = (),
    nested: bool = False,
) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, copies, taken; ``carry`` columns follow, or one record of them, carried."""
    key = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    kept = [F.col(c) for c in carry]
    sized = staged(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            word_count(F.col(text)).alias("size"),
            key.alias("key"),
            F.substring(key, 1, 3).alias("bucket"),
            F.xxhash64(F.col(text)).alias("same"),
            F.monotonically_increasing_id().alias("row"),
            F.struct(*kept).alias("carried") if carry else F.lit(0).alias("carried"),
        ),
        "mix-sized",
    )
    slim = sized.drop("carried")
    per_source = targets(slim, weights, epochs)
    buckets = slim.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("ahead", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0))).alias("b")
    per_source = per_source.alias("s")
    buckets = buckets.join(per_source, F.col("b.source").eqNullSafe(F.col("s.source"))).select(
        F.col("b.source").alias("b_source"), F.col("b.bucket").alias("b_bucket"), "ahead", "rank", "source_size", "target"
    )
    joined = slim.join(
        buckets, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket"))
    )
    own = Window.partitionBy("rank", "bucket").orderBy("key", "doc_id", "same", "row").rowsBetween(Window.unboundedPreceding, 0)
    queued = staged(
        joined.withColumn("reached", F.col("ahead") + F.sum("size").over(own)).select(
            "doc_id", "same", "row", "key", "rank", "size", "source_size", "target", "reached"
        ),
        "mix-queued",
    )
    last = _cut(queued, epochs)
    finish = lambda e: (F.lit(e) * F.col("source_size") + F.col("reached")).cast("double") / F.col("target")
    copies = F.lit(0)
    if last is not None:
        kinds = dict(queued.dtypes) | {"finish": "double", "epoch": "int"}
        cut = F.struct(*[F.lit(last[c]).cast(kinds[c]) for c in ("finish", "rank", "key", "doc_id", "same", "row", "epoch")])
        for e in range(epochs):
            here = F.struct(finish(e), F.col("rank"), F.col("key"), F.col("doc_id"), F.col("same"), F.col("row"), F.lit(e))
            within = F.when((F.col("size") > 0) & (F.col("target") > 0), here <= cut).otherwise(F.lit(False))
            copies = copies + F.when(within, 1).otherwise(0)
    out = queued.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))
    if carry:
        out = out.join(sized.select("row", "source", "carried"), "row")
        return out.select("doc_id", "source", "size", "source_size", "target", "copies", "taken", *(["carried"] if nested else [f"carried.{c}" for c in carry]))
    names = per_source.select(F.col("rank"), F.col("source"))
    return out.join(names, "rank").select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def _cut(queued: DataFrame, epochs: int):
    """The last copy taken of the global order, as one row; None if there is none."""
    budget = queued.agg(F.sum("size")).first()[0] or 0
    copies = (
        queued.where((F.col("size") > 0) & (F.col("target") > 0))
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
        .withColumn("finish", (F.col("epoch") * F.col("source_size") + F.col("reached")).cast("double") / F.col("target"))
        .withColumn("range", F.floor(RANGES * F.when(F.col("finish") <= 2, F.col("finish")).otherwise(1 + F.log2("finish"))))
    )
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = copies.groupBy("range").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(upto))
    ranges = ranges.select("range", "words", "upto")
    full = ranges.where(F.col("upto") <= budget).agg(F.max("range"), F.max("upto")).first()
    crossing = ranges.where(F.col("upto") > budget).agg(F.min("range")).first()[0]
    if crossing is not None:
        run = Window.partitionBy("range").orderBy(*_order()).rowsBetween(Window.unboundedPreceding, 0)
        inside = copies.where(F.col("range") == crossing).withColumn("run", F.sum("size").over(run))
        found = (
            inside.where(F.col("run") + F.lit(full[1] or 0) <= budget).orderBy(*[c.desc() for c in _order()]).limit(1).collect()
        )
        if found:
            return found[0]
    if full[0] is None:
        return None
    return copies.where(F.col("range") == full[0]).orderBy(*[c.desc() for c in _order()]).first()
