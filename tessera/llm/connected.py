"""Connected components of a table of links, by contraction to least neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of links (a, b); the root is one node of the component.

    Each round maps every node to the least neighbour of its least neighbour and contracts the links by that map,
    until none is left. Ids should be hash-like: then a constant share of the nodes goes in each round. Every step is a
    partial aggregation or a join by key; links are written to the shared folder after each round.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = staged(both.where(F.col("a") != F.col("b")).distinct(), "links")
    labels = None
    while not links.isEmpty():
        least = links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to"))
        hop = least.select(F.col("a").alias("to"), F.col("to").alias("next"))
        step = staged(least.join(hop, "to").select(F.col("a").alias("node"), F.col("next").alias("root")), "hops")
        if labels is None:
            labels = step
        else:
            new = step.select(F.col("node").alias("root"), F.col("root").alias("new"))
            labels = labels.join(new, "root", "left").select("node", F.coalesce("new", "root").alias("root"))
            labels = staged(labels, "labels")
        a, b = (step.select(F.col("node").alias(c), F.col("root").alias(f"{c}_to")) for c in "ab")
        moved = links.join(a, "a").join(b, "b").where(F.col("a_to") != F.col("b_to"))
        links = staged(moved.select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).distinct(), "links")
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
