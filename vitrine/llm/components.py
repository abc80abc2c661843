"""Connected components of a list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.shared import materialize


def _stars(links: DataFrame) -> DataFrame:
    """One round: every node's larger neighbours, then its smaller ones, move to the least one."""
    both = links.union(links.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    larger = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    # from here a > b: a node's smaller neighbours are the b of its rows
    larger = larger.filter("a != b").distinct()
    least = larger.groupBy("a").agg(F.min("b").alias("m"))
    smaller = larger.join(least, "a")
    moved = smaller.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b): the least node it is connected to.

    Large-star and small-star rounds (Kiveris and others, 2014): links only ever move to smaller
    nodes, and their number never grows. Each round is written to the shared folder; it ends when a
    round changes nothing, after few rounds even for long chains. A node with very many links is
    aggregated before the shuffle, and the joins may split it. No links give an empty result.
    """
    now = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    state = None
    while True:
        sums = now.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if (sums["n"], sums["h"]) == state or not sums["n"]:
            break
        state = (sums["n"], sums["h"])
        now = materialize(_stars(now))
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.union(roots)
