"""Connected components of a distributed edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askahead.llm.common import stored


def _stars(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step over links (a, b) with a > b."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = (
        both.join(lowest, "a")
        .where((F.col("b") > F.col("a")) & (F.col("b") != F.col("m")))
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .distinct()
    )
    lowest = large.groupBy("a").agg(F.min("b").alias("m"))
    pair = F.explode(F.array(F.struct(F.col("a").alias("x"), "m"), F.struct(F.col("b").alias("x"), "m"))).alias("p")
    return (
        large.join(lowest, "a")
        .select(pair)
        .select(F.col("p.x").alias("a"), F.col("p.m").alias("b"))
        .where(F.col("a") != F.col("b"))
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge to another, root being the smallest node it reaches.

    ``edges`` has columns a and b of any type with an order, in any direction; loops and repeats are allowed. Each round is stored, and
    the rounds end when the set of links no longer changes, which takes a logarithmic number of them also on chains.
    An empty table gives an empty one.
    """
    links = stored(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    state = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == state:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                links.select("b", "b").distinct()
            )
        state = now
        links = stored(_stars(links), "links")
