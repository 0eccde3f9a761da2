"""Connected components of a graph given as links, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meetspark.llm.common import materialise


def components(links: DataFrame) -> DataFrame:
    """Of links (a, b): node and root, the smallest node that it reaches; nodes without links are not listed.

    Large-star links each node's larger neighbours to its smallest neighbour, small-star its smaller ones; both keep what is
    connected and shorten the ways, until no root is linked to a smaller node. Links are aggregated before they are shuffled.
    """
    known = materialise(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    while True:
        single = known.groupBy("a").agg(F.count(F.lit(1)).alias("k")).where("k > 1").limit(1)
        if known.join(known.select(F.col("b").alias("a")), "a", "left_semi").limit(1).select(F.lit(1).alias("x")).unionAll(single.select(F.lit(1).alias("x"))).isEmpty():
            break
        both = known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written before it is joined, so that Spark can split a node with many neighbours.
        least = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where(F.col("a") != F.col("b")).distinct()
        large = materialise(large, "large")
        least = materialise(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        known = materialise(small.where(F.col("a") != F.col("b")).distinct(), "stars")
    return known.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(known.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, root) after more links (a, b): only the components that the links join are gone over."""
    of = lambda x, y: roots.select(F.col("node").alias(x), F.col("root").alias(y))
    joined = links.select("a", "b").join(of("a", "p"), "a", "left").join(of("b", "q"), "b", "left")
    joined = joined.select(F.coalesce("p", "a").alias("a"), F.coalesce("q", "b").alias("b"))
    new = materialise(components(joined), "roots")
    known = roots.unionByName(new.select("node", F.col("node").alias("root"))).distinct()
    known = known.groupBy("node").agg(F.min("root").alias("root"))  # a root that was no node before is listed once
    return known.join(new.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
