"""Connected components of links between texts, by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written

#: The number of rounds is logarithmic in the longest chain; this many reach any graph that fits on disk.
MOST_ROUNDS = 60


def _settled(edges: DataFrame) -> bool:
    """Whether the links are stars around roots: every node has one link, and no node with a link is another's root."""
    sizes = edges.agg(F.count("*").alias("n"), F.count_distinct("a").alias("nodes")).first()
    return sizes.n == sizes.nodes and edges.select("a").join(edges.select(F.col("b").alias("a")), "a", "left_semi").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """Root of every linked node: node, root (the least node of its component).  ``links`` has columns a and b.

    Each round is two joins of the links with the least neighbour of each node.  Least neighbours are
    pre-aggregated before their shuffle and stored, so a node with very many links is split by the join.  Nothing is
    collected but two counts.
    """
    edges = written(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    for _ in range(MOST_ROUNDS):
        if _settled(edges):
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "least")
        large = written(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
    else:
        raise RuntimeError("components did not settle")
    roots = edges.groupBy("a").agg(F.min("b").alias("root"))
    return roots.select(F.col("a").alias("node"), "root").unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
