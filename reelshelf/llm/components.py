"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelshelf.llm.runtime import Landing


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node), for nodes that have a link. links: a, b (integers).

    Each round hangs a node's neighbours on the least one; a node with very many neighbours costs one
    combined minimum and a join that Spark can split, never a list. Rounds grow with the logarithm of a
    component's width; links are written between rounds, so a lost executor costs a round at most. Only the last round's stay.
    """
    edges = links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    land = Landing(links.sparkSession)
    edges = land(edges, "links")
    while True:
        # large star: larger neighbours of a node hang on its least neighbour
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = edges.select(F.col("u").alias("big"), F.col("v").alias("u")).join(least, "u").select(F.col("big").alias("u"), F.col("m").alias("v"))
        # small star: smaller neighbours of a node, and the node, hang on the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        after = land(small.filter("u != v").distinct(), "links")
        # done when every node hangs on a root: then no node is both
        open_nodes = after.select("u").join(after.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count()
        many = after.groupBy("u").count().filter("count > 1").limit(1).count()
        land.drop(edges)
        edges = after
        if not open_nodes and not many:
            break
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
