"""Connected components of a link table, as rounds of Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .textscan import discard, staged


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b), component being the least node reachable.

    Alternates the large-star and small-star steps of Kiveris et al. (2014): each replaces links by
    links to the least neighbour, so no step makes more links than it reads, and every path halves.
    It ends once every node has one link, to a node that has none. A hub is met only as the key of an
    aggregate (combined before the shuffle) and of a join that adaptive execution can split. Null ends
    are dropped; an empty table gives an empty result.
    """
    def norm(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")

    edges = staged(norm(links.dropna(subset=["a", "b"])).distinct())
    while True:
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("e"))
        nodes = ends.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.min("e.up").alias("end"))
        unsettled, rows = nodes.agg(F.count_if((F.col("up") > 1) | (F.col("up") > 0) & (F.col("end") == 0)), F.sum("up")).first()
        if not unsettled:
            break
        # large star: every larger neighbour of a node is linked to the node's least neighbour
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = norm(edges.join(least, edges.b == least.k).select(F.col("a"), F.col("m").alias("b")))
        # small star: a node and its smaller neighbours are all linked to the least of them
        m = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = large.join(m, large.a == m.k).select(F.col("b").alias("a"), F.col("m").alias("b")).union(m.select(F.col("k").alias("a"), F.col("m").alias("b")))
        before, edges = edges, staged(norm(small).distinct(), 2 * rows)
        discard(before)
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
