"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize


def large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is linked to the least of the node and
    its neighbours. ``edges``: u > v, each once."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    smaller = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return smaller.unionAll(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; the component is its least
    node. Null ends are ignored; loops give the node itself. Rounds go on until
    neither star changes an edge; each is written, so lineage stays short."""
    x, y = F.col(a), F.col(b)
    ends = links.select(x.alias("x"), y.alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    edges = ends.filter("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()
    edges, before = materialize(edges, "star"), None
    while True:
        old, edges = edges, materialize(small_star(large_star(edges)), "star")
        discard(old)
        stamp = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if stamp == before:
            break
        before = stamp
    nodes = ends.select(F.explode(F.array("x", "y")).alias("node")).distinct()
    return nodes.join(edges.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))
