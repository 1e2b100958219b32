"""Connected components of a link table, by rounds of large-star and small-star with a cut after each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Number of links and the sum of their hashes: equal for equal sets, whatever their order."""
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``links`` (a, b). Self links are allowed.

    Every star round is an aggregate and a join on nodes; the number of rounds is logarithmic in the number of nodes. A
    node's smallest neighbour is one value however many neighbours it has, so no list of neighbours is built. A round that leaves
    the links as they were is the last; one aggregate over the written links tells.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    seen = _mark(edges)
    while seen[0]:
        # large star: larger neighbours of u move to the smallest of u and its neighbours
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).where("u <> v").distinct()
        edges = cut(small, "stars")
        last, seen = seen, _mark(edges)
        if seen == last:
            break
    roots = edges.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(roots, nodes["node"] == roots["u"], "left").select("node", F.coalesce("component", "node").alias("component"))
