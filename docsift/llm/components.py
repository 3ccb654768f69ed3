"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Tie every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Tie a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    rest = edges.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def contracted(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """``node, component`` from ``edges(a, b)``, ``a`` the larger, after some rounds.

    After ``rounds`` rounds, nodes with one component are connected, and most connected
    nodes have one. Without a number, rounds end when one changes nothing; then every node
    but each component's smallest hangs on that one. Each round writes its edges, so
    lineage stays short.
    """
    now, seen, n = staged(edges.select("a", "b").filter("a > b").distinct()), None, 0
    while rounds is None or n < rounds:
        now, n = staged(_small_star(_large_star(now))), n + 1
        if rounds is None:
            last, seen = seen, tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
            if seen == last or not seen[0]:
                break
    # A node with several edges left takes its smallest.
    found = now if rounds is None else now.groupBy("a").agg(F.min("b").alias("b"))
    return found.select(F.col("a").alias("node"), F.col("b").alias("component"))


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges(a, b)`` but each component's smallest.

    Loops (a = b) and repeated edges do no harm, null ends are dropped, and no edges give
    no rows.
    """
    return contracted(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b"))
