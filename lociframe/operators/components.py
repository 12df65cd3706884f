"""Connected components of a distributed graph by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, matched, stored

#: edges that one task can join
FEW = 1_000_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edge table (a, b): root is the smallest node reachable. No node's edges meet in one task.

    Each round hangs every neighbour of a node on the smallest one (larger neighbours first, then smaller ones), so edges
    never outgrow the input and the number of rounds is logarithmic. Every round is written to the shared folder.
    """
    now = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    seen, n = None, now.count()
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        # large star: neighbours above a node go to its smallest neighbour
        large = _met(both.where("b > a"), low, n).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a != b").distinct(), "cc")
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        # small star: neighbours below a node, and itself, go to the smallest of them
        small = _met(large, low, n).select(F.col("b").alias("x"), "m")
        small = small.where("x != m").unionByName(low.select(F.col("a").alias("x"), "m")).distinct()
        new = stored(small.select(F.col("x").alias("a"), F.col("m").alias("b")), "cc")
        dropped(now)
        dropped(large)
        now = new
        sign = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if seen == (sign.n, sign.h):
            break
        seen, n = (sign.n, sign.h), sign.n
    # a star forest: every edge joins a node and its root
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _met(edges: DataFrame, low: DataFrame, n: int) -> DataFrame:
    """edges with the smallest neighbour m of their a; from FEW edges on, none of a node that has many meet in one task."""
    return edges.join(low.drop("n"), "a") if n <= FEW else matched(edges, stored(low, "cc-low"), ["a"], "n")
