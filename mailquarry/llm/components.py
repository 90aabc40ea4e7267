"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailquarry.sinks.facts import staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Links the larger neighbours of each node to the smallest one (or to the node itself)."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = staged(both.groupBy("a").agg(F.min("b").alias("least")), "llm-star")
    found = both.where("b > a").join(least, "a")
    return found.select(F.col("b").alias("a"), F.least("a", "least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = staged(down.groupBy("a").agg(F.min("b").alias("least")), "llm-star")
    found = down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b")
    return found.unionAll(least.select("a", F.col("least").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b); root is the smallest node that it reaches.

    The links of a node are never gathered: each step is a minimum by node (reduced before the
    shuffle) and a join with it. The steps end when the links stay the same, after a number of rounds
    that grows with the logarithm of the longest path. Every round is a written table. Links of a
    node to itself and repeated links change nothing.
    """
    def same(rows: DataFrame) -> tuple:
        return tuple(rows.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    rows = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "llm-links")
    before, now = None, same(rows)
    while now != before:
        starred = staged(_large_star(rows).distinct(), "llm-links")
        rows = staged(_small_star(starred).distinct(), "llm-links")
        before, now = now, same(rows)
    return rows.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        rows.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
