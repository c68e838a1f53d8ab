"""Connected components of links, by alternating stars: each round is two joins, whatever the sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _to_least(links: DataFrame, both_ways: bool) -> DataFrame:
    """Every node's neighbours are handed to the least of them. Rows: (a, b) with a > b."""
    near = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both_ways else links
    least = near.groupBy("a").agg(F.min("b").alias("least"))
    joined = near.join(least, "a")
    if both_ways:  # larger neighbours move to the least of all, the node itself included
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("a", "least").alias("b"))
        return moved.dropDuplicates()
    # smaller neighbours, and the node, move to the least
    moved = joined.where(F.col("b") != F.col("least")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select("a", F.col("least").alias("b"))).dropDuplicates()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node in ``links(a, b)``; a component is named by its least node.

    Self links and repeated links are allowed. Nothing is collected but two sums a round.
    """
    ordered = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).dropDuplicates()
    state = cut(ordered)

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = mark(state)
    if seen[0]:
        for _ in range(rounds):
            state = cut(_to_least(_to_least(state, True), False))
            now = mark(state)
            if now == seen:
                break
            seen = now
        else:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = state.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots).dropDuplicates()
