"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nomenlink.llm.scratch import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``node`` and ``root`` (least node it is connected with) of linked nodes that are no root.

    ``links`` has long columns ``a`` and ``b``. In each round every node hooks
    to its least smaller neighbour, chains are shortened by pointer jumping,
    and the links are carried over to the roots. Rounds grow with the
    logarithm of the longest path; all state lives in written tables, and
    minima are partial sums, so that a node of many links is no burden.
    """
    ends = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    edges = scratch.keep(links.select(*ends).where("a < b").distinct(), f"{name}-edges-0")
    rounds = []
    while not edges.isEmpty():
        at = f"{name}-{len(rounds)}"
        parents = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
        parents = _flat(scratch.keep(parents, f"{at}-parents"), scratch, at)
        up = parents.select(F.col("node").alias("a"), F.col("root").alias("up_a"))
        down = parents.select(F.col("node").alias("b"), F.col("root").alias("up_b"))
        moved = edges.join(up, "a", "left").join(down, "b")
        moved = moved.select(F.coalesce("up_a", "a").alias("a"), F.col("up_b").alias("b")).select(*ends)
        rounds.append(parents)
        edges = scratch.keep(moved.where("a < b").distinct(), f"{name}-edges-{len(rounds)}")
    if not rounds:
        return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    total = rounds[0]
    for count, later in enumerate(rounds[1:]):
        higher = later.select(F.col("node").alias("root"), F.col("root").alias("top"))
        moved = total.join(higher, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        total = scratch.keep(moved.unionByName(later), f"{name}-total-{count}")
    return total


def _flat(parents: DataFrame, scratch: Scratch, at: str) -> DataFrame:
    """Point every node at the end of its chain."""
    step = 0
    while True:
        higher = parents.select(F.col("node").alias("root"), F.col("root").alias("top"))
        if parents.join(higher, "root", "left_semi").isEmpty():
            return parents
        moved = parents.join(higher, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        parents = scratch.keep(moved, f"{at}-jump-{step}")
        step += 1
