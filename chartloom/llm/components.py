"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm.base import cut, join_hot


def _star(edges: DataFrame, small: bool, n: int) -> DataFrame:
    """One step: every node's neighbours of the step's kind are linked with the least of them and itself.

    ``n`` is the number of ``edges``.  The least neighbour is a pre-aggregated
    minimum; it is joined back by broadcast where a node is a hub, so no node's
    neighbours are ever gathered in one task.
    """
    both = edges if small else edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    joined = join_hot(both, least, "u", "n", n if small else 2 * n)
    if small:
        moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    else:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges`` (u, v) of any order, loops allowed -> (node, root) for every node that has an edge; root is the least node.

    Should the components not have settled after ``most_rounds``, an error is
    raised rather than a part of them returned; each round halves long paths.
    """
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before, n = None, edges.count()
    for _ in range(most_rounds):
        large = cut(_star(edges, False, n))
        edges = cut(_star(large, True, large.count()))
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before, n = now, now[0]
    else:
        raise RuntimeError("the components have not settled")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
