"""Connected components by alternating large-star and small-star."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendorlake.llm.common import discard, few, stash


def _mins(both: DataFrame, rows: int) -> DataFrame:
    """Per node u the least of its neighbours and itself.  Written, so that the
    join that follows can split a node with very many neighbours."""
    return stash(few(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), rows), "mins")


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    """Every larger neighbour of a node goes to the least of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    mins = _mins(both, 2 * rows)
    out = both.where("v > u").join(mins, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    out = stash(few(out, rows), "large-star")
    discard(mins)
    return out


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    """Every smaller neighbour of a node, and the node, go to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    mins = _mins(down, rows)
    out = down.join(mins, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    out = stash(few(out.union(mins.select("u", F.col("m").alias("v")).where("u <> v")).distinct(), 2 * rows), "small-star")
    discard(mins)
    return out


def _is_forest_of_stars(edges: DataFrame, rows: int) -> bool:
    """Whether every node has one edge to a root, and roots have none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select(F.col("v"), F.lit(0), F.lit(1)))
    both = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return few(both.where("up > 1 or (up > 0 and down > 0)"), 2 * rows).isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with an edge; component: the least node.

    Every half step writes its edges, so the plan stays short and a lost
    executor costs one step.
    """
    now = stash(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    while True:
        rows = now.count()
        large = _large_star(now, rows)
        small = _small_star(large, rows)
        discard(now, large)
        now = small
        if _is_forest_of_stars(now, rows):
            break
    return (now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
