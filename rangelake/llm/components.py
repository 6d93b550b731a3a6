"""Connected components of a graph of any size, as DataFrame operations.

Alternating large-star and small-star steps: every node learns the smallest node near it, until
the edges are stars around the smallest node of each component, which is looked at after each round.  Nothing is
collected but counts;
each round is written to the shared folder, so lineage stays short and lost executors cost little.
A hub's edges are dealt over many tasks.  Nodes are of any orderable type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, join_skewed, save


def _star(edges: DataFrame, small: bool, total: int) -> DataFrame:
    """One step on about ``total`` edges (a > b).  Minima are combined before the shuffle; a hub's edges are split."""
    both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree"))
    least = least if small else least.select("a", F.least("a", "m").alias("m"), "degree")
    met = join_skewed(both, least, ["a"], "degree", total if small else 2 * total)
    if small:  # each smaller neighbour, and the node itself, go to the smallest
        out = met.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
    else:  # each larger neighbour goes to the smallest
        out = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where(F.col("a") != F.col("b")).distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    """Number of edges (a > b), and of nodes that keep them from being stars: of several edges up, or of edges up and down."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    found = nodes.agg(F.sum("up"), F.expr("count_if(up > 1 or (up > 0 and least = 0))")).first()
    return found[0] or 0, found[1]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the smallest node) of every node that has an edge (a, b); edges to itself and nulls count for nothing."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), F.col("a").isNotNull().alias("_x"), F.col("b").isNotNull().alias("_y"))
    edges = save(edges.where("_x and _y and a != b").select("a", "b").distinct(), "edges")
    total, loose = _state(edges)
    for _ in range(rounds):
        if not loose:  # stars stay as they are
            break
        wide = save(_star(edges, small=False, total=total), "edges")
        new = save(_star(wide, small=True, total=total), "edges")
        drop(edges, wide)
        edges = new
        total, loose = _state(edges)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
