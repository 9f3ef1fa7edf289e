"""Connected components over an edge table, by alternating star contraction.

Each round rewrites every edge towards the smallest neighbour (large star, then small star); the number
of rounds grows with the logarithm of the longest path.  A hub's neighbourhood is never gathered into
one row: minima are plain aggregates, and the rewrite is a join on the node id that adaptive execution
may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.session import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Connect neighbours of a node to the least of them and itself: larger ones, or the smaller ones."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("_m")).withColumn("_m", F.least("u", "_m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("_m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("_m").alias("v")).unionByName(
            joined.select(F.col("u"), F.col("_m").alias("v"))
        )
    return out.filter(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 40) -> DataFrame:
    """``(node, component)`` for every node that occurs in an edge; component is the least node id.

    Null ends are dropped, self loops keep their node as its own component, repeated edges count once,
    and an empty input gives an empty result.
    """
    clean = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    nodes = clean.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    work = materialize(clean.filter("u <> v").distinct(), "cc-edges")
    previous = None
    for _ in range(max_rounds):
        work = materialize(_star(_star(work, True), False), "cc-round")
        mark = work.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if mark == previous:
            break
        previous = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    root = work.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(root, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def members_of(components: DataFrame) -> DataFrame:
    """All pairs ``(a, b)``, a < b, of nodes that share a component."""
    left = components.select(F.col("component"), F.col("node").alias("a"))
    right = components.select(F.col("component"), F.col("node").alias("b"))
    return left.join(right, "component").filter("a < b").select("a", "b")
