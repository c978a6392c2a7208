"""Paths of two edges and directed triangles, with bag semantics by default."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _weighted(edges: DataFrame, distinct: bool, drop_self_loops: bool) -> DataFrame:
    """Distinct edges with their multiplicity w: repeats are joined once and multiplied, not repeated."""
    if drop_self_loops:
        edges = edges.filter("follower <> user")
    return edges.groupBy("follower", "user").agg((F.lit(1).cast("long") if distinct else F.count("*")).alias("w"))


def path2(edges: DataFrame) -> DataFrame:
    """follower1, user2, n: the number of paths of two edges from one to the other, ends differing."""
    w = _weighted(edges, False, False)
    a, b = w.toDF("f1", "mid", "w1"), w.toDF("mid2", "u2", "w2")
    joined = a.join(b, (F.col("mid") == F.col("mid2")) & (F.col("f1") != F.col("u2")))
    return joined.groupBy(F.col("f1").alias("follower1"), F.col("u2").alias("user2")).agg(F.sum(F.col("w1") * F.col("w2")).alias("n"))


#: Distinct edges that are broadcast at most.
BROADCAST_EDGES = 1_000_000


def triangles(edges: DataFrame, strategy: str = "auto", distinct: bool = False, drop_self_loops: bool = False) -> DataFrame:
    """One row, `triangles`: closed walks of three edges whose first two have differing ends, over 3, rounded down.

    Paths of two edges are summed per pair of ends before they meet the closing edge, so repeats cost nothing.
    """
    w = _weighted(edges, distinct, drop_self_loops)
    hint = lambda df: df
    if strategy == "merge":
        hint = lambda df: df.hint("merge")
    elif strategy == "broadcast" and w.count() <= BROADCAST_EDGES:
        hint = F.broadcast
    a, b, c = w.toDF("f1", "m1", "w1"), w.toDF("m2", "u2", "w2"), w.toDF("f3", "u3", "w3")
    paths = a.join(hint(b), (F.col("m1") == F.col("m2")) & (F.col("f1") != F.col("u2")))
    paths = paths.groupBy("f1", "u2").agg(F.sum(F.col("w1") * F.col("w2")).alias("n"))
    closed = paths.join(hint(c), (F.col("u2") == F.col("f3")) & (F.col("f1") == F.col("u3")))
    return closed.agg(F.expr("coalesce(sum(n * w3), 0) div 3").alias("triangles"))
