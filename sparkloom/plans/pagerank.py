"""PageRank without damping on a graph of out-degree one; dangling mass goes through a dummy vertex 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iterate import cut

#: Passes between two cuts of the lineage.
EVERY = 2


def pagerank(graph: DataFrame, ranks: DataFrame, vertices: int, iterations: int = 10) -> DataFrame:
    """vertex, rank after the passes. What reaches vertex 0 is shared by all others; 0 itself stays at 0."""
    for i in range(1, iterations + 1):
        into = graph.join(ranks, "vertex").groupBy("destination").agg(F.sum("rank").alias("got"))
        dangling = into.agg(F.coalesce(F.sum(F.when(F.col("destination") == 0, F.col("got"))), F.lit(0.0)).alias("lost"))  # one row
        joined = ranks.join(into, F.col("vertex") == F.col("destination"), "left").join(F.broadcast(dangling))
        ranks = joined.select("vertex", F.when(F.col("vertex") == 0, F.lit(0.0)).otherwise(F.coalesce("got", F.lit(0.0)) + F.col("lost") / vertices).alias("rank"))
        if i % EVERY == 0 or i == iterations:
            ranks = cut(ranks)
    return ranks


def masses(graph: DataFrame, ranks: DataFrame, vertices: int, iterations: int = 10) -> DataFrame:
    """iteration, mass: the sum of all ranks after each pass."""
    out = None
    for i in range(1, iterations + 1):
        ranks = pagerank(graph, ranks, vertices, 1)
        mass = ranks.agg(F.lit(i).cast("long").alias("iteration"), F.sum("rank").alias("mass"))
        out = mass if out is None else out.union(mass)
    return out
