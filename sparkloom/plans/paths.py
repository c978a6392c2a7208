"""Single-source shortest paths by hops: each pass extends the frontier only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iterate import cut


def relax(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    """id, d: the least distance at which an edge out of the frontier reaches each vertex."""
    return edges.join(frontier, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("id")).agg(F.min(F.col("d") + 1).alias("d"))


#: Tables of reached vertices that are read side by side at most.
TABLES = 4


def shortest_paths(edges: DataFrame, source: int) -> DataFrame:
    """id, d for each vertex that the source reaches, itself at 0.

    Each pass writes its new vertices; these tables are merged into one whenever there are more than TABLES, so a pass reads few.
    """
    spark = edges.sparkSession
    edges = cut(edges.distinct())
    frontier = cut(spark.range(1).select(F.lit(source).cast("long").alias("id"), F.lit(0).cast("long").alias("d")))
    seen = [frontier]
    union = lambda: reduce(DataFrame.union, seen)
    while True:
        frontier = cut(relax(edges, frontier).join(union().select("id"), "id", "left_anti"))
        if frontier.isEmpty():
            return union()
        seen.append(frontier)
        if len(seen) > TABLES:
            seen = [cut(union())]


def eccentricity(edges: DataFrame, source: int) -> DataFrame:
    """One row (name Diameter, n) with the greatest finite distance; none if the source has no edge out."""
    out = shortest_paths(edges, source).agg(F.max("d").alias("n"))
    return out.filter("n > 0").select(F.lit("Diameter").alias("name"), "n")

