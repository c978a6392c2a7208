"""Filters and reshapings of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def max_filter(edges: DataFrame, bound: int | str, mode: str = "numeric") -> DataFrame:
    """Edges with both ends below the bound, as numbers or byte-wise as text."""
    if mode == "numeric":
        return edges.filter((F.col("follower") < int(bound)) & (F.col("user") < int(bound)))
    if mode != "lexical":
        raise ValueError(f"mode {mode}")
    return edges.filter((F.col("follower").cast("string") < str(bound)) & (F.col("user").cast("string") < str(bound)))


def swapped(edges: DataFrame) -> DataFrame:
    return edges.select("user", "follower")


def tagged(edges: DataFrame) -> DataFrame:
    """Each edge twice: keyed by its user with tag T, by its follower with tag F."""
    to = edges.select(F.col("user").alias("key"), F.lit("T").alias("tag"), F.col("follower").alias("other"))
    return to.unionByName(edges.select(F.col("follower").alias("key"), F.lit("F").alias("tag"), F.col("user").alias("other")))


def adjacency(edges: DataFrame) -> DataFrame:
    """follower and its users in order, space-separated. For display: a vertex's list must fit in a row; adjacency_parts
    bounds the lists."""
    return edges.groupBy("follower").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list("user")), lambda x: x.cast("string"))).alias("neighbors"))


def adjacency_parts(edges: DataFrame, most: int = 100_000) -> DataFrame:
    """follower, part (from 0) and users in order: the adjacency list in parts of about `most`, each in one row.

    A user's part follows from its hash and the follower's number of users, so no task sorts all users of a follower; users are in
    order in a part, each user's repeats in one.
    """
    sizes = edges.groupBy("follower").agg(F.count("*").alias("n"))
    parts = sizes.filter(F.col("n") > most).select(F.col("follower").alias("f"), F.ceil(F.col("n") / most).alias("parts"))
    # few followers have more; the others' one part needs no join to be known
    dealt = edges.join(parts, F.col("follower") == F.col("f"), "left").select("follower", "user", F.coalesce(F.pmod(F.xxhash64("user"), F.col("parts")), F.lit(0)).cast("int").alias("part"))
    return dealt.groupBy("follower", "part").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list("user")), lambda x: x.cast("string"))).alias("neighbors"))
