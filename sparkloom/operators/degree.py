"""Followers per user, by six strategies with one result; a null user is a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def follower_count(edges: DataFrame, strategy: str = "count") -> DataFrame:
    """user, n. `group` and `fold` gather ones before adding them, to show the contrast: they move every row. What is gathered is
    one user's in one part of the input, so a user with very many followers is never one list."""
    ones = edges.select("user", F.lit(1).cast("long").alias("one"))
    by = ones.groupBy("user")
    total = {
        "count": lambda: F.count("*"),
        "reduce": lambda: F.sum("one"),
        "combiner": lambda: F.sum("one"),
        "aggregate": lambda: F.count(F.lit(1)),
        "group": lambda: F.sum("one"),
        "fold": lambda: F.sum("one"),
    }[strategy]
    if strategy in ("group", "fold"):
        gathered = ones.withColumn("part", F.spark_partition_id()).groupBy("user", "part").agg(F.collect_list("one").alias("ones"))
        zero, add = F.lit(0).cast("long"), lambda a, x: a + x
        added = F.aggregate("ones", zero, add) if strategy == "group" else F.aggregate("ones", zero, add, lambda a: a)
        by = gathered.select("user", added.alias("one")).groupBy("user")
    if strategy == "combiner":  # partial sums made explicit: users are salted, then merged
        salted = ones.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(16))).groupBy("user", "salt").agg(F.sum("one").alias("one"))
        by = salted.groupBy("user")
    return by.agg(total().alias("n"))
