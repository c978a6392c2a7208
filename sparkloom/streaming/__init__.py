"""The follower count over a stream of edges; the batch functions work on the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources import EDGE


def edge_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(EDGE).csv(folder)


def follower_count(edges: DataFrame) -> DataFrame:
    """Running counts, for an output in complete or update mode; state grows with the number of users."""
    return edges.groupBy("user").agg(F.count("*").alias("n"))
