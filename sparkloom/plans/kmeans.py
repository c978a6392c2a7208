"""One-dimensional k-means on group sizes, with the rounding and merging rules of its oracle.

A centroid's value is its identity, to three decimals: equal ones merge, empty ones vanish. A pass's total is the sum over
clusters of floor(round3(sum of absolute deviations from the old centroid)). The loop stops when a total repeats.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import round3

from .iterate import cut


def _round3(x: float) -> float:
    return math.floor(x * 1000 + 0.5) / 1000


def extremes(counts: DataFrame) -> tuple[int, int]:
    low, high = counts.agg(F.min("n"), F.max("n")).first()
    return low, high


def good_start(low: int, high: int, k: int) -> list[float]:
    """Middles of k equal ranges."""
    r = (high - low) / k
    return [_round3(low + r / 2 + r * j) for j in range(k)]


def offset_start(low: int, k: int, step: int = 100) -> list[float]:
    """The least value plus one to k steps."""
    return [float(low + step * i) for i in range(1, k + 1)]


def assign(counts: DataFrame, centroids: list[float]) -> DataFrame:
    """counts with the nearest centroid, the lower of equals."""
    near = F.array_min(F.array(*[F.struct(F.abs(F.lit(c) - F.col("n")).alias("off"), F.lit(c).alias("c")) for c in centroids]))
    return counts.withColumn("centroid", near["c"])


def step(counts: DataFrame, centroids: list[float]) -> tuple[list[float], int]:
    """New centroids and the total of the pass; one row a cluster comes to the driver."""
    grouped = assign(counts, centroids).groupBy("centroid").agg(round3(F.sum("n").cast("double") / F.count("*")).alias("new"), round3(F.sum(F.abs(F.col("centroid") - F.col("n")))).alias("sae"))
    rows = grouped.collect()
    return sorted({r["new"] for r in rows}), sum(math.floor(r["sae"]) for r in rows)


def kmeans(counts: DataFrame, start: list[float], passes: int = 10) -> tuple[list[float], list[int]]:
    """Final centroids and each pass's total."""
    counts = cut(counts.select("n"))
    centroids, totals = sorted(set(start)), []
    for _ in range(passes):
        centroids, total = step(counts, centroids)
        totals.append(total)
        if len(totals) > 1 and totals[-1] == totals[-2]:
            break
    return centroids, totals
