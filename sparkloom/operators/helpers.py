"""Splits, extremes, row ids and encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import party_number, type_code


def row_ids(df: DataFrame, key: str, first: int = 10001, ranges: int = 0) -> DataFrame:
    """df with id = first, first + 1, ... in the key's order.

    Rows are sorted into ranges of the key; ids inside a range start after the rows of the ranges before it, so no task sees all rows.
    """
    parts = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0]
    edges = sorted(set(cuts or []))
    number = F.lit(0)
    for e in edges:
        number = number + (F.col(key) > F.lit(e)).cast("int")
    dealt = df.withColumn("__range", F.coalesce(number, F.lit(0)))
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("__size"))
    before = sizes.select(F.col("__range").alias("__r"), (F.coalesce(F.sum("__size").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("__before"))  # one row a range
    own = dealt.withColumn("__own", F.row_number().over(Window.partitionBy("__range").orderBy(key)))
    return own.join(F.broadcast(before), F.col("__range") == F.col("__r")).withColumn("id", (F.col("__own") + F.col("__before") + (first - 1)).cast("long")).drop("__range", "__r", "__before", "__own")


def amount_extremes(txns: DataFrame) -> DataFrame:
    """Least and greatest amount, cut to whole numbers."""
    whole = F.col("amount").cast("int")
    return txns.agg(F.min(whole).alias("min_amount"), F.max(whole).alias("max_amount"))


def encoded(txns: DataFrame) -> DataFrame:
    """All eleven fields as doubles, the label last; txn_id passes."""
    d = lambda c: F.col(c).cast("double").alias(c)
    return txns.select("txn_id", d("step"), type_code(F.col("type")).alias("type"), d("amount"), party_number(F.col("nameOrig")).alias("nameOrig"), d("oldBalOrg"), d("newBalOrg"), party_number(F.col("nameDest")).alias("nameDest"), d("oldBalDest"), d("newBalDest"), d("isFlagged"), d("isFraud"))


def split(df: DataFrame, key: str, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose key modulo 100 is below percent, and the others: the same rows on every run."""
    low = F.pmod(F.col(key), F.lit(100)) < percent
    return df.filter(low), df.filter(~low)


def random_split(df: DataFrame, share: float = 0.8, seed: int = 20) -> tuple[DataFrame, DataFrame]:
    a, b = df.randomSplit([share, 1 - share], seed=seed)
    return a, b


def stratified_split(df: DataFrame, label: str, share: float = 0.7, seed: int = 20) -> tuple[DataFrame, DataFrame]:
    """A random split of each class, put together again."""
    parts = [df.filter(F.col(label) == v).randomSplit([share, 1 - share], seed=seed) for v in (1, 0)]
    return parts[0][0].union(parts[1][0]), parts[0][1].union(parts[1][1])
