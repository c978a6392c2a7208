"""Scans: text, key/value lines, delimited files, generated graphs, and views of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDGE = T.StructType([T.StructField("follower", T.LongType()), T.StructField("user", T.LongType())])
TRANSACTION = T.StructType(
    [T.StructField(n, t) for n, t in (("step", T.LongType()), ("type", T.StringType()), ("amount", T.DoubleType()), ("nameOrig", T.StringType()), ("oldBalOrg", T.DoubleType()), ("newBalOrg", T.DoubleType()), ("nameDest", T.StringType()), ("oldBalDest", T.DoubleType()), ("newBalDest", T.DoubleType()), ("isFraud", T.IntegerType()), ("isFlagged", T.IntegerType()))]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_lines(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """One row `value` for each line; at least `partitions` partitions if given."""
    lines = spark.read.text(path)
    return lines.repartition(partitions) if partitions else lines


def key_value_lines(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """Lines cut at the first separator into key and value; a line without one is a key with an empty value."""
    at = F.instr("value", separator)
    return spark.read.text(path).select(F.when(at > 0, F.expr("substring(value, 1, instr(value, '%s') - 1)" % separator)).otherwise(F.col("value")).alias("key"), F.when(at > 0, F.expr(f"substring(value, instr(value, '{separator}') + {len(separator)})")).otherwise("").alias("value"))


def edge_file(spark: SparkSession, path: str, infer: bool = False) -> DataFrame:
    """Headerless `follower,user` lines; a field that is no number fails."""
    if infer:
        return spark.read.option("inferSchema", "true").csv(path).toDF("follower", "user")
    return spark.read.schema(EDGE).option("mode", "FAILFAST").csv(path)


def headed_file(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True, sep=separator)


def transaction_file(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    return spark.read.schema(TRANSACTION).option("mode", "FAILFAST").csv(path, header=header)


def chain_graph(spark: SparkSession, k: int) -> DataFrame:
    """k chains of k vertices: v -> v + 1, a chain's end -> 0. For k >= 1."""
    v = F.col("id")
    return spark.range(1, k * k + 1).select(v.alias("vertex"), F.when(v % k == 0, F.lit(0)).otherwise(v + 1).cast("long").alias("destination"))


def chain_ranks(spark: SparkSession, k: int) -> DataFrame:
    """First ranks: 1 / k^2 for each vertex, 0 for the dummy vertex 0."""
    return spark.range(0, k * k + 1).select(F.col("id").alias("vertex"), F.when(F.col("id") == 0, F.lit(0.0)).otherwise(F.lit(1.0 / (k * k))).alias("rank"))


# ------------------------------------------------ views of the test tables


def edges(spark: SparkSession, sf_dir: str, modulus: int = 1000) -> DataFrame:
    """A bag of edges with repeats and self-loops."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % modulus).alias("follower"), (F.col("l_partkey") % modulus).alias("user"))


def hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directed graph src -> dst over the customers' numbers, of all orders."""
    n = table(spark, sf_dir, "customer").agg(F.count("*").alias("n"))
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return orders.join(F.broadcast(n)).select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % F.col("n")).alias("dst"))  # n is one row


def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group sizes that stand for follower counts: user, n."""
    return table(spark, sf_dir, "lineitem").groupBy(F.floor(F.col("l_extendedprice") / 500).alias("user")).agg(F.count("*").alias("n"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments made of orders and customers, with a fraud label."""
    kinds = F.when(F.col("o_orderpriority") == "1-URGENT", "PAYMENT").when(F.col("o_orderpriority") == "2-HIGH", "TRANSFER").when(F.col("o_orderpriority") == "3-MEDIUM", "CASH_OUT").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "DEBIT").otherwise("CASH_IN")
    fraud = F.col("o_orderpriority").isin("2-HIGH", "3-MEDIUM") & (F.col("o_totalprice") > 350000)
    flagged = (F.col("o_orderpriority") == "2-HIGH") & (F.col("o_totalprice") > 450000)
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        F.col("o_orderkey").alias("txn_id"),
        F.datediff(F.col("o_orderdate"), F.lit("1992-01-01").cast("date")).cast("long").alias("step"),
        kinds.alias("type"),
        F.col("o_totalprice").alias("amount"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("nameOrig"),
        F.col("c_acctbal").alias("oldBalOrg"),
        (F.col("c_acctbal") - F.col("o_totalprice")).alias("newBalOrg"),
        F.concat(F.lit("M"), (F.col("o_orderkey") % 1000).cast("string")).alias("nameDest"),
        F.lit(0.0).alias("oldBalDest"),
        F.col("o_totalprice").alias("newBalDest"),
        fraud.cast("int").alias("isFraud"),
        flagged.cast("int").alias("isFlagged"),
    )
