"""Sinks: text, delimited files, previews, plans and models. Every writer replaces what was there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tuple_text(df: DataFrame, path: str, opening: str = "(", closing: str = ")") -> None:
    """One line `(a,b)` for each row; `[a,b]` with other brackets."""
    fields = F.concat_ws(",", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null")) for c in df.columns])
    df.select(F.concat(F.lit(opening), fields, F.lit(closing)).alias("value")).write.mode("overwrite").text(path)


def delimited(df: DataFrame, path: str, separator: str = ",", one_file: bool = False) -> None:
    """Headerless delimited files; one_file is for small results only."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(path, sep=separator, header=False)


def preview(df: DataFrame, rows: int = 20) -> DataFrame:
    return df.limit(rows)


def plan(df: DataFrame, mode: str = "extended") -> str:
    """The plan's text."""
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def model_lines(spark: SparkSession, model) -> DataFrame:
    """line, text: a fitted tree model's rules, in order."""
    return spark.createDataFrame(list(enumerate(model.toDebugString.rstrip("\n").split("\n"))), "line long, text string")
