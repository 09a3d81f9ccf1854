"""Buffers over tables and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringfold.operators.buffer import buffer


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str, p: int, value: str = "o_custkey") -> DataFrame:
    """orders by o_orderkey, dense from 0: rank = key % p, pos = key div p."""
    return buffer(table(spark, sf_dir, "orders"), F.col("o_orderkey") % p, F.expr(f"o_orderkey div {p}"), value)


def byte_file(spark: SparkSession, path: str, p: int) -> DataFrame:
    """The bytes of a file in p equal blocks, the rest at the last rank."""
    raw = spark.read.format("binaryFile").load(path).select(F.hex("content").alias("h"), "length")
    c = F.greatest(F.expr(f"length div {p}"), F.lit(1))
    at = raw.select(c.alias("c"), "h", F.explode(F.expr("sequence(0L, length - 1)")).alias("i")).where("i < length(h) / 2")
    byte = F.conv(F.substring(F.col("h"), (2 * F.col("i") + 1).cast("int"), F.lit(2)), 16, 10).cast("smallint")
    rank = F.least(F.call_function("div", F.col("i"), F.col("c")), F.lit(p - 1))
    return at.select(rank.cast("int").alias("rank"), (F.col("i") - rank * F.col("c")).cast("long").alias("pos"), byte.alias("value"))


def write_text(df: DataFrame, path: str, column: str = "line") -> None:
    """A sink for printed lines."""
    df.select(F.col(column).cast("string").alias("value")).write.text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)
