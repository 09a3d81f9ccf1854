"""Distributed buffers: DataFrames (rank int, pos long, value), pos dense from 0 within each rank."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Relations over the ranks are broadcast up to so many rows (ranks, or pairs of ranks).
BROADCAST_ROWS = 250_000
_UNSUPPORTED = (T.NullType, T.VariantType, T.CalendarIntervalType)


def check_type(df: DataFrame, column: str = "value") -> None:
    """TypeError for element types that no buffer can hold."""
    kind = df.schema[column].dataType
    if isinstance(kind, _UNSUPPORTED):
        raise TypeError(f"a buffer can't hold {kind.simpleString()}")


def buffer(df: DataFrame, rank: Column | str = "rank", pos: Column | str = "pos", value: Column | str = "value") -> DataFrame:
    """A buffer view of df."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    out = df.select(col(rank).cast("int").alias("rank"), col(pos).cast("long").alias("pos"), col(value).alias("value"))
    check_type(out)
    return out


def from_lists(spark: SparkSession, lists: Sequence[Sequence], value_type: str) -> DataFrame:
    """A buffer from one Python list a rank."""
    rows = [(r, k, v) for r, own in enumerate(lists) for k, v in enumerate(own)]
    return spark.createDataFrame(rows, f"rank int, pos long, value {value_type}")


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if `rows`, its proven size, allows that; else Spark chooses the join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def fan_out(df: DataFrame, p: int) -> DataFrame:
    """Every row for each rank 0..p-1: a projection, no join."""
    return df.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(p - 1))))


def exscan(df: DataFrame, column: str, by: Sequence[str], order: Iterable[str], into: str) -> DataFrame:
    """Exclusive prefix sums of a column over a relation of ranks."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(into, F.coalesce(F.sum(column).over(w), F.lit(0)).cast("long"))


def merge_into(target: DataFrame, new: DataFrame, resize: str = "resize_to_fit") -> DataFrame:
    """What a supplied receive buffer holds afterwards.

    resize_to_fit: only the new data. grow_only and no_resize: the new data, then the old tail; no_resize also raises an
    error, when the result is computed, if the old buffer is too small.
    """
    if resize == "resize_to_fit":
        return new
    if resize not in ("grow_only", "no_resize"):
        raise ValueError(f"unknown resize policy {resize!r}")
    old = target.select("rank", "pos", F.col("value").alias("old"), F.lit(True).alias("had"))
    both = new.withColumn("has", F.lit(True)).join(old, ["rank", "pos"], "full_outer")
    value = F.when(F.col("has"), F.col("value")).otherwise(F.col("old"))
    if resize == "no_resize":
        value = F.when(F.col("had"), value).otherwise(F.raise_error(F.lit("the receive buffer is too small")))
    return both.select("rank", "pos", value.alias("value"))


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed and read from the shared checkpoint folder; one is made only in local mode, where none is set."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="ringfold-"))
    return df.checkpoint(eager=True)
