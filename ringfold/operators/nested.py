"""Nested and sparse containers, spans, checked casts, serialised payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .buffer import exscan


def flatten(df: DataFrame, size: int, column: str = "container") -> tuple[DataFrame, DataFrame]:
    """(rank, container) -> a buffer, and (rank, peer, count, displ) for all peers.

    The container is array<array<T>>, one array a destination, or map<int, array<T>>; missing destinations count 0.
    """
    kind = df.schema[column].dataType
    if is_sparse(kind):
        entries = F.transform(F.array_sort(F.map_entries(column)), lambda e: F.struct(e["key"].cast("int").alias("peer"), e["value"].alias("xs")))
    elif is_nested(kind):
        entries = F.transform(column, lambda xs, k: F.struct(k.cast("int").alias("peer"), xs.alias("xs")))
    else:
        raise TypeError(f"{kind.simpleString()} is neither nested nor sparse")
    one = df.select("rank", entries.alias("e"))
    flat = one.select("rank", F.posexplode(F.flatten(F.transform("e", lambda e: e["xs"]))).alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))
    given = one.select("rank", F.inline(F.transform("e", lambda e: F.struct(e["peer"].alias("peer"), F.size(e["xs"]).cast("long").alias("count")))))
    all_pairs = one.select("rank", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("peer"))
    counts = all_pairs.join(given, ["rank", "peer"], "left").select("rank", "peer", F.coalesce("count", F.lit(0)).alias("count"))
    return flat, exscan(counts, "count", ["rank"], ["peer"], "displ")


def with_flattened(comm, df: DataFrame, column: str = "container", **args) -> DataFrame:
    """flatten, then alltoallv."""
    flat, counts = flatten(df, comm.size, column)
    return comm.alltoallv(send_buf=flat, send_counts=counts.select("rank", "peer", "count"), **args)


def is_nested(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType)


def is_pair_like(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and len(kind) == 2


def is_sparse(kind: T.DataType) -> bool:
    return isinstance(kind, T.MapType) and isinstance(kind.keyType, T.IntegralType) and isinstance(kind.valueType, T.ArrayType)


class Span:
    """A slice of each rank's buffer, renumbered from 0."""

    def __init__(self, buf: DataFrame):
        self.buf = buf

    def subspan(self, offset: int, count: int | None = None) -> DataFrame:
        rows = self.buf.where(F.col("pos") >= offset)
        if count is not None:
            rows = rows.where(F.col("pos") < offset + count)
        return rows.withColumn("pos", F.col("pos") - offset)

    def first(self, count: int) -> DataFrame:
        return self.subspan(0, count)

    def last(self, count: int) -> DataFrame:
        """By each rank's size, a row a rank."""
        size = self.buf.groupBy("rank").agg(F.count("*").alias("n"))
        rows = self.buf.join(size, "rank").where(F.col("pos") >= F.col("n") - count)
        return rows.select("rank", (F.col("pos") - F.greatest(F.col("n") - count, F.lit(0))).alias("pos"), "value")

    def front(self) -> DataFrame:
        return self.first(1).select("rank", "value")

    def back(self) -> DataFrame:
        return self.buf.groupBy("rank").agg(F.max_by("value", "pos").alias("value"))


def in_range(value: Column, kind: str) -> Column:
    """Whether the number fits the type."""
    return value.isNull() | value.try_cast(kind).isNotNull()


def throwing_cast(value: Column, kind: str) -> Column:
    """An error, when computed, for numbers that don't fit."""
    return F.when(in_range(value, kind), value.try_cast(kind)).otherwise(F.raise_error(F.concat(F.lit(f"no {kind}: "), value.cast("string"))).cast(kind))


def as_serialized(value: Column) -> Column:
    return F.to_json(value)


def as_deserializable(text: Column, schema: str) -> Column:
    return F.from_json(text, schema)
