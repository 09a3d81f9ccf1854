"""Sorting, sparse, grid and dispatched exchange, reproducible reduction, recovery from failed ranks."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringfold.functions.reduce_ops import Op, op as as_op

from .buffer import checkpointed, small
from .communicator import _div

#: Largest volume in bytes that one rank may send for the grid to be chosen.
GRID_BELOW_BYTES = 2000
#: Levels of the reduction tree that are folded within one array.
TREE_LEVELS = 10


class Sorting:
    """L01-L03."""

    def sort(self, *, send_buf: DataFrame, by: Sequence[Column] | None = None) -> DataFrame:
        """(rank, pos, value, index): values in order, index counts them over all ranks, and equal parts go to the ranks.

        by: sort keys over value, such as F.col("value").desc(); ties are broken by old rank and position, so the order is
        total. Spark samples and range-partitions; each range's offset comes from counts of a row a range.
        """
        keys = list(by) if by else [F.col("value")]
        ranged = send_buf.repartitionByRange(*keys, F.col("rank"), F.col("pos")).withColumn("part", F.spark_partition_id())
        w = Window.partitionBy("part").orderBy(*keys, "rank", "pos")
        placed = checkpointed(ranged.withColumn("at", F.row_number().over(w).cast("long") - 1))
        sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
        offset = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        total = F.sum("n").over(Window.partitionBy())
        # Sampling again could cut other ranges, so rows and offsets come from one checkpoint.
        offsets = sizes.select("part", offset.alias("offset"), total.alias("total"))
        met = placed.join(F.broadcast(offsets), "part").withColumn("index", F.col("at") + F.col("offset"))
        share = F.ceil(F.col("total") / self.size)
        return met.select(_div(F.col("index"), share).cast("int").alias("rank"), (F.col("index") % share).alias("pos"), "value", "index")

    def top_k(self, *, send_buf: DataFrame, k: int, by: Sequence[Column] | None = None) -> DataFrame:
        """The k smallest values of all ranks."""
        return send_buf.orderBy(*(by or [F.col("value")]), "rank", "pos").limit(k)


class Sparse:
    """L04-L08."""

    def alltoallv_sparse(self, *, messages: DataFrame, on_message: Callable | None = None, schema: str | None = None) -> DataFrame:
        """(rank, dest, msg array) -> (rank, source, msg); empty messages are not sent.

        on_message(rank, source, list) returns columns of rows; schema describes them.
        """
        got = messages.where(F.size("msg") > 0).select(F.col("dest").alias("rank"), F.col("rank").alias("source"), "msg")
        if on_message is None:
            return got
        if schema is None:
            raise TypeError("a callback needs a schema")
        import pandas as pd

        def each(frames):
            for frame in frames:
                out = [pd.DataFrame(on_message(r, s, list(m))) for r, s, m in zip(frame["rank"], frame["source"], frame["msg"], strict=True)]
                if out:
                    yield pd.concat(out)

        return got.mapInPandas(each, schema)

    def grid(self) -> DataFrame:
        """(rank, row, col): about sqrt(p) columns; ranks of an incomplete last row join a row above, each in its own column."""
        root = math.sqrt(self.size)
        cols = math.ceil(root) if self.size >= math.floor(root) * math.ceil(root) else math.floor(root)
        rows = self.size // cols
        rank = F.col("rank")
        row = F.when(_div(rank, cols) >= rows, rank % cols).otherwise(_div(rank, cols))
        col = rank % cols
        return self.ranks.select("rank", row.cast("int").alias("row"), col.cast("int").alias("col"))

    def grid_alltoallv_with_envelope(self, *, send_buf: DataFrame, send_counts: DataFrame, envelope: str = "source_and_destination") -> DataFrame:
        """alltoallv with the columns source and destination, source alone, or none ("none")."""
        got = self._routed(send_buf, self.exchange_table(send_counts), ["source"]).withColumn("destination", F.col("rank"))
        drop = {"none": ["source", "destination"], "source": ["destination"], "source_and_destination": []}
        if envelope not in drop:
            raise ValueError(f"unknown envelope {envelope!r}")
        return got.drop(*drop[envelope])

    def grid_alltoallv(self, **args) -> DataFrame:
        return self.alltoallv(**args)

    def chosen_strategy(self, *, send_counts: DataFrame, element_bytes: int, threshold: int = GRID_BELOW_BYTES) -> DataFrame:
        """(max_bytes, strategy): grid if no rank sends as much as the threshold, else direct."""
        volume = send_counts.groupBy("rank").agg((F.sum("count") * element_bytes).alias("bytes")).agg(F.coalesce(F.max("bytes"), F.lit(0)).alias("max_bytes"))
        return volume.withColumn("strategy", F.when(F.col("max_bytes") < threshold, "grid").otherwise("direct"))

    def alltoallv_dispatch(self, *, send_buf: DataFrame, send_counts: DataFrame, **args) -> DataFrame:
        """Same rows by either strategy; how they move is left to adaptive execution."""
        return self.alltoallv(send_buf=send_buf, send_counts=send_counts, **args)


class Reproducible:
    """A15, L09, L10: a reduction whose tree is fixed by the global index, whatever the ranks hold."""

    def check_distribution(self, distribution: DataFrame) -> DataFrame:
        """(valid): (rank, send_count, displ) has no negative count, is not empty, and tiles 0..n without gaps or overlaps."""
        used = distribution.where("send_count <> 0")
        after = F.lead("displ").over(Window.orderBy("displ", "rank"))
        ok = (F.col("send_count") > 0) & (F.coalesce(after, F.col("displ") + F.col("send_count")) == F.col("displ") + F.col("send_count"))
        tiles = used.withColumn("ok", ok).agg(F.coalesce(F.bool_and("ok") & (F.min("displ") == 0), F.lit(False)).alias("valid"))
        return tiles

    def global_index(self, buf: DataFrame, distribution: DataFrame) -> DataFrame:
        """(idx, value) of a buffer dealt out as (rank, send_count, displ)."""
        at = small(distribution.select("rank", "displ"), self.size)
        return buf.join(at, "rank").select((F.col("displ") + F.col("pos")).alias("idx"), "value")

    def reproducible_reduce(self, *, indexed: DataFrame, op: str | Op, size: int | None = None) -> DataFrame:
        """(value) of (idx, value): neighbours are combined pair by pair, an odd last one passes, until one is left.

        An aligned block of 2**TREE_LEVELS values is one row after each step, so each step shrinks the data by that factor.
        """
        of, kind = as_op(op), indexed.schema["value"].dataType
        of.check(kind)
        n = size if size is not None else (indexed.agg(F.max("idx")).first()[0] or 0) + 1
        level = lambda xs: F.transform(F.sequence(F.lit(0), F.greatest(_div(F.size(xs) + 1, 2) - 1, F.lit(0)).cast("int")), lambda i: F.when(2 * i + 1 < F.size(xs), of.fold(F.get(xs, 2 * i), F.get(xs, 2 * i + 1)).cast(kind)).otherwise(F.get(xs, 2 * i)))
        rows = indexed.select(F.col("idx").cast("long"), "value")
        while n > 1:
            steps = min(TREE_LEVELS, (n - 1).bit_length())
            block = F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda x: x["value"])
            folded = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col("xs"), lambda xs, _: level(xs))
            rows = rows.groupBy(F.shiftright("idx", steps).alias("up")).agg(block.alias("xs")).select(F.col("up").alias("idx"), F.element_at(folded, 1).alias("value"))
            n = -(-n >> steps)
        return rows.select("value")


class Failures:
    """L11: the algebra that recovery needs; Spark itself repeats lost tasks."""

    def shrink(self, *, failed: Sequence[int]) -> DataFrame:
        """(rank, world_rank) of the ranks that are left, renumbered."""
        left = self.ranks.where(~F.col("rank").isin(list(failed))) if failed else self.ranks
        return left.select((F.row_number().over(Window.orderBy("rank")) - 1).alias("new"), F.col("rank").alias("world_rank")).withColumnRenamed("new", "rank")

    def agree(self, *, flags: DataFrame) -> DataFrame:
        """(value): bitwise and of whole numbers, logical and of booleans."""
        value = F.col("value")
        return flags.agg((F.bool_and(value) if flags.schema["value"].dataType.simpleString() == "boolean" else F.bit_and(value)).alias("value"))
