"""The communicator: collective operations over buffers, as lazy rewrites of DataFrames.

Every operation takes keyword arguments; a missing or unknown one is a TypeError. `out` names further results (counts,
displacements), which are only planned when asked for; the return value is then a Result, received buffer first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringfold.functions.reduce_ops import Op, op as as_op, reduced

from .buffer import check_type, checkpointed, exscan, fan_out, merge_into, small

Counts = DataFrame | Sequence[int] | Mapping[int, int]


class Result(NamedTuple):
    recv_buf: DataFrame
    extra: dict[str, DataFrame]

    def __getattr__(self, name: str):
        try:
            return self.extra[name]
        except KeyError:
            raise AttributeError(name) from None


class Base:
    """Rank count, default root and tag, and what all operations share."""

    def __init__(self, spark: SparkSession, size: int, *, root: int = 0, default_tag: int = 0):
        if size < 1:
            raise ValueError("a communicator has at least one rank")
        self.spark, self.size = spark, size
        self.root = self._rank(root)
        self.default_tag = self._tag(default_tag)

    def is_valid_rank(self, rank: int) -> bool:
        return 0 <= rank < self.size

    def is_root(self, rank: int, root: int | None = None) -> bool:
        return rank == (self.root if root is None else root)

    def _rank(self, rank: int) -> int:
        if not self.is_valid_rank(rank):
            raise ValueError(f"no rank {rank} among {self.size}")
        return rank

    def _tag(self, tag: int) -> int:
        if not 0 <= tag < 1 << 31:
            raise ValueError(f"no valid tag: {tag}")
        return tag

    def with_root(self, root: int):
        return type(self)(self.spark, self.size, root=root, default_tag=self.default_tag)

    def with_default_tag(self, tag: int):
        return type(self)(self.spark, self.size, root=self.root, default_tag=tag)

    @property
    def ranks(self) -> DataFrame:
        return self.spark.range(self.size).select(F.col("id").cast("int").alias("rank"))

    def _from_root(self, buf: DataFrame, root: int | None) -> DataFrame:
        return buf.where(F.col("rank") == self._rank(self.root if root is None else root))

    def counts(self, buf: DataFrame) -> DataFrame:
        """(rank, count) with empty ranks."""
        found = buf.groupBy("rank").agg(F.count("*").alias("count"))
        return self.ranks.join(found, "rank", "left").select("rank", F.coalesce("count", F.lit(0)).alias("count"))

    def _relation(self, counts: Counts, column: str = "count", key: str = "rank") -> DataFrame:
        """(key, column) from a DataFrame, a list by rank or a mapping; missing ranks are 0."""
        if isinstance(counts, DataFrame):
            given = counts.select(F.col(key).cast("int"), F.col(column).cast("long"))
        else:
            pairs = list(counts.items()) if isinstance(counts, Mapping) else list(enumerate(counts))
            if any(not self.is_valid_rank(k) or v < 0 for k, v in pairs):
                raise ValueError("counts and displacements are for valid ranks and not negative")
            given = self.spark.createDataFrame(pairs, f"{key} int, {column} long")
        return self.ranks.withColumnRenamed("rank", key).join(given, key, "left").select(key, F.coalesce(column, F.lit(0)).alias(column))

    def _finish(self, new: DataFrame, recv_buf: DataFrame | None, resize: str, **extra: DataFrame):
        new = new.select("rank", "pos", "value")
        check_type(new)
        got = new if recv_buf is None else merge_into(recv_buf, new, resize)
        return Result(got, extra) if extra else got

    def _with_block(self, buf: DataFrame, count: int | None) -> DataFrame:
        """buf and its block length c: given, or each rank's size divided by the number of ranks, checked when computed.

        The sizes are an aggregate of one row a rank that meets the buffer in a broadcast join; elements aren't shuffled.
        """
        if count is not None:
            return buf.withColumn("c", F.lit(count).cast("long"))
        odd = F.raise_error(F.lit("the buffer's size is no multiple of the number of ranks")).cast("long")
        size = buf.groupBy("rank").agg(F.count("*").alias("n")).select("rank", F.when(F.col("n") % self.size == 0, _div(F.col("n"), self.size)).otherwise(odd).alias("c"))
        return buf.join(small(size, self.size), "rank")


def _div(a: Column, b: Column | int) -> Column:
    """Whole-number division; positions are never negative."""
    b = b if isinstance(b, Column) else F.lit(b)
    return F.call_function("div", a, b)


class Movement(Base):
    """C01-C13, C15: broadcast, gather, scatter, all-to-all."""

    def bcast(self, *, send_recv_buf: DataFrame, root: int | None = None, send_recv_count: int | None = None, recv_buf: DataFrame | None = None, resize: str = "resize_to_fit"):
        """The root's buffer (its first send_recv_count elements) on every rank."""
        own = self._from_root(send_recv_buf, root)
        if send_recv_count is not None:
            own = own.where(F.col("pos") < send_recv_count)
        return self._finish(fan_out(own, self.size), recv_buf, resize)

    def bcast_single(self, *, send_recv_buf, root: int | None = None):
        """One value on every rank; a Python scalar is sent as it is."""
        if isinstance(send_recv_buf, DataFrame):
            return self.bcast(send_recv_buf=send_recv_buf.where("pos = 0"), root=root)
        return self.ranks.select("rank", F.lit(0).cast("long").alias("pos"), F.lit(send_recv_buf).alias("value"))

    def gather(self, *, send_buf: DataFrame, send_count: int | None = None, root: int | None = None, recv_buf: DataFrame | None = None, resize: str = "resize_to_fit"):
        """Equal-sized buffers one after another on the root. Without send_count the common size is taken and checked."""
        out = send_buf.where(F.col("pos") < send_count) if send_count is not None else send_buf
        count = F.lit(send_count) if send_count is not None else self._equal_size(send_buf)
        out = out.withColumn("pos", F.col("rank") * count + F.col("pos"))
        return self._finish(out.withColumn("rank", F.lit(self._rank(self.root if root is None else root))), recv_buf, resize)

    def _equal_size(self, buf: DataFrame) -> Column:
        """The size that all ranks' buffers have, as a scalar subquery; unequal sizes raise an error."""
        counts = self.counts(buf).agg(F.min("count").alias("a"), F.max("count").alias("b"))
        return counts.select(F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.raise_error(F.lit("the ranks' buffers differ in size"))).cast("long")).scalar()

    def gatherv(self, *, send_buf: DataFrame, root: int | None = None, recv_counts: Counts | None = None, recv_displs: Counts | None = None, out: Sequence[str] = (), recv_buf: DataFrame | None = None, resize: str = "resize_to_fit"):
        """Buffers of any sizes one after another on the root, at recv_displs if given."""
        got, extra = self._gathered(send_buf, recv_counts, recv_displs, out)
        return self._finish(got.withColumn("rank", F.lit(self._rank(self.root if root is None else root))), recv_buf, resize, **extra)

    def _gathered(self, send_buf, recv_counts, recv_displs, out):
        counts = self.counts(send_buf) if recv_counts is None else self._relation(recv_counts)
        displs = exscan(counts.withColumn("all", F.lit(0)), "count", ["all"], ["rank"], "displ").select("rank", "count", "displ")
        if recv_displs is not None:
            displs = displs.drop("displ").join(self._relation(recv_displs, "displ"), "rank")
        at = small(displs.select("rank", "displ"), self.size)
        got = send_buf.join(at, "rank").select("rank", (F.col("displ") + F.col("pos")).alias("pos"), "value")
        all_extra = {"recv_counts": displs.select("rank", "count"), "recv_displs": displs.select("rank", "displ")}
        return got, {k: all_extra[k] for k in out}

    def allgather(self, *, send_buf: DataFrame, send_count: int | None = None, recv_buf: DataFrame | None = None, resize: str = "resize_to_fit"):
        return self._finish(fan_out(self.gather(send_buf=send_buf, send_count=send_count), self.size), recv_buf, resize)

    def allgather_inplace(self, *, send_recv_buf: DataFrame, send_recv_count: int | None = None):
        """Each rank's own block of a buffer of p blocks goes to all ranks."""
        own = self._with_block(send_recv_buf, send_recv_count).where(_div(F.col("pos"), F.col("c")) == F.col("rank")).drop("c")
        return self._finish(fan_out(own, self.size), None, "resize_to_fit")

    def allgatherv(self, *, send_buf: DataFrame, recv_counts: Counts | None = None, recv_displs: Counts | None = None, out: Sequence[str] = (), recv_buf: DataFrame | None = None, resize: str = "resize_to_fit"):
        got, extra = self._gathered(send_buf, recv_counts, recv_displs, out)
        return self._finish(fan_out(got, self.size), recv_buf, resize, **extra)

    def scatter(self, *, send_buf: DataFrame, send_count: int | None = None, root: int | None = None, recv_buf: DataFrame | None = None, resize: str = "resize_to_fit"):
        """Block i of the root's buffer on rank i."""
        own = self._with_block(self._from_root(send_buf, root), send_count)
        out = own.select(_div(F.col("pos"), F.col("c")).cast("int").alias("rank"), (F.col("pos") % F.col("c")).alias("pos"), "value").where(F.col("rank") < self.size)
        return self._finish(out, recv_buf, resize)

    def scatter_single(self, *, send_buf: DataFrame, root: int | None = None):
        return self.scatter(send_buf=send_buf, send_count=1, root=root)

    def scatterv(self, *, send_buf: DataFrame, send_counts: Counts, send_displs: Counts | None = None, root: int | None = None, out: Sequence[str] = (), recv_buf: DataFrame | None = None, resize: str = "resize_to_fit"):
        """send_counts elements from send_displs on (default: one after another) of the root's buffer on each rank.

        Elements in no segment go nowhere, those in several to each.
        """
        root = self._rank(self.root if root is None else root)
        segments = self._relation(send_counts).withColumn("all", F.lit(0))
        segments = exscan(segments, "count", ["all"], ["rank"], "displ")
        if send_displs is not None:
            segments = segments.drop("displ").join(self._relation(send_displs, "displ"), "rank")
        table = segments.select(F.lit(root).alias("rank"), F.col("rank").alias("peer"), "count", F.col("displ").alias("send_displ"), F.lit(0).cast("long").alias("recv_displ"))
        extra = {"recv_count": segments.select("rank", "count"), "send_displs": segments.select("rank", "displ")}
        return self._finish(self._routed(self._from_root(send_buf, root), table), recv_buf, resize, **{k: extra[k] for k in out})

    def _routed(self, buf: DataFrame, table: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Elements to where the segments (rank, peer, count, send_displ, recv_displ) send them.

        Each rank's segments are one array of at most p entries, met by an equi-join on the rank; no range join.
        """
        per_rank = table.where("count > 0").groupBy("rank").agg(F.collect_list(F.struct("peer", "count", "send_displ", "recv_displ")).alias("to"))
        met = buf.join(small(per_rank, self.size * self.size), "rank")
        fits = F.filter("to", lambda s: (F.col("pos") >= s["send_displ"]) & (F.col("pos") < s["send_displ"] + s["count"]))
        one = met.withColumn("s", F.explode(fits))
        return one.select(F.col("s.peer").cast("int").alias("rank"), (F.col("s.recv_displ") + F.col("pos") - F.col("s.send_displ")).alias("pos"), "value", *(c for c in keep if c != "source"), *([F.col("rank").alias("source")] if "source" in keep else []))

    def alltoall(self, *, send_buf: DataFrame, send_count: int | None = None, recv_buf: DataFrame | None = None, resize: str = "resize_to_fit"):
        """Block d of rank r becomes block r of rank d: a projection."""
        at = self._with_block(send_buf, send_count).where(F.col("pos") < F.col("c") * self.size)
        out = at.select(_div(F.col("pos"), F.col("c")).cast("int").alias("rank"), (F.col("rank") * F.col("c") + F.col("pos") % F.col("c")).alias("pos"), "value")
        return self._finish(out, recv_buf, resize)

    def alltoall_inplace(self, *, send_recv_buf: DataFrame, send_recv_count: int | None = None):
        return self.alltoall(send_buf=send_recv_buf, send_count=send_recv_count)

    def exchange_table(self, send_counts: DataFrame, send_displs: DataFrame | None = None, recv_displs: DataFrame | None = None) -> DataFrame:
        """(rank, peer, count, send_displ, recv_displ) of (rank, peer, count); missing pairs send nothing."""
        table = send_counts.select(F.col("rank").cast("int"), F.col("peer").cast("int"), F.col("count").cast("long"))
        table = exscan(table, "count", ["rank"], ["peer"], "send_displ")
        table = exscan(table, "count", ["peer"], ["rank"], "recv_displ")
        if send_displs is not None:
            table = table.drop("send_displ").join(send_displs.select("rank", "peer", F.col("displ").alias("send_displ")), ["rank", "peer"])
        if recv_displs is not None:
            given = recv_displs.select(F.col("peer").alias("rank"), F.col("rank").alias("peer"), F.col("displ").alias("recv_displ"))
            table = table.drop("recv_displ").join(given, ["rank", "peer"])
        return table

    def alltoallv(self, *, send_buf: DataFrame, send_counts: DataFrame, send_displs: DataFrame | None = None, recv_displs: DataFrame | None = None, out: Sequence[str] = (), recv_buf: DataFrame | None = None, resize: str = "resize_to_fit"):
        """count(rank, peer) elements of rank for each peer; received by source rank, then in sent order.

        recv_displs are (rank, peer, displ) as the receiving rank sees them.
        """
        table = self.exchange_table(send_counts, send_displs, recv_displs)
        swapped = lambda c: table.select(F.col("peer").alias("rank"), F.col("rank").alias("peer"), F.col(c).alias("count" if c == "count" else "displ"))
        extra = {"recv_counts": lambda: swapped("count"), "recv_displs": lambda: swapped("recv_displ"), "send_displs": lambda: table.select("rank", "peer", F.col("send_displ").alias("displ"))}
        return self._finish(self._routed(send_buf, table), recv_buf, resize, **{k: extra[k]() for k in out})

    def barrier(self, *buffers: DataFrame) -> list[DataFrame]:
        """Computes the buffers, and returns them read from a checkpoint: what follows starts after all of it is done."""
        return [checkpointed(b) for b in buffers]


class Reductions(Base):
    """A01-A14: reductions over ranks, scans."""

    def _reduce(self, buf: DataFrame, op, count: int | None) -> DataFrame:
        of, kind = as_op(op), buf.schema["value"].dataType
        rows = buf if count is None else buf.where(F.col("pos") < count)
        return rows.groupBy("pos").agg(reduced(of, kind).alias("value"))

    def reduce(self, *, send_buf: DataFrame, op: str | Op, root: int | None = None, send_recv_count: int | None = None, recv_buf: DataFrame | None = None, resize: str = "resize_to_fit"):
        """Element-wise over the ranks, on the root."""
        out = self._reduce(send_buf, op, send_recv_count).withColumn("rank", F.lit(self._rank(self.root if root is None else root)))
        return self._finish(out, recv_buf, resize)

    def reduce_single(self, *, send_buf: DataFrame, op: str | Op, root: int | None = None):
        """(rank, value): null on all ranks but the root."""
        value = send_buf.where("pos = 0").agg(reduced(as_op(op), send_buf.schema["value"].dataType).alias("value"))
        root = self._rank(self.root if root is None else root)
        return fan_out(value, self.size).select("rank", F.when(F.col("rank") == root, F.col("value")).alias("value"))

    def allreduce(self, *, send_buf: DataFrame, op: str | Op, send_recv_count: int | None = None, recv_buf: DataFrame | None = None, resize: str = "resize_to_fit"):
        return self._finish(fan_out(self._reduce(send_buf, op, send_recv_count), self.size), recv_buf, resize)

    def allreduce_inplace(self, *, send_recv_buf: DataFrame, op: str | Op, send_recv_count: int | None = None):
        """With send_recv_count only that prefix is reduced, and the tail stays."""
        new = self.allreduce(send_buf=send_recv_buf, op=op, send_recv_count=send_recv_count)
        return new if send_recv_count is None else new.unionByName(send_recv_buf.where(F.col("pos") >= send_recv_count).select("rank", "pos", "value"))

    def allreduce_single(self, *, send_buf: DataFrame, op: str | Op):
        return self.allreduce(send_buf=send_buf.where("pos = 0"), op=op)

    def _scan(self, buf: DataFrame, op, count: int | None, inclusive: bool) -> DataFrame:
        of, kind = as_op(op), buf.schema["value"].dataType
        of.check(kind)
        rows = buf if count is None else buf.where(F.col("pos") < count)
        w = Window.partitionBy("pos").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        if of.agg:
            if of.name == "multiplies" and kind.simpleString() not in ("float", "double"):
                lists = F.collect_list("value").over(w)  # whole numbers are multiplied exactly: p values an element
                return rows.withColumn("value", F.aggregate(lists, F.lit(1).cast(kind), lambda a, x: (a * x).cast(kind)))
            return rows.withColumn("value", of.post(of.agg(F.col("value"), kind).over(w), kind))
        # One pass over a position's ranks, keeping every partial result: p values an element.
        lists = rows.groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("xs"))
        step = lambda acc, x: F.concat(acc, F.array(of.fold(F.element_at(acc, -1), x["value"]).cast(kind)))
        partial = F.aggregate(F.slice("xs", 2, F.size("xs")), F.array(F.element_at("xs", 1)["value"]), step)
        out = lists.select("pos", F.transform("xs", lambda x: x["rank"]).alias("ranks"), partial.alias("values"))
        if not inclusive:
            out = out.withColumn("values", F.concat(F.array(F.lit(None).cast(kind)), F.slice("values", 1, F.size("values") - 1)))
        return out.select("pos", F.inline(F.arrays_zip("ranks", "values"))).select(F.col("ranks").alias("rank"), "pos", F.col("values").alias("value"))

    def scan(self, *, send_buf: DataFrame, op: str | Op, send_recv_count: int | None = None, recv_buf: DataFrame | None = None, resize: str = "resize_to_fit"):
        """Inclusive prefix over the ranks, element by element."""
        return self._finish(self._scan(send_buf, op, send_recv_count, True), recv_buf, resize)

    def scan_inplace(self, *, send_recv_buf: DataFrame, op: str | Op, send_recv_count: int | None = None):
        return self.scan(send_buf=send_recv_buf, op=op, send_recv_count=send_recv_count)

    def scan_single(self, *, send_buf: DataFrame, op: str | Op):
        return self.scan(send_buf=send_buf.where("pos = 0"), op=op)

    def exscan(self, *, send_buf: DataFrame, op: str | Op, values_on_rank_0=None, send_recv_count: int | None = None, recv_buf: DataFrame | None = None, resize: str = "resize_to_fit"):
        """Exclusive prefix. Rank 0 gets values_on_rank_0 (one value or one an element), else the identity, else null."""
        of, kind = as_op(op), send_buf.schema["value"].dataType
        out = self._scan(send_buf, of, send_recv_count, False)
        if values_on_rank_0 is None:
            first = of.identity_of(kind)
        elif isinstance(values_on_rank_0, (list, tuple)):
            given = F.array(*(F.lit(v).cast(kind) for v in values_on_rank_0))
            first = F.get(given, F.col("pos").cast("int"))
        else:
            first = F.lit(values_on_rank_0).cast(kind)
        return self._finish(out.withColumn("value", F.when(F.col("rank") == 0, first).otherwise(F.col("value"))), recv_buf, resize)

    def exscan_inplace(self, *, send_recv_buf: DataFrame, op: str | Op, values_on_rank_0=None, send_recv_count: int | None = None):
        return self.exscan(send_buf=send_recv_buf, op=op, values_on_rank_0=values_on_rank_0, send_recv_count=send_recv_count)

    def exscan_single(self, *, send_buf: DataFrame, op: str | Op, values_on_rank_0=None):
        return self.exscan(send_buf=send_buf.where("pos = 0"), op=op, values_on_rank_0=values_on_rank_0)

    def is_same_on_all_ranks(self, values: DataFrame) -> DataFrame:
        """One row (same boolean) for (rank, value): all values equal; NaN and null equal nothing, unless there is one rank."""
        odd = F.count_if(F.col("value").isNull())
        if values.schema["value"].dataType.simpleString() in ("float", "double"):
            odd = F.count_if(F.col("value").isNull() | F.isnan("value"))
        same = (F.count_distinct("value") == 1) & (odd == 0) & (F.count("*") == self.size)
        return values.agg((same | (F.lit(self.size) == 1)).alias("same"))

    def num_numa_nodes(self, hosts: DataFrame) -> DataFrame:
        """One row (nodes long): the shared-memory domains in (rank, host)."""
        return hosts.agg(F.count_distinct("host").alias("nodes"))
