"""Communication graphs and the exchange with neighbours; edges are (rank, ord, peer[, weight])."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .buffer import small
from .communicator import _div


def edges(spark: SparkSession, neighbours: Mapping[int, Sequence]) -> DataFrame:
    """From each rank's list of neighbours, or of (neighbour, weight); a neighbour may be listed several times."""
    rows = [(r, k, *(x if isinstance(x, tuple) else (x, None))) for r, own in neighbours.items() for k, x in enumerate(own)]
    return spark.createDataFrame(rows, "rank int, ord int, peer int, weight int")


class Topology:
    """A communicator's graph: out- and in-edges."""

    def __init__(self, comm, out_edges: DataFrame, in_edges: DataFrame | None = None):
        """Without in_edges the graph is symmetric: each rank's in-neighbours are its out-neighbours."""
        self.comm, self.out_edges = comm, out_edges
        self.in_edges = out_edges if in_edges is None else in_edges

    @classmethod
    def from_out_edges(cls, comm, out_edges: DataFrame) -> Topology:
        """In-edges are the out-edges seen from the other end, by source and the source's order."""
        w = Window.partitionBy("peer").orderBy("rank", "ord")
        back = out_edges.withColumn("new", F.row_number().over(w) - 1).select(F.col("peer").alias("rank"), F.col("new").alias("ord"), F.col("rank").alias("peer"), *(["weight"] if "weight" in out_edges.columns else []))
        return cls(comm, out_edges, back)

    def is_weighted(self) -> bool:
        return "weight" in self.out_edges.columns and self.out_edges.where("weight is not null").limit(1).count() > 0

    def _degree(self, e: DataFrame, name: str) -> DataFrame:
        found = e.groupBy("rank").agg(F.count("*").alias(name))
        return self.comm.ranks.join(found, "rank", "left").select("rank", F.coalesce(name, F.lit(0)).alias(name))

    def out_degree(self) -> DataFrame:
        return self._degree(self.out_edges, "out_degree")

    def in_degree(self) -> DataFrame:
        return self._degree(self.in_edges, "in_degree")

    def rank_to_out_neighbor_index(self) -> DataFrame:
        """(rank, peer, index): the first place of each neighbour."""
        return self.out_edges.groupBy("rank", "peer").agg(F.min("ord").alias("index"))

    def neighbor_alltoall(self, *, send_buf: DataFrame, send_count: int | None = None) -> DataFrame:
        """Block i of a rank goes to its i-th out-neighbour; block j comes from its j-th in-neighbour.

        The k-th of parallel out-edges meets the k-th of the parallel in-edges. Without send_count a block is the
        buffer's size divided by the out-degree, which must divide it.
        """
        k = lambda e: e.withColumn("k", F.row_number().over(Window.partitionBy("rank", "peer").orderBy("ord")))
        outs = k(self.out_edges).select(F.col("rank").alias("src"), F.col("peer").alias("dst"), "k", F.col("ord").alias("out_ord"))
        ins = k(self.in_edges).select(F.col("rank").alias("dst"), F.col("peer").alias("src"), "k", F.col("ord").alias("in_ord"))
        n = self.comm.size * self.comm.size
        route = outs.join(ins, ["src", "dst", "k"]).select(F.col("src").alias("rank"), "out_ord", "dst", "in_ord")
        if send_count is None:
            sizes = send_buf.groupBy("rank").agg(F.count("*").alias("n")).join(self.out_degree(), "rank")
            odd = F.raise_error(F.lit("the buffer's size is no multiple of the out-degree")).cast("long")
            block = F.when(F.col("out_degree") == 0, 0).when(F.col("n") % F.col("out_degree") == 0, _div(F.col("n"), F.col("out_degree"))).otherwise(odd)
            sent = send_buf.join(small(sizes.select("rank", block.alias("c")), self.comm.size), "rank").where("c > 0")
        else:
            sent = send_buf.withColumn("c", F.lit(send_count).cast("long"))
        at = sent.withColumn("out_ord", _div(F.col("pos"), F.col("c")).cast("int")).join(small(route, n), ["rank", "out_ord"])
        return at.select(F.col("dst").alias("rank"), (F.col("in_ord") * F.col("c") + F.col("pos") % F.col("c")).alias("pos"), "value")
