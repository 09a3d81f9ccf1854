"""Point-to-point messages as a log (src, dest, tag, seq, payload array); the n-th send meets the n-th matching receive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ANY, NULL_RANK = -1, -2
MODES = ("standard", "buffered", "synchronous", "ready")


class PointToPoint:
    """P01-P15, P20 on a Communicator."""

    def send(self, *, send_buf: DataFrame, destination: Column | int | None, log: DataFrame | None = None, send_count: int | None = None, tag: int | None = None, send_mode: str = "standard", seq: int = 0) -> DataFrame:
        """The log with one more message a rank: its buffer, in order. destination None: nothing is sent."""
        if send_mode not in MODES:
            raise TypeError(f"unknown send mode {send_mode!r}")
        rows = send_buf if send_count is None else send_buf.where(F.col("pos") < send_count)
        one = rows.groupBy("rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("payload"))
        to = F.lit(NULL_RANK) if destination is None else destination if isinstance(destination, Column) else F.lit(destination)
        new = one.select(F.col("rank").alias("src"), to.cast("int").alias("dest"), F.lit(self._tag(self.default_tag if tag is None else tag)).alias("tag"), F.lit(seq).cast("long").alias("seq"), "payload", F.lit(send_mode).alias("mode")).where(F.col("dest") != NULL_RANK)
        return new if log is None else log.unionByName(new, allowMissingColumns=True)

    def bsend(self, **args) -> DataFrame:
        return self.send(send_mode="buffered", **args)

    def ssend(self, **args) -> DataFrame:
        return self.send(send_mode="synchronous", **args)

    def rsend(self, **args) -> DataFrame:
        return self.send(send_mode="ready", **args)

    def _waiting(self, log: DataFrame, source: int, tag: int) -> DataFrame:
        """Each rank's first message that matches; among several sources the earliest seq, then the smallest source."""
        rows = log
        if source != ANY:
            rows = rows.where(F.col("src") == self._rank(source))
        if tag != ANY:
            rows = rows.where(F.col("tag") == tag)
        w = Window.partitionBy("dest").orderBy("seq", "src", "tag")
        return rows.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")

    def recv(self, *, log: DataFrame, source: int | None = ANY, tag: int = ANY, recv_count: int | None = None) -> DataFrame:
        """(rank, pos, value, source, tag, count) of each rank's first matching message; source None receives nothing."""
        found = self._waiting(log, ANY if source is None else source, tag)
        if source is None:
            found = found.where(F.lit(False))
        payload = F.col("payload") if recv_count is None else F.when(F.size("payload") <= recv_count, F.col("payload")).otherwise(F.raise_error(F.lit("the message is longer than recv_count")))
        return found.select(F.col("dest").alias("rank"), F.posexplode(payload).alias("pos", "value"), F.col("src").alias("source"), "tag", F.size("payload").alias("count")).withColumn("pos", F.col("pos").cast("long"))

    def recv_single(self, *, log: DataFrame, source: int = ANY, tag: int = ANY) -> DataFrame:
        if source is None:
            raise TypeError("a single value can't be received from no rank")
        return self.recv(log=log, source=source, tag=tag).where("pos = 0").select("rank", "value")

    def try_recv(self, *, log: DataFrame, source: int = ANY, tag: int = ANY) -> DataFrame:
        """(rank, payload, source, tag) for every rank; null where no message matches."""
        found = self._waiting(log, source, tag).select(F.col("dest").alias("rank"), "payload", F.col("src").alias("source"), "tag")
        return self.ranks.join(found, "rank", "left")

    def probe(self, *, log: DataFrame, source: int = ANY, tag: int = ANY) -> DataFrame:
        """(rank, source, tag, count) of what recv would get."""
        return self._waiting(log, source, tag).select(F.col("dest").alias("rank"), F.col("src").alias("source"), "tag", F.size("payload").alias("count"))

    def iprobe(self, *, log: DataFrame, source: int = ANY, tag: int = ANY) -> DataFrame:
        """(rank, found)."""
        return self.try_recv(log=log, source=source, tag=tag).select("rank", F.col("source").isNotNull().alias("found"))

    def match(self, *, sends: DataFrame, receives: DataFrame) -> DataFrame:
        """sends (src, dest, tag, seq, ...) with receives (src, dest, tag, seq): the n-th of each (src, dest, tag) meet.

        Columns of sends, and recv_seq.
        """
        nth = lambda d: d.withColumn("n", F.row_number().over(Window.partitionBy("src", "dest", "tag").orderBy("seq")))
        wanted = nth(receives).select("src", "dest", "tag", "n", F.col("seq").alias("recv_seq"))
        return nth(sends).join(wanted, ["src", "dest", "tag", "n"]).drop("n")

    def sendrecv(self, *, send_buf: DataFrame, destination: Column | int) -> DataFrame:
        """Each rank's buffer at the rank that `destination`, an expression of rank, names: a projection."""
        to = destination if isinstance(destination, Column) else F.lit(destination)
        return send_buf.select(to.cast("int").alias("rank"), "pos", "value", F.col("rank").alias("source"))
