"""Composite algorithms: breadth-first levels, suffix arrays by prefix doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringfold.operators.buffer import checkpointed

#: Rounds of a loop between two checkpoints.
EVERY = 4


def bfs_levels(edges: DataFrame, source: int, max_levels: int = 10_000) -> DataFrame:
    """(vertex, level) of the vertices that edges (src, dst) lead to from source.

    Each round joins the frontier with the edges, dealt by src once, and drops what was seen.
    """
    spark = edges.sparkSession
    edges = checkpointed(edges.select("src", "dst").distinct().repartition("src"))
    seen = spark.createDataFrame([(source, 0)], "vertex long, level int")
    frontier = seen
    for level in range(1, max_levels + 1):
        step = frontier.join(edges, frontier["vertex"] == edges["src"]).select(F.col("dst").alias("vertex")).distinct()
        frontier = checkpointed(step.join(seen.select("vertex"), "vertex", "left_anti").withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
        if level % EVERY == 0:
            seen = checkpointed(seen)
    raise RuntimeError(f"there are vertices beyond level {max_levels - 1}: max_levels is too small")


def suffix_array(chars: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(slot, start): the starts of all suffixes of (pos, ch) in order, by prefix doubling.

    The rank of a prefix is how many are strictly smaller; past the end stands -1, below every rank.
    """
    counts = chars.groupBy("ch").agg(F.count("*").alias("n"))  # a row a character
    before = counts.withColumn("r", F.coalesce(F.sum("n").over(Window.orderBy("ch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranks = checkpointed(chars.join(before.select("ch", "r"), "ch").select("pos", "r"))
    k = 1
    for _ in range(max_rounds):
        distinct = ranks.select("r").distinct().count()
        if distinct == ranks.count():
            break
        ahead = ranks.select((F.col("pos") - k).alias("pos"), F.col("r").alias("r2"))
        pairs = ranks.join(ahead, "pos", "left").withColumn("r2", F.coalesce("r2", F.lit(-1)))
        # Suffixes of one old rank are told apart by r2 among themselves: no sort of all rows in one task.
        inner = F.rank().over(Window.partitionBy("r").orderBy("r2")) - 1
        ranks = checkpointed(pairs.select("pos", (F.col("r") + inner).cast("long").alias("r")))
        k *= 2
    return ranks.select(F.col("r").cast("long").alias("slot"), F.col("pos").alias("start"))


def globally_sorted(buf: DataFrame) -> DataFrame:
    """(is_sorted) of (rank, pos, value): within each rank, and each rank up to the next, which a row a rank shows."""
    before = F.lag("value").over(Window.partitionBy("rank").orderBy("pos"))
    within = buf.withColumn("ok", F.coalesce(F.col("value") >= before, F.lit(True))).groupBy("rank").agg(F.bool_and("ok").alias("ok"), F.min("value").alias("a"), F.max("value").alias("b"))
    edge = F.coalesce(F.col("a") >= F.lag("b").over(Window.orderBy("rank")), F.lit(True))
    return within.withColumn("ok", F.col("ok") & edge).agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("is_sorted"))
