"""Groups of ranks, sub-communicators, rank ranges: relations (ord, world_rank) or (color, rank, world_rank)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

IDENTICAL, CONGRUENT, SIMILAR, UNEQUAL = "identical", "congruent", "similar", "unequal"


@dataclass(frozen=True)
class RankRange:
    """first..last in steps of stride, both ends included."""

    first: int
    last: int
    stride: int = 1

    def contains(self, rank: Column) -> Column:
        low, high = min(self.first, self.last), max(self.first, self.last)
        return rank.between(low, high) & ((rank - self.first) % self.stride == 0)

    def ranks(self) -> list[int]:
        return list(range(self.first, self.last + (1 if self.stride > 0 else -1), self.stride))

    @property
    def size(self) -> int:
        return len(self.ranks())


def any_contains(ranges: Sequence[RankRange], rank: Column) -> Column:
    out = F.lit(False)
    for r in ranges:
        out = out | r.contains(rank)
    return out


class Group:
    """An ordered set of world ranks."""

    def __init__(self, members: DataFrame):
        self.members = members.select(F.col("ord").cast("int"), F.col("world_rank").cast("int"))

    @classmethod
    def of(cls, spark: SparkSession, ranks: Sequence[int]) -> Group:
        return cls(spark.createDataFrame(list(enumerate(ranks)), "ord int, world_rank int"))

    def _numbered(self, df: DataFrame, *order: str) -> Group:
        # Groups have a row a rank: one window over them all is as small as the communicator.
        return Group(df.withColumn("ord", F.row_number().over(Window.orderBy(*order)) - 1))

    def difference(self, other: Group) -> Group:
        return self._numbered(self.members.join(other.members.select("world_rank"), "world_rank", "left_anti"), "ord")

    def intersection(self, other: Group) -> Group:
        return self._numbered(self.members.join(other.members.select("world_rank"), "world_rank", "left_semi"), "ord")

    def set_union(self, other: Group) -> Group:
        """This group's order, then the other's new members in theirs."""
        new = other.members.join(self.members.select("world_rank"), "world_rank", "left_anti")
        both = self.members.withColumn("part", F.lit(0)).unionByName(new.withColumn("part", F.lit(1)))
        return self._numbered(both, "part", "ord")

    def size(self) -> DataFrame:
        return self.members.agg(F.count("*").alias("size"))

    def translate_ranks_to(self, other: Group) -> DataFrame:
        """(rank, other_rank); null where the other group lacks the rank."""
        theirs = other.members.select("world_rank", F.col("ord").alias("other_rank"))
        return self.members.join(theirs, "world_rank", "left").select(F.col("ord").alias("rank"), "other_rank")

    def compare(self, other: Group) -> DataFrame:
        """One row: identical (same ranks in the same order), similar (same ranks) or unequal."""
        both = self.members.join(other.members.select("world_rank", F.col("ord").alias("other")), "world_rank", "full_outer")
        same = F.coalesce(F.bool_and(F.col("ord").isNotNull() & F.col("other").isNotNull()), F.lit(True))
        order = F.coalesce(F.bool_and(F.coalesce(F.col("ord") == F.col("other"), F.lit(False))), F.lit(True))
        return both.agg(F.when(same & order, IDENTICAL).when(same, SIMILAR).otherwise(UNEQUAL).alias("result"))

    def is_identical(self, other: Group) -> DataFrame:
        return self.compare(other).select((F.col("result") == IDENTICAL).alias("result"))

    def has_same_ranks(self, other: Group) -> DataFrame:
        return self.compare(other).select((F.col("result") != UNEQUAL).alias("result"))


class Communicators:
    """G02-G08 on a Communicator."""

    def split(self, *, colors: DataFrame) -> DataFrame:
        """(color, rank, world_rank) of (rank, color[, key]): within a color by key, then by old rank."""
        key = F.col("key") if "key" in colors.columns else F.lit(0)
        w = Window.partitionBy("color").orderBy(key, F.col("rank"))
        return colors.select("color", (F.row_number().over(w) - 1).alias("new"), F.col("rank").alias("world_rank")).withColumnRenamed("new", "rank")

    def split_to_shared_memory(self, *, hosts: DataFrame) -> DataFrame:
        """split by the column host of (rank, host)."""
        return self.split(colors=hosts.withColumnRenamed("host", "color"))

    def create_subcommunicators(self, *, ranks: Sequence[int] | None = None, ranges: Sequence[RankRange] | None = None) -> DataFrame:
        """(rank, world_rank) in the listed order; ranks must be valid and not repeat."""
        if (ranks is None) == (ranges is None):
            raise TypeError("give ranks or ranges")
        listed = list(ranks) if ranks is not None else [r for x in ranges for r in x.ranks()]
        if len(set(listed)) != len(listed) or not all(self.is_valid_rank(r) for r in listed):
            raise ValueError("the ranks repeat or are not of this communicator")
        return self.spark.createDataFrame(list(enumerate(listed)), "rank int, world_rank int")

    def group(self) -> Group:
        return Group(self.ranks.select(F.col("rank").alias("ord"), F.col("rank").alias("world_rank")))

    def compare(self, mine: DataFrame, other: DataFrame) -> DataFrame:
        """identical, congruent, similar or unequal for two member relations (rank, world_rank)."""
        as_group = lambda d: Group(d.select(F.col("rank").alias("ord"), "world_rank"))
        found = as_group(mine).compare(as_group(other))
        return found if mine is other else found.select(F.when(F.col("result") == IDENTICAL, CONGRUENT).otherwise(F.col("result")).alias("result"))

    def convert_rank(self, source: DataFrame, target: DataFrame) -> DataFrame:
        """(rank, other_rank) between two member relations (rank, world_rank)."""
        theirs = target.select("world_rank", F.col("rank").alias("other_rank"))
        return source.join(theirs, "world_rank", "left").select("rank", "other_rank")

    def rank_shifted_cyclic(self, rank: Column, distance: int) -> Column:
        return F.pmod(rank + distance, F.lit(self.size))

    def rank_shifted_checked(self, rank: Column, distance: int) -> Column:
        """An error, when computed, for a rank outside."""
        to = rank + distance
        return F.when(to.between(0, self.size - 1), to).otherwise(F.raise_error(F.lit("the shifted rank is outside the communicator")).cast("int"))
