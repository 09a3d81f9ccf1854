"""Components of links: what a task holds by union-find, the rest by stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import met, planned_once, written

#: Links that one task joins by itself (16 bytes each): a bound, whatever the input.
LINKS_A_TASK = 1 << 20


class Forest:
    """Links between rows, reduced to one link a row again and again."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.kept: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.kept.append((a, b))
        self.size += len(a)
        if self.size > 2_000_000:
            self.reduce()

    def reduce(self) -> np.ndarray:
        if self.kept:
            a, b = (np.concatenate(x) for x in zip(*self.kept, strict=True))
            root = self.root
            while len(a):
                ra, rb = root[a], root[b]
                apart = ra != rb
                a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
                np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
                while (root != (up := root[root])).any():
                    root = up
            self.root, self.kept, self.size = root, [], 0
        return self.root


def _joined(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Stars that join the same nodes as the links do, of up to about `most` links at once."""
    held: list[pa.RecordBatch] = []

    def stars() -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1))
        held.clear()
        node, at = np.unique(np.r_[u, v], return_inverse=True)
        forest = Forest(len(node))
        forest.add(at[: len(u)], at[len(u) :])
        root = forest.reduce()
        below = np.flatnonzero(root != np.arange(len(node)))
        return pa.record_batch([pa.array(node[below]), pa.array(node[root[below]])], ["u", "v"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) > most:
            yield stars()
    if held:
        yield stars()


def components(edges: DataFrame, rounds: int = 60, links_a_task: int = LINKS_A_TASK) -> DataFrame:
    """(node, component long) of all nodes that are not the smallest of their component; edges: (a, b long).

    Each task first makes stars of its links, `links_a_task` of them at most. If one task had all, these are the components.
    Else large and small stars alternate: each node hangs its larger neighbours, then its smaller ones, to the smallest of
    them. Every step is a join and an aggregate, written to the shared folder; nothing is gathered on the driver, and the
    centre of a large star is no hot key (see met).
    """
    pairs = lambda u, v: F.array(F.struct(u.alias("u"), v.alias("v")))
    links = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    named = lambda stars: stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    n = links.count()
    tasks = -(-n // links_a_task)
    stars = written(links.coalesce(max(tasks, 1)).mapInArrow(lambda batches: _joined(batches, max(n, 1) if tasks <= 1 else links_a_task), "u long, v long"), "stars")
    if tasks <= 1:
        return named(stars)
    with planned_once(stars.sparkSession):
        seen, n = None, stars.count()
        for _ in range(rounds):
            both = stars.select(F.explode(F.concat(pairs(F.col("u"), F.col("v")), pairs(F.col("v"), F.col("u")))).alias("x")).select("x.*")
            least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("copies"))
            large = met(both.where("v > u"), least, "u", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("copies"))
            small = met(large, least, "u", n).select(F.explode(F.concat(pairs(F.col("v"), F.col("m")), pairs(F.col("u"), F.col("m")))).alias("x")).select("x.*").where("u <> v").distinct()
            stars = written(small, "stars")
            now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if now == seen:
                return named(stars)
            seen, n = now, now[0]
    raise RuntimeError(f"components did not settle in {rounds} rounds")
