"""Approximate nearest neighbours by largest inner product, in a robust-pruned directed graph for each shard.

Vectors are dealt to shards by a hash of their id. Within a shard the inner product becomes a distance by one more component
that gives all vectors the same length. Points join the graph in growing batches: a greedy search over the graph so far
proposes neighbours, and pruning keeps the nearest and drops those that a kept neighbour is `alpha` times nearer to, so that
edges point in diverse directions; reverse edges are added and pruned likewise. All rows go over the graph twice. Each query
then searches each shard by beam, and the shards' answers are merged by exact score.

Shards stream: a task gets a shard's vectors first and then the queries in batches, so it never holds all queries. Equal vectors
are one point with their smallest ids, as only these can be among the nearest. As each query visits each shard, shards grow with
the input (with its square root, from a million rows on), up to what a task can hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS, DEGREE, BEAM, BUILD_BEAM, ALPHA, PASSES = 16_384, 32, 96, 56, 1.2, 2
QUERIES_AT_ONCE, INSERT_AT_ONCE = 512, 512
MOST_SHARD_ROWS = 1 << 20


def rows_a_shard(rows: int) -> int:
    return max(SHARD_ROWS, min(MOST_SHARD_ROWS, int((rows * 256) ** 0.5)))


def _known(rows: np.ndarray, inner: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Which of `more` (per row) are in `inner` already, or are repeated in `more`, or are no point (-1)."""
    both = np.concatenate([inner, more], axis=1)
    order = np.argsort(both, axis=1, kind="stable")
    ranked = np.take_along_axis(both, order, 1)
    again = np.zeros_like(ranked, dtype=bool)
    again[:, 1:] = ranked[:, 1:] == ranked[:, :-1]
    out = np.empty_like(again)
    np.put_along_axis(out, order, again, 1)
    return out[:, inner.shape[1] :] | (more < 0)


class Graph:
    """A graph over the rows of `vectors` (double)."""

    def __init__(self, vectors: np.ndarray, degree: int = DEGREE, build_beam: int = BUILD_BEAM, alpha: float = ALPHA, passes: int = PASSES, seed: int = 3):
        self.vectors, self.degree, self.alpha = vectors, degree, alpha
        norms = (vectors**2).sum(axis=1)
        self.points = np.concatenate([vectors, np.sqrt(np.maximum(norms.max(initial=0) - norms, 0))[:, None]], axis=1)
        n = len(vectors)
        self.edges = np.full((n, degree), -1, np.int32)
        if n < 2:
            self.entry = 0
            return
        self.entry = int(((self.points - self.points.mean(axis=0)) ** 2).sum(axis=1).argmin())
        order = np.random.default_rng(seed).permutation(n)
        order = np.r_[self.entry, order[order != self.entry]]
        for round_ in range(passes):
            at, size = (1, 1) if round_ == 0 else (0, INSERT_AT_ONCE)
            while at < n:
                self._insert(order[at : at + size], build_beam, 1.0 if round_ < passes - 1 else alpha)
                at += size
                size = min(2 * size, INSERT_AT_ONCE)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The `beam` nearest points that a beam search visits for each row of queries, nearest first (-1: no more), and distances.

        Queries have the points' components; distances are squared.
        """
        m = len(queries)
        ids = np.full((m, beam), -1, np.int32)
        far = np.full((m, beam), np.inf)
        ids[:, 0] = self.entry
        far[:, 0] = ((queries - self.points[self.entry]) ** 2).sum(axis=1)
        open_ = np.zeros((m, beam), bool)
        open_[:, 0] = True
        live = np.arange(m)
        while len(live):
            k = open_[live].argmax(axis=1)
            todo = open_[live, k]
            live, k = live[todo], k[todo]
            if not len(live):
                break
            open_[live, k] = False
            near = self.edges[ids[live, k]]
            old = _known(live, ids[live], near)
            d = ((self.points[np.maximum(near, 0)] - queries[live][:, None]) ** 2).sum(axis=2)
            d[old] = np.inf
            all_ids = np.concatenate([ids[live], np.where(old, -1, near)], axis=1)
            all_far = np.concatenate([far[live], d], axis=1)
            all_open = np.concatenate([open_[live], ~old], axis=1)
            best = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
            ids[live], far[live], open_[live] = (np.take_along_axis(x, best, 1) for x in (all_ids, all_far, all_open))
            open_[live] &= np.isfinite(far[live])
        return ids, far

    def _prune(self, of: np.ndarray, candidates: np.ndarray, alpha: float) -> np.ndarray:
        """For each point in `of`, the candidates (nearest first kept) that no kept one is alpha times nearer to."""
        bad = _known(of, of[:, None].astype(np.int32), candidates)
        d = ((self.points[np.maximum(candidates, 0)] - self.points[of][:, None]) ** 2).sum(axis=2)
        d[bad] = np.inf
        order = np.argsort(d, axis=1, kind="stable")
        candidates, d = np.take_along_axis(candidates, order, 1), np.take_along_axis(d, order, 1)
        rows, kept = np.arange(len(of)), np.full((len(of), self.degree), -1, np.int32)
        position = self.points[np.maximum(candidates, 0)]
        for k in range(self.degree):
            pick = d.argmin(axis=1)
            ok = np.isfinite(d[rows, pick])
            if not ok.any():
                break
            kept[ok, k] = candidates[rows, pick][ok]
            between = ((position - position[rows, pick][:, None]) ** 2).sum(axis=2)
            d[(alpha * alpha * between <= d) & ok[:, None]] = np.inf
            d[rows, pick] = np.inf
        return kept

    def _insert(self, batch: np.ndarray, beam: int, alpha: float) -> None:
        found, _ = self.search(self.points[batch], beam)
        self.edges[batch] = self._prune(batch, np.concatenate([found, self.edges[batch]], axis=1), alpha)
        source = np.repeat(batch, self.degree)
        target = self.edges[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.lexsort((source, target))
        source, target = source[order], target[order]
        starts = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
        n = np.diff(np.r_[starts, len(target)])
        who = target[starts]
        for part in np.array_split(np.arange(len(who)), max(1, len(who) // INSERT_AT_ONCE)):
            width = int(n[part].max(initial=0))
            new = np.full((len(part), width), -1, np.int32)
            column = np.arange(n[part].sum()) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
            new[np.repeat(np.arange(len(part)), n[part]), column] = source[np.repeat(starts[part], n[part]) + column]
            self._link(who[part], new, alpha)

    def _link(self, who: np.ndarray, new: np.ndarray, alpha: float) -> None:
        """Adds edges; where they don't fit the degree, prunes."""
        old = self.edges[who]
        new = np.where(_known(who, old, new), -1, new)
        have, more = (old >= 0).sum(axis=1), (new >= 0).sum(axis=1)
        fits = have + more <= self.degree
        both = np.concatenate([old[fits], new[fits]], axis=1)
        self.edges[who[fits]] = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)[:, : self.degree]
        if (~fits).any():
            self.edges[who[~fits]] = self._prune(who[~fits], np.concatenate([old[~fits], new[~fits]], axis=1), alpha)

    def nearest(self, queries: np.ndarray, k: int, beam: int = BEAM) -> np.ndarray:
        """For each row of queries (of the vectors' components) up to k points, by largest inner product (-1: no more)."""
        ids, _ = self.search(np.concatenate([queries, np.zeros((len(queries), 1))], axis=1), max(beam, k))
        return ids[:, :k]


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double; the same pair of vectors always gives the same number."""
    return (a.astype(np.float64) * b.astype(np.float64)).sum(axis=-1)


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int | None = None,
    degree: int = DEGREE, beam: int = BEAM, build_beam: int = BUILD_BEAM, alpha: float = ALPHA,
) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): each query's k nearest of the other rows found, ties to the smaller id.

    Every row of `vectors` is a candidate, and every row of `queries` is a query, also where ids or whole rows repeat; a
    query's own row, one of its id and vector, is not among its answers. Vectors that are null, all zero, of another length
    than most, or hold a null, NaN or infinity take no part, as do null ids; such a query has no rows.
    """
    def sound(df: DataFrame) -> DataFrame:
        """(id, v, times) of the distinct rows."""
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
        rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
        return rows.groupBy("id", "v").agg(F.count("*").alias("times"))

    every, asked = sound(vectors), sound(queries)
    sizes = every.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, rows = sizes["n"], sizes["count"]
    shards = -(-rows // (shard_rows or rows_a_shard(rows)))
    turn = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = every.where(F.size("v") == width).withColumn("turn", turn).where(F.col("turn") <= k + 1)
    members = few.select(F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "id", "v", "times")
    asks = asked.where(F.size("v") == width).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "id", "v", "times")
    dealt = members.unionByName(asks).repartitionById(shards, "shard").sortWithinPartitions("shard", "asks", "id")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, graph, ids, values, heads = None, None, [], [], None
        for b in batches:
            of, asks = b.column(0).to_numpy(), np.asarray(b.column(1))
            for part in np.split(np.arange(b.num_rows), np.flatnonzero((np.diff(of) != 0) | np.diff(asks)) + 1):
                if not len(part):
                    continue
                if of[part[0]] != shard:
                    shard, graph, ids, values = of[part[0]], None, [], []
                here = b.slice(part[0], len(part))
                own = here.column(2).to_numpy()
                x = here.column(3).flatten().to_numpy().reshape(-1, width)
                times = here.column(4).to_numpy()
                if not asks[part[0]]:
                    n = np.minimum(times, k + 1)
                    ids.append(np.repeat(own, n))
                    values.append(np.repeat(x, n, axis=0))
                    continue
                if graph is None and ids:
                    id_of, rows = np.concatenate(ids), np.concatenate(values)
                    order = np.lexsort((id_of, *rows.T[::-1]))
                    id_of, rows = id_of[order], rows[order]
                    heads = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)])
                    copies = np.diff(np.r_[heads, len(rows)])
                    graph = Graph(rows[heads], degree, build_beam, alpha)
                if graph is None:
                    continue
                for a in range(0, len(own), QUERIES_AT_ONCE):
                    yield from _answers(graph, id_of, heads, copies, own[a : a + QUERIES_AT_ONCE], x[a : a + QUERIES_AT_ONCE], times[a : a + QUERIES_AT_ONCE], k, beam)

    # A query is told by its id and (a hash of) its vector.
    found = dealt.mapInArrow(each, "query_id long, told long, times long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("query_id", "told").orderBy(F.desc("score"), "vec_id"))
    found = found.withColumn("rank", best).where(F.col("rank") <= k)
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("query_id", "rank", "vec_id", "score")


def _answers(graph: Graph, id_of, heads, copies, own, x, times, k, beam) -> Iterator[pa.RecordBatch]:
    points = graph.nearest(x, k + 1, beam)
    row, column = np.nonzero(points >= 0)
    point = points[row, column]
    n = np.minimum(copies[point], k + 1)
    at = np.repeat(heads[point], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    score = np.repeat(exact_scores(x[row], graph.vectors[point]), n)
    alike = np.repeat((x[row] == graph.vectors[point]).all(axis=1), n)
    row, other = np.repeat(row, n), id_of[at]
    order = np.lexsort((other, -score, row))
    row, other, score, alike = row[order], other[order], score[order], alike[order]
    itself = np.flatnonzero(alike & (own[row] == other))
    itself = itself[np.unique(row[itself], return_index=True)[1]]  # one row of the query's id and vector
    row, other, score = (np.delete(c, itself) for c in (row, other, score))
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, int)
    nth = np.arange(len(row)) - np.repeat(starts, np.diff(np.r_[starts, len(row)]))
    top = nth < k
    row = row[top]
    told = np.array([int.from_bytes(hashlib.blake2b(v.tobytes(), digest_size=8).digest(), "little", signed=True) for v in x], np.int64)
    yield pa.record_batch([pa.array(own[row]), pa.array(told[row]), pa.array(times[row]), pa.array(other[top]), pa.array(score[top])], ["query_id", "told", "times", "vec_id", "score"])


def query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
