"""A hidden Markov language model over word classes, with word counts of the whole corpus.

Each word belongs to a class given by its length and its last letters; the end of a text is a class of its own. The states
emit classes, a class emits its words: P(word | class) = (c + 1) / (N_class + V_class + 1), where the last 1 stands for all
words not seen. Baum-Welch trains the states on the whole class sequences of all training texts: each task returns its
expected counts, which are summed. The scaled forward recursion then gives the exact probability of every whole text.

Word counts are joined by blocks of documents: a block sends its distinct words (as 64-bit hashes) once, and gets back how
often the training texts of other blocks have them. So what is shuffled follows the blocks' vocabularies, not their tokens,
and no task holds the vocabulary of the corpus. Two words with the same hash would share their count (chance n**2 / 2**65).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, chunks, mix, written
from .substring_dedup import squeezed, swelled

STATES, CLASSES, END_CLASS, STEPS = 8, 256, 255, 6
BLOCK_BYTES = 12 << 20
#: Tokens whose forward vectors Baum-Welch holds at once; those of longer batches are computed again, piece by piece.
HELD = 1 << 21
END_HASH = np.uint64(0x5BD1E995A5A5A5A5)


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # state, class

    @classmethod
    def random(cls, seed: int = 7) -> Hmm:
        rng = np.random.default_rng(seed)
        rows = lambda *s: (x := 1 + 0.6 * rng.random(s)) / x.sum(axis=-1, keepdims=True)
        stay = 0.7 * np.eye(STATES) + 0.3 * rows(STATES, STATES)
        return cls(rows(STATES), stay, rows(STATES, CLASSES))

    def expected(self, classes: np.ndarray, counts: np.ndarray, held: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Baum-Welch counts of start, move and emit, and the log-likelihood.

        The sequences lie one after another, each of at least one class. All are stepped through together, the longest
        first; of the forward vectors at most about `held` are kept, beside one a sequence where a piece of steps begins.
        """
        order = np.argsort(-counts, kind="stable")
        n, at = counts[order], (np.cumsum(counts) - counts)[order]
        steps = int(n[0]) if len(n) else 0
        live = len(n) - np.searchsorted(n[::-1], np.arange(steps + 1), "right")  # sequences with more than t classes
        ends = np.cumsum(live[:steps])
        cuts = [0]
        while cuts[-1] < steps:
            before = ends[cuts[-1] - 1] if cuts[-1] else 0
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, before + (held or HELD), "right"))))
        table = self.emit.T.copy()

        def forward(a: np.ndarray, t0: int, t1: int, keep: bool) -> tuple:
            first = ends[t0] - live[t0] if t0 < steps else 0
            total = int(ends[t1 - 1] - first)
            seen, alphas, scales, where = (np.empty(total, np.uint8), np.empty((total, STATES)), np.empty(total), 0) if keep else (None, None, None, 0)
            log = 0.0
            for t in range(t0, t1):
                m = live[t]
                x = classes[at[:m] + t]
                a = (a[:m] @ self.move if t else np.broadcast_to(self.start, (m, STATES))) * table[x]
                c = a.sum(axis=1)
                a /= c[:, None]
                if keep:
                    seen[where : where + m], alphas[where : where + m], scales[where : where + m] = x, a, c
                    where += m
                else:
                    log += np.log(c).sum()
            return a, seen, alphas, scales, log

        starts, loglik, a = [np.zeros((0, STATES))], 0.0, np.zeros((len(n), STATES))
        for t0, t1 in zip(cuts[:-2], cuts[1:-1], strict=True):  # all pieces but the last
            a, *_, log = forward(a, t0, t1, False)
            loglik += log
            starts.append(a)
        begin, move, emit, b = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, CLASSES)), np.zeros((0, STATES))
        for k in range(len(cuts) - 2, -1, -1):
            t0, t1 = cuts[k], cuts[k + 1]
            a, seen, alphas, scales, _ = forward(starts[k], t0, t1, True)
            if k == len(cuts) - 2:
                loglik += np.log(scales).sum()
            where = len(scales)
            for t in range(t1 - 1, t0 - 1, -1):
                m, past = live[t], live[t + 1]
                where -= m
                own = alphas[where : where + m]
                # b: of each sequence with more classes, what follows step t; of one that ends here it is 1.
                now = np.ones((m, STATES))
                if past:
                    move += own[:past].T @ b
                    now[:past] = b @ self.move.T
                b = table[seen[where : where + m]] * now / scales[where : where + m, None]
                own *= now
            gamma = alphas / alphas.sum(axis=1, keepdims=True)
            for s in range(STATES):
                emit[s] += np.bincount(seen, gamma[:, s], minlength=CLASSES)
            if t0 == 0 and len(n):
                begin = gamma[: live[0]].sum(axis=0)
        return begin, self.move * move, emit, float(loglik)

    @classmethod
    def of(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Hmm:
        """From counts, each with a little added so that every class stays possible in every state."""
        shares = lambda x, more: (x + more) / (x + more).sum(axis=-1, keepdims=True)
        return cls(shares(start, 0.1), shares(move, 0.1), shares(emit, 0.01))

    def log10_forward(self, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The exact log10 probability of each sequence; they lie one after another, each of at least one class."""
        order = np.argsort(-counts, kind="stable")
        n, at = counts[order], (np.cumsum(counts) - counts)[order]
        out, table = np.zeros(len(n)), self.emit.T.copy()
        a = self.start * table[classes[at]]
        live = len(n)
        for t in range(int(n[0]) if len(n) else 0):
            if t:
                now = int(np.searchsorted(-n, -t, "left"))  # those with more than t classes
                if now < live:
                    live, a = now, a[:now]
                a = (a @ self.move) * table[classes[at[:live] + t]]
            c = a.sum(axis=1)
            a /= c[:, None]
            out[:live] += np.log10(c)
        back = np.empty(len(n))
        back[order] = out
        return back


def word_classes(w: Words) -> np.ndarray:
    """0..254 by the number of bytes and the last two."""
    size = w.ends - w.starts
    last = w.data[w.ends - 1].astype(np.uint64)
    before = np.where(size > 1, w.data[np.maximum(w.ends - 2, 0)], 0).astype(np.uint64)
    return (mix(np.minimum(size, 9).astype(np.uint64) | last << np.uint64(8) | before << np.uint64(16)) % np.uint64(END_CLASS)).astype(np.uint8)


def trained(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")), F.lit(0)) % 7 != 2


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The corpus as blocks of about BLOCK_BYTES: one row a block, written to the shared folder.

    block, ids, train (flags), counts (tokens of each text with its end), classes (a byte a token), words (distinct hashes,
    sorted), learned (their counts in training texts), kind (their classes), tokens (the number of each token's word, byte
    planes apart).
    """
    names = ["ids", "train", "counts", "classes", "words", "learned", "kind", "tokens"]

    def block(parts: list[tuple[np.ndarray, ...]], ids: list[pa.Array], train: list[np.ndarray]) -> pa.RecordBatch:
        counts, classes, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
        flags = np.concatenate(train)
        order = np.argsort(hashes)
        starts = np.flatnonzero(np.r_[True, hashes[order][1:] != hashes[order][:-1]])
        n = np.diff(np.r_[starts, len(hashes)])
        learned = np.add.reduceat(np.repeat(flags, counts)[order].astype(np.int64), starts)
        rank = np.empty(len(starts), np.int64)  # common words have small numbers, so that the planes compress
        rank[np.argsort(-n, kind="stable")] = np.arange(len(starts))
        tokens = np.empty(len(hashes), np.uint32)
        tokens[order] = np.repeat(rank, n)
        by_rank = np.argsort(rank)
        first = order[starts]
        ids_ = pa.concat_arrays(ids)
        row = [ids_.to_pylist(), flags.tobytes(), counts.astype(np.int64).tobytes(), squeezed(classes), hashes[first][by_rank].tobytes(), learned[by_rank].tobytes(), classes[first][by_rank].tobytes(), squeezed(tokens.view(np.uint8).reshape(-1, 4).T)]
        return pa.record_batch([pa.array([row[0]], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in row[1:])], names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, ids, train, size = [], [], [], 0
        for b in batches:
            for start, part in chunks(b.column(2)):
                w = Words(part, lower=True)
                n, words = len(w.counts), len(w.starts)
                places = np.arange(words) + np.repeat(np.arange(n), w.counts)
                classes, hashes = np.full(words + n, END_CLASS, np.uint8), np.full(words + n, END_HASH, np.uint64)
                classes[places], hashes[places] = word_classes(w), w.hashes()
                parts.append((w.counts + 1, classes, hashes))
                ids.append(b.column(0).slice(start, n))
                train.append(np.asarray(b.column(1).slice(start, n)).astype(np.uint8))
                size += len(w.data) + 8 * n
                if size >= BLOCK_BYTES:
                    yield block(parts, ids, train)
                    parts, ids, train, size = [], [], [], 0
        if parts:
            yield block(parts, ids, train)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), trained(F.col(id_col)).alias("train"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(each, "ids array<long>, train binary, counts binary, classes binary, words binary, learned binary, kind binary, tokens binary")
    blocks = written(found.select(F.monotonically_increasing_id().alias("at"), "*"), "blocks")
    # Blocks are numbered from 0: after those of the tasks before (a row a task).
    tasks = blocks.groupBy(F.shiftright("at", 33).alias("task")).count()
    before = tasks.select("task", F.coalesce(F.sum("count").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    before = F.broadcast(before) if tasks.count() <= 1_000_000 else before
    number = (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("block")
    return blocks.withColumn("task", F.shiftright("at", 33)).join(before, "task").select(number, *found.columns)


def sequences(train: bytes, counts: bytes, classes: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A block's training sequences, one after another, and their lengths."""
    flags, n = np.frombuffer(train, np.uint8).astype(bool), np.frombuffer(counts, np.int64)
    line = swelled(classes, int(n.sum()))
    return line[np.repeat(flags, n)], n[flags]


def train(blocks: DataFrame, steps: int = STEPS, states_seed: int = 7) -> Hmm:
    """Baum-Welch over all training texts; only the summed counts reach the driver."""
    model = Hmm.random(states_seed)
    shape = [STATES, STATES * STATES, STATES * CLASSES, 1]

    for _ in range(steps):

        def each(batches: Iterator[pa.RecordBatch], model: Hmm = model) -> Iterator[pa.RecordBatch]:
            total = np.zeros(sum(shape))
            for b in batches:
                for k in range(b.num_rows):
                    counts = model.expected(*sequences(*(c[k].as_py() for c in b.columns)))
                    total += np.concatenate([np.ravel(x) for x in counts])
            yield pa.record_batch([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["k", "x"])

        # Sums of floats depend on their order: sum whole numbers instead.
        counts = blocks.select("train", "counts", "classes").mapInArrow(each, "k int, x double")
        sums = counts.groupBy("k").agg(F.sum(F.round(F.col("x") * 1024).cast("decimal(38,0)")).cast("double").alias("x")).toArrow().sort_by("k")
        if not len(sums):
            return model
        start, move, emit, _ = np.split(sums.column("x").to_numpy() / 1024, np.cumsum(shape)[:-1])
        model = Hmm.of(start, move.reshape(STATES, STATES), emit.reshape(STATES, CLASSES))
    return model


def score(blocks: DataFrame, model: Hmm) -> DataFrame:
    """One row for each text: id, n_tokens, n_known, train_tokens, base_score, score."""
    number = max(1, blocks.count())
    tasks = max(blocks.sparkSession.sparkContext.defaultParallelism, number)

    def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                block, words, learned, kind = (c[k].as_py() for c in b.columns)
                words = np.frombuffer(words, np.int64)
                for a in range(0, len(words), 50_000):
                    part = words[a : a + 50_000]
                    yield pa.record_batch([pa.array(np.full(len(part), block, np.int64)), pa.array(part), pa.array(np.frombuffer(learned, np.int64)[a : a + 50_000]), pa.array(np.frombuffer(kind, np.uint8)[a : a + 50_000].astype(np.int32)), pa.array(np.arange(a, a + len(part), dtype=np.int32))], ["block", "word", "n", "kind", "number"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All rows of a word are in one task, which has about as many rows as a block has words."""
        if not (found := list(batches)):
            return
        block, word, n, kind, number = (c.to_numpy() for c in pa.Table.from_batches(found).columns)
        order = np.argsort(word)
        starts = np.flatnonzero(np.r_[True, word[order][1:] != word[order][:-1]])
        c = np.add.reduceat(n[order], starts)
        known = c > 0
        kinds = np.minimum.reduceat(kind[order], starts)[known]
        per_class = np.bincount(kinds, c[known], CLASSES).astype(np.int64), np.bincount(kinds, minlength=CLASSES)
        each_c = np.empty(len(word), np.int64)
        each_c[order] = np.repeat(c, np.diff(np.r_[starts, len(word)]))
        more = each_c > n
        # Totals of the classes go as rows without a block: the class, its tokens and its distinct words.
        yield pa.record_batch([pa.array(np.full(CLASSES, -1)), pa.array(np.arange(CLASSES, dtype=np.int32)), pa.array(per_class[0]), pa.array(per_class[1])], names)
        yield pa.record_batch([pa.array(block[more]), pa.array(number[more]), pa.array(each_c[more]), pa.nulls(int(more.sum()), pa.int64())], names)

    names = ["block", "number", "c", "v"]
    words = blocks.select("block", "words", "learned", "kind").mapInArrow(vocabulary, "block long, word long, n long, kind int, number int").repartition(tasks, "word")
    counted = written(words.mapInArrow(count, "block long, number int, c long, v long"), "counts")
    per_class = {r["number"]: (r["n"], r["v"]) for r in counted.where("block < 0").groupBy("number").agg(F.sum("c").alias("n"), F.sum("v").alias("v")).collect()}
    n_all, v_all = sum(n for n, _ in per_class.values()), sum(v for _, v in per_class.values())
    base = np.log10(n_all + v_all + 1.0)
    below = np.log10([sum(per_class.get(k, (0, 0))) + 1.0 for k in range(CLASSES)])
    elsewhere = counted.where("block >= 0").select("block", "number", "c")

    def each(table, told):
        out = []
        number, count = told.column("number").to_numpy(), told.column("c").to_numpy()
        for k in range(table.num_rows):
            ids, counts, classes, learned, tokens = (table.column(c)[k].as_py() for c in ("ids", "counts", "classes", "learned", "tokens"))
            n = np.frombuffer(counts, np.int64)
            total = int(n.sum())
            classes = swelled(classes, total)
            c = np.frombuffer(learned, np.int64).copy()
            c[number] = count
            planes = swelled(tokens, 4 * total).reshape(4, total)
            c = c[np.ascontiguousarray(planes.T).view(np.uint32).ravel()]
            first = np.cumsum(n) - n
            sums = lambda x: np.add.reduceat(x, first)
            log_c = sums(np.log10(c + 1.0))
            inner = log_c - sums(below[classes])
            out.append((ids, n, sums((c > 0).astype(np.int64)), log_c - n * base, model.log10_forward(classes, n) + inner))
        if not out:
            return pa.table({x: pa.array([], t) for x, t in zip(columns, kinds, strict=True)})
        ids, *rest = zip(*out, strict=True)
        n, n_known, base_score, full = (np.concatenate(x) for x in rest)
        return pa.table([pa.array([i for x in ids for i in x], pa.int64()), pa.array(n), pa.array(n_known), pa.array(np.full(len(n), n_all, np.int64)), pa.array(base_score), pa.array(full)], columns)

    columns, kinds = ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"], [pa.int64()] * 4 + [pa.float64()] * 2
    mine = blocks.select("block", "ids", "counts", "classes", "learned", "tokens")
    mine, elsewhere = mine.withColumn("part", F.col("block").cast("int")), elsewhere.withColumn("part", F.col("block").cast("int"))
    mine, elsewhere = mine.repartitionById(number, "part"), elsewhere.repartitionById(number, "part")
    return mine.groupBy("part").cogroup(elsewhere.groupBy("part")).applyInArrow(each, "id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def likelihoods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores every row of docs, having learned from those that trained() picks.

    A text that is null, empty or without words is its end alone. Rows that repeat an id are scored, and learned from, one
    by one. Without any training text all counts are 0 and the states stay as they began.
    """
    blocks = encode(docs, id_col, text_col)
    return score(blocks, train(blocks))


def query(spark, sf_dir: str) -> DataFrame:
    found = likelihoods(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), (~trained(F.col("id"))).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
