"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints are 64-bit SimHashes of word shingles. A trie over the distinct fingerprints is joined with itself:
pairs of nodes are walked down together, the bits in which they differ are summed up, and a pair is pruned as soon as the
sum exceeds the budget. The trie is dealt to tasks by what a matching pair must share: with k bits to differ and the 64 bits
cut into k + t blocks, some t blocks are equal, so one trie for each choice of t blocks, with these blocks on top, finds
the pair below a common node. That node's subtrie is one group; a group over `group_rows` is cut into pairs of subtries, and these again.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingle_join
from .common import met, written
from .components import Forest, components

SEED = 42
ROWS_A_TASK = 200_000
#: Pairs of nodes that are walked at once, and pairs of leaves up to which two nodes are compared leaf by leaf.
FRONT, LEAVES = 1 << 19, 32
_ONE = np.uint64(1)


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of every shingle of `width` lower-case words; of all words if they are fewer."""
    words = text.lower().split()  # of bytes: A-Z only, and exactly the six white characters
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    line, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts, stops = [0, *ends[:-width].tolist()], (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(stops))


def fingerprint(text: bytes, width: int) -> int:
    h = shingle_hashes(text, width)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 4096):
        ones += np.unpackbits(h[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of every row. A text that is null or has no words has fingerprint 0."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            found = np.fromiter((fingerprint(t.as_py() or b"", width) for t in texts), np.uint64, len(texts))
            yield pa.record_batch([b.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(each, "id long, fp long")


def _blocks(budget: int, rows: int) -> tuple[list[tuple[int, int]], int]:
    """(lowest bit, bits) of each block, and t, so that groups of unrelated fingerprints stay small."""
    t = 1
    while rows >> (64 * t // (budget + t)) > 2048 and t < 4:
        t += 1
    edges = [64 * k // (budget + t) for k in range(budget + t + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)], t


def _on_top(fp: np.ndarray, blocks: list[tuple[int, int]], chosen: tuple[int, ...]) -> np.ndarray:
    """The same bits, those of the chosen blocks highest."""
    out, at = np.zeros_like(fp), 64
    for k in [*chosen, *(k for k in range(len(blocks)) if k not in chosen)]:
        low, bits = blocks[k]
        at -= bits
        out |= ((fp >> np.uint64(low)) & np.uint64((1 << bits) - 1)) << np.uint64(at)
    return out


def trie_links(fp: np.ndarray, group: np.ndarray, side: np.ndarray, budget: int) -> np.ndarray:
    """For each row the first row of its component under links of at most `budget` bits within a group.

    Rows are sorted by (group, side, fp). A group's rows of side 0 are one trie, joined with itself; if it has rows of
    side 1 too, the two tries are joined with each other instead.
    """
    forest = Forest(len(fp))
    if not len(fp):
        return forest.root
    cut = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (side[1:] != side[:-1])])
    ends = np.r_[cut[1:], len(fp)]
    of = group[cut]
    twin = np.r_[of[1:] == of[:-1], False]  # this run and the next are two sides of one group
    second = np.r_[False, twin[:-1]]
    one = np.flatnonzero(~second)
    other = np.where(twin[one], one + 1, one)
    stack = [(cut[one], ends[one], cut[other], ends[other], np.zeros(len(one), np.int64), np.full(len(one), 63))]
    while stack:
        a0, a1, b0, b1, errors, bit = stack.pop()
        if len(a0) > FRONT:
            stack.append(tuple(x[FRONT:] for x in (a0, a1, b0, b1, errors, bit)))
            a0, a1, b0, b1, errors, bit = (x[:FRONT] for x in (a0, a1, b0, b1, errors, bit))
        few = ((a1 - a0) * (b1 - b0) <= LEAVES) | (bit < 0)
        if few.any():
            na, nb = (a1 - a0)[few], (b1 - b0)[few]
            n = na * nb
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i = np.repeat(a0[few], n) + at // np.repeat(nb, n)
            j = np.repeat(b0[few], n) + at % np.repeat(nb, n)
            near = (i != j) & (np.bitwise_count(fp[i] ^ fp[j]) <= budget)
            forest.add(i[near], j[near])
        a0, a1, b0, b1, errors, bit = (x[~few] for x in (a0, a1, b0, b1, errors, bit))
        if not len(a0):
            continue
        am, bm = _split(fp, a0, a1, bit), _split(fp, b0, b1, bit)
        same = a0 == b0
        below = [(a0, am, b0, bm, errors), (am, a1, bm, b1, errors), (a0, am, bm, b1, errors + 1), (am[~same], a1[~same], b0[~same], bm[~same], errors[~same] + 1)]
        bits = [bit, bit, bit, bit[~same]]
        parts = [np.concatenate(x) for x in zip(*below, strict=True)] + [np.concatenate(bits) - 1]
        live = (parts[0] < parts[1]) & (parts[2] < parts[3]) & (parts[4] <= budget)
        if live.any():
            stack.append(tuple(x[live] for x in parts))
    return forest.reduce()


def _split(fp: np.ndarray, low: np.ndarray, high: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """The first row of low..high whose bit is set: where a node's two children meet."""
    low, high, bit = low.copy(), high.copy(), bit.astype(np.uint64)
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) // 2
        on = (fp[mid] >> bit[open_]) & _ONE == 1
        high[open_[on]], low[open_[~on]] = mid[on], mid[~on] + 1
    return low


def links(distinct: DataFrame, budget: int = 4, group_rows: int = 32_768, rows: int | None = None) -> DataFrame:
    """(a, b long) between distinct fingerprints in column fp: their components are those of all links of `budget` bits.

    rows: the number of fingerprints, if it is known.
    """
    rows = distinct.count() if rows is None else rows
    blocks, t = _blocks(budget, rows)
    choices = list(combinations(range(len(blocks)), t))
    masks = [sum(((1 << blocks[k][1]) - 1) << blocks[k][0] for k in c) for c in choices]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    free = [[low + b for k, (low, bits) in enumerate(blocks) if k not in c for b in range(bits)] for c in choices]
    dealt = distinct.select("fp", F.explode(F.array(*(F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("shared")) for k, m in enumerate(masks)))).alias("x")).select("fp", "x.*")
    groups = dealt.select("choice", "fp", F.xxhash64("choice", "shared").alias("grp"), F.lit(0).alias("side"), F.lit(False).alias("two"), F.lit(budget).alias("left"))
    for level in range(min(map(len, free)) // 6):
        large = groups.groupBy("grp").count().where(F.col("count") > group_rows).select("grp")
        if large.isEmpty():
            break
        groups = written(_cut(groups, large, [f[6 * level : 6 * level + 6] for f in free]), "groups")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (found := list(batches)):
            return
        table = pa.Table.from_batches(found)
        choice, fp, grp, side = (table.column(k).to_numpy() for k in range(4))
        top = fp.view(np.uint64).copy()
        for k in np.unique(choice):
            top[choice == k] = _on_top(top[choice == k], blocks, choices[k])
        # Two groups whose hashes are alike would only be searched together.
        order = np.lexsort((top, side, choice, grp))
        grp_of = grp[order] * len(choices) + choice[order]
        root = trie_links(top[order], grp_of, side[order], budget)
        linked = np.flatnonzero(root != np.arange(len(root)))
        own = fp[order]
        yield pa.record_batch([pa.array(own[linked]), pa.array(own[root[linked]])], ["a", "b"])

    tasks = max(distinct.sparkSession.sparkContext.defaultParallelism, rows * len(choices) // ROWS_A_TASK)
    return groups.select("choice", "fp", "grp", "side").repartition(tasks, "grp").mapInArrow(each, "a long, b long")


def _cut(groups: DataFrame, large: DataFrame, places: list[list[int]]) -> DataFrame:
    """Of each large group the pairs of subtries that six more bits (places, by choice) tell apart, as groups of their own.

    A trie that is joined with itself gives unordered pairs of its subtries; two tries give pairs of one's with the other's.
    Pairs whose six bits already differ too much are left out.
    """
    place = lambda k: F.element_at(F.array(*(F.lit(p[k]) for p in places)), F.col("choice") + 1)
    bit = lambda k: F.call_function("shiftrightunsigned", F.col("fp"), place(k)).bitwiseAND(F.lit(1)).cast("int") * (1 << k)
    six = sum((bit(k) for k in range(1, 6)), bit(0))
    near = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda o: F.bit_count(o.bitwiseXOR(F.col("six"))) <= F.col("left"))
    split = groups.join(large, "grp", "left_semi").withColumn("six", six).withColumn("other", F.explode(near))
    one, two = ~F.col("two") | (F.col("side") == 0), F.col("two")
    a = F.when(two, F.when(one, F.col("six")).otherwise(F.col("other"))).otherwise(F.least("six", "other"))
    b = F.when(two, F.when(one, F.col("other")).otherwise(F.col("six"))).otherwise(F.greatest("six", "other"))
    side = F.when(two, F.col("side")).otherwise((F.col("six") > F.col("other")).cast("int"))
    small = split.select("choice", "fp", F.xxhash64("grp", a, b).alias("grp"), side.alias("side"), (two | (F.col("six") != F.col("other"))).alias("two"), (F.col("left") - F.bit_count(F.col("six").bitwiseXOR(F.col("other")))).cast("int").alias("left"))
    return groups.join(large, "grp", "left_anti").select(small.columns).unionByName(small)


def near_duplicates(docs: DataFrame, width: int = 4, budget: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component long) for every row: component is the smallest id that links lead to.

    Rows with equal fingerprints are linked, so also all texts that are null, empty or without words. Rows that repeat an
    id are linked by their own fingerprints each. A null id never becomes the name of a component unless all its ids are null.
    """
    fps = written(fingerprints(docs, width, id_col, text_col), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("id").alias("least_id"), F.count("*").alias("copies")), "classes")
    distinct, rows = classes.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    found = components(links(classes.select("fp"), budget, rows=distinct))
    named = classes.join(found.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least_id").alias("smallest"), F.count("*").alias("copies"))
    of_fp = met(named.select("fp", F.col("copies").alias("n"), "component"), least, "component", distinct)
    return met(fps, of_fp.select("fp", F.col("smallest").alias("component"), F.col("n").alias("copies")), "fp", rows).select("id", "fp", "component")


def keep_one(docs: DataFrame, width: int = 5, budget: int = 4) -> DataFrame:
    """One row of each group of near-duplicates in docs (doc_id, text, and any other columns), with the columns of docs.

    The tries give the first links, of `budget` bits between SimHashes of `width` words; a link counts if the texts' shingle
    sets have a similarity (Jaccard) of 0.8 or more. As such sets can differ in any number of bits, an exact join of the
    sets then finds what links the tries left out, so no link is lost.

    Rows are judged one by one, by their own texts: the row with the smallest doc_id stays. Of rows that repeat a doc_id and
    a text one stays; a row without a doc_id stays only if its whole group has none. Null, empty and wordless texts are one
    group.
    """
    return shingle_join.keep_one(docs, width, lambda fps, n: links(fps, budget, rows=n))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
