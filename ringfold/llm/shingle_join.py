"""All links between texts whose five-word shingles have a similarity (Jaccard) of 0.8 or more, and one text of each group.

Two sets of a and b shingles that are so similar differ in at most (a + b) / 9 shingles. Shingles are dealt by their hash
to m parts, more than may differ: then some parts are equal, and as long as one of the two sets leaves no more parts empty than
there are to spare, two of the equal parts are not empty. A text sends a signature of each of its parts that is not empty; texts
that leave more parts empty also send the first n div 5 + 2 of their shingles, of which similar sets share two. So each
similar pair meets in two signatures, and no pair is lost. m hangs on the sizes: scheme k is for pairs whose larger set
has LEVELS[k] shingles up to LEVELS[k + 1] - 1. Where a common line makes one signature common, its texts meet in pairs of
signatures instead. Of what meets, a sketch of parities gives at least how many shingles differ, where texts meet, and the pairs it leaves are compared by all
shingles (64-bit hashes). Links are looked for first where they are likely (tries of SimHashes, neighbours
in a group); pairs that these have joined already are not compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, met, mix, whole, windows, written
from .components import components

WIDTH = 5
#: Bytes of text whose signatures one task compares, bytes of signatures that a task gathers before it sends them, and pairs that are compared at once.
BYTES_A_BUCKET, GATHERED, PAIRS_AT_ONCE = 12_000_000, 24_000_000, 1 << 18
#: Texts in a group above which its texts meet in pairs of signatures, and texts of a group that one task compares with each other.
LARGE, TILE = 4096, 2048
#: Of its groups each set tells so many, the least, where it is compared: a pair is left to the least of those that both tell.
TOLD = 12
#: Texts whose keys are broadcast at most, when the sets of some are asked for; the keys of more are joined.
BROADCAST_KEYS = 2_000_000
_ODD = np.uint64(0xD6E8FEB86659FD93)


def _schemes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lowest size, parts and parts to spare of each scheme."""
    levels = [4]
    while levels[-1] < 1 << 40:
        levels.append(-(-5 * levels[-1] // 4))
    parts, spare = [], []
    for low, above in zip(levels, levels[1:], strict=False):
        smallest, differ = -(-4 * low // 5), 2 * (above - 1) // 9
        m = differ + 1
        while m < smallest:
            q = math.exp(-smallest / m)
            if m - differ - 2 >= m * q + 2 * math.sqrt(m * q):
                break
            m += 1 + m // 256
        parts.append(m)
        spare.append(m - differ - 2)
    return np.array(levels), np.array(parts), np.array(spare)


LEVELS, PARTS, SPARE = _schemes()


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of all texts, sorted within each text, and where each text's begin (n + 1)."""
    words = Words(texts, lower=True)
    h, rows = words.hashes(), words.rows()
    found = windows(h, width)
    ok = whole(words.first, words.counts, width, len(found))
    values, of = [found[ok]], [rows[: len(found)][ok]]
    for few in range(1, width):  # all words of a shorter text are its one shingle
        short = np.flatnonzero(words.counts == few)
        if len(short):
            values.append(windows(h, few)[words.first[:-1][short]])
            of.append(short)
    v, r = np.concatenate(values), np.concatenate(of)
    order = np.lexsort((v, r))
    v, r = v[order], r[order]
    new = np.r_[True, (v[1:] != v[:-1]) | (r[1:] != r[:-1])][: len(v)]
    v, r = v[new], r[new]
    return v, np.searchsorted(r, np.arange(len(words.counts) + 1))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def names(v: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each set: texts with equal sets have one name."""
    return mix(_sums(mix(v ^ _ODD), first) + np.diff(first).astype(np.uint64) * _ODD)


def fingerprints(v: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The SimHash of each set: a bit is 1 if it is set in over half of the hashes; 0 for an empty set."""
    ones = np.zeros((len(first) - 1, 64), np.int64)
    some = np.flatnonzero(np.diff(first))
    at = 0
    while at < len(some):  # sets of about 2**18 shingles at once
        end = max(at + 1, int(np.searchsorted(first[some], first[some[at]] + (1 << 18), "right")))
        own = some[at:end]
        a, z = first[own[0]], first[own[-1] + 1]
        bits = np.unpackbits(np.ascontiguousarray(v[a:z]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[own] = np.add.reduceat(bits, first[own] - a, axis=0, dtype=np.int64)
        at = end
    return np.packbits(2 * ones > np.diff(first)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def signatures(v: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature, which set) of all sets."""
    n, spread = np.diff(first), mix(v ^ _ODD)
    level = np.searchsorted(LEVELS, n, "right") - 1
    found, of = [], []
    for up in (0, 1):
        k = np.minimum(level + up, len(PARTS) - 1)
        chosen = (n >= 4) & ((5 * n >= 4 * LEVELS[k]) if up else True)
        rows = np.repeat(np.arange(len(n)), n)
        use = chosen[rows]
        rows, own, s = rows[use], v[use], spread[use]
        if not len(rows):
            continue
        m = PARTS[k].astype(np.uint64)[rows]
        part = ((own >> np.uint64(32)) * m) >> np.uint64(32)  # rises with the hash: parts lie in a row
        cut = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (part[1:] != part[:-1])])
        row = rows[cut]
        found.append(mix(np.add.reduceat(s, cut) + (part[cut] * np.uint64(256) + k[row].astype(np.uint64)) * _ODD))
        of.append(row)
        bare = chosen & (PARTS[k] - np.bincount(row, minlength=len(n)) > SPARE[k])
        at = np.arange(len(v)) - np.repeat(first[:-1], n)
        lead = np.repeat(bare, n) & (at < np.repeat(n // 5 + 2, n))
        row = np.repeat(np.arange(len(n)), n)[lead]
        found.append(mix(spread[lead] ^ (k[row].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C55)))
        of.append(row)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(of)


def _texts(docs: DataFrame) -> DataFrame:
    """(id, key, text) of each row; key is a hash of the text, so that a row is told by (id, key) without its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))


def _meetings(docs: DataFrame, width: int) -> DataFrame:
    """(id, key, node, fp, n, sketch) of each row: node names its set of n shingles, fp is the set's SimHash, sketch its
    parities; and (grp, node) of the sets that meet in a signature."""
    texts = _texts(docs)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(docs.sparkSession.sparkContext.defaultParallelism, total // BYTES_A_BUCKET)
    names_ = ["bucket", "nodes", "sigs", "at"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, owners, seen, size = [], [], np.zeros(0, np.uint64), 0

        def flush() -> Iterator[pa.RecordBatch]:
            s, o = np.concatenate(sigs), np.concatenate(owners)
            to = ((s >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            order = np.argsort(to, kind="stable")
            s, o, to = s[order], o[order], to[order]
            s, low = (s >> np.uint64(16)).astype(np.uint32), s.astype(np.uint16)
            edges = np.searchsorted(to, np.arange(buckets + 1))
            for b in range(buckets):
                a, z = edges[b], edges[b + 1]
                if a < z:
                    own, at = np.unique(o[a:z], return_inverse=True)
                    # 32 bits under the bucket's and 16 low bits of a signature, and the owner's place, 16 bits if that is enough.
                    wide = np.uint32 if len(own) > 1 << 16 else np.uint16
                    yield pa.record_batch([pa.array([b], pa.int32()), pa.array([own.tobytes()]), pa.array([s[a:z].tobytes() + low[a:z].tobytes()]), pa.array([at.astype(wide).tobytes()])], names_)

        for batch in batches:
            for start, part in chunks(batch.column(2)):
                v, first = shingle_sets(part, width)
                node = names(v, first)
                own, key = batch.column(0).slice(start, len(part)), np.asarray(batch.column(1).slice(start, len(part)), dtype=np.int64)
                ids, none = np.asarray(own.fill_null(0), dtype=np.int64), np.asarray(own.is_null())
                # Rows go along as one packed row, to any task: -1 - bucket.
                numbers = np.stack([ids, key, none, fingerprints(v, first).view(np.int64), np.diff(first)])
                sketches = pa.array([_sketch(v[first[k] : first[k + 1]]) for k in range(len(node))], pa.binary())
                yield pa.record_batch([pa.array([-1 - int(node[0] % np.uint64(buckets))], pa.int32()), pa.array([node.tobytes()]), pa.array([numbers.tobytes()]), pa.array([_packed(sketches)])], names_)
                fresh = np.zeros(len(node), bool)  # equal texts send once
                fresh[np.unique(node, return_index=True)[1]] = True
                fresh &= ~np.isin(node, seen)
                seen = np.union1d(seen, node[fresh])
                s, of = signatures(v[np.repeat(fresh, np.diff(first))], np.r_[0, np.cumsum(np.diff(first)[fresh])])
                sigs.append(s)
                owners.append(node[fresh][of])
                size += 16 * len(s)
                if size > GATHERED:
                    yield from flush()
                    sigs, owners, size = [], [], 0
        if sigs:
            yield from flush()

    columns = ["id", "key", "fp", "n", "sketch", "grp", "node"]
    kinds = [pa.int64()] * 4 + [pa.binary()] + [pa.int64()] * 2

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list] = {}
        for batch in batches:
            for bucket, nodes, sigs, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket < 0:
                    n = len(nodes) // 8
                    ids, key, none, *more = np.frombuffer(sigs, np.int64).reshape(5, n)
                    yield pa.record_batch([pa.array(ids, mask=none != 0), *map(pa.array, [key, *more]), _unpacked(at, n), pa.nulls(n, pa.int64()), pa.array(np.frombuffer(nodes, np.int64))], columns)
                else:
                    n = len(sigs) // 6
                    sig = np.frombuffer(sigs, np.uint32, n).astype(np.uint64) << np.uint64(16) | np.frombuffer(sigs, np.uint16, n, 4 * n)
                    got.setdefault(bucket, []).append((sig, np.frombuffer(nodes, np.int64)[np.frombuffer(at, np.uint16 if len(at) == 2 * n else np.uint32)]))
        for bucket in sorted(got):
            s, n = (np.concatenate(x) for x in zip(*got.pop(bucket), strict=True))
            order = np.argsort(s, kind="stable")
            s, n = s[order], n[order]
            several = np.r_[False, s[1:] == s[:-1]]
            several |= np.r_[several[1:], False]
            s, n = s[several], n[several]
            order = np.lexsort((n, s))
            s, n = s[order], n[order]
            new = np.r_[True, (s[1:] != s[:-1]) | (n[1:] != n[:-1])][: len(s)]
            s, n = s[new], n[new]
            _, at, count = np.unique(s, return_inverse=True, return_counts=True)
            keep = count[at] > 1
            s, n = mix(s[keep] + np.uint64((bucket * int(_ODD)) % (1 << 64))).view(np.int64), n[keep]
            for a in range(0, len(s), 65536):
                k = len(s[a : a + 65536])
                yield pa.record_batch([*(pa.nulls(k, t) for t in kinds[:5]), pa.array(s[a : a + 65536]), pa.array(n[a : a + 65536])], columns)

    sent = texts.mapInArrow(send, "bucket int, nodes binary, sigs binary, at binary")
    dealt = sent.repartitionById(buckets, F.when(F.col("bucket") < 0, -1 - F.col("bucket")).otherwise(F.col("bucket")))
    return written(dealt.mapInArrow(meet, ", ".join(f"{c} {'binary' if c == 'sketch' else 'long'}" for c in columns)), "meetings")


def _packed(blobs: pa.Array) -> bytes:
    sizes = np.asarray(pa.compute.binary_length(blobs), np.int32)
    return sizes.tobytes() + b"".join(x.as_buffer() for x in blobs)


def _unpacked(blob: bytes, n: int) -> pa.Array:
    ends = np.r_[0, np.cumsum(np.frombuffer(blob, np.int32, n))].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(blob[4 * n :])])


def _sketch(own: np.ndarray) -> bytes:
    """For each of 1.4 n bits or more (64 times a power of two) whether an odd number of the n shingles falls there."""
    bits = 64
    while 5 * bits < 7 * len(own):
        bits *= 2
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Sketches:
    """Sketches by size, and each one folded to half its size, as sketches of similar sets differ at most so much in size."""

    def __init__(self, sketches: pa.Array):
        self.size = np.asarray(pa.compute.binary_length(sketches), np.int64) // 8
        self.of, self.row = {}, np.zeros(len(self.size), np.int64)
        for size in np.unique(self.size):
            at = np.flatnonzero(self.size == size)
            self.row[at] = np.arange(len(at))
            raw = b"".join(sketches[int(k)].as_buffer() for k in at)
            self.of[int(size)] = np.frombuffer(raw, np.uint64).reshape(len(at), size)
        self.half = {n: m[:, : n // 2] ^ m[:, n // 2 :] for n, m in self.of.items() if n > 1}

    def differ(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """At least how many shingles differ; 0 for sketches of very different sizes."""
        out = np.zeros(len(i), np.int64)
        least, most = np.minimum(self.size[i], self.size[j]), np.maximum(self.size[i], self.size[j])
        for size in np.unique(least):
            for a in (1, 2):
                pairs = np.flatnonzero((least == size) & (most == a * size))
                for k in range(0, len(pairs), max(1, (1 << 21) // int(size))):
                    p = pairs[k : k + max(1, (1 << 21) // int(size))]
                    x, y = self._at(i[p], int(size)), self._at(j[p], int(size))
                    out[p] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
        return out

    def _at(self, k: np.ndarray, size: int) -> np.ndarray:
        out, own = np.empty((len(k), size), np.uint64), self.size[k] == size
        out[own] = self.of[size][self.row[k[own]]]
        if not own.all():
            out[~own] = self.half[2 * size][self.row[k[~own]]]
        return out


def _may_be_similar(one: tuple[int, bytes], two: tuple[int, bytes]) -> bool:
    """False only if the sizes or the parities show that too many shingles differ."""
    a, b = one[0], two[0]
    if 5 * min(a, b) < 4 * max(a, b):
        return False
    x, y = (np.frombuffer(x, np.uint8) for x in (one[1], two[1]))
    least = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, least), axis=0) for z in (x, y))
    return 9 * int(np.bitwise_count(x ^ y).sum()) <= a + b


def _are_similar(one: tuple[int, bytes], two: tuple[int, bytes]) -> bool:
    x, y = np.frombuffer(one[1], np.uint64), np.frombuffer(two[1], np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 5 * both >= 4 * (len(x) + len(y) - both)


def _sets(docs: DataFrame, nodes: DataFrame, live: DataFrame, width: int) -> DataFrame:
    """(node, own): the shingles of each of the nodes in live."""
    keys = nodes.join(live, "node", "left_semi").select(F.col("key").alias("k"))
    keys = F.broadcast(keys) if live.count() <= BROADCAST_KEYS else keys
    texts = _texts(docs)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for _, part in chunks(batch.column(0)):
                v, first = shingle_sets(part, width)
                node = names(v, first).view(np.int64)
                rows = [k for k in range(len(node)) if node[k] not in seen and not seen.add(node[k])]
                for a in range(0, len(rows), 256):
                    some = rows[a : a + 256]
                    yield pa.record_batch([pa.array(node[some]), pa.array([v[first[k] : first[k + 1]].tobytes() for k in some], pa.binary()), pa.array([int(first[k + 1] - first[k]) for k in some], pa.int64())], ["node", "own", "n"])

    asked = texts.join(keys, texts["key"] == F.col("k"), "left_semi").select("text")
    return written(asked.mapInArrow(each, "node long, own binary, n long").dropDuplicates(["node"]), "sets")


def _compared(pairs: DataFrame, own: DataFrame, test, name: str) -> DataFrame:
    """The pairs (a, b) for which test((n, own) of a, (n, own) of b) holds."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, n = batch.column(2).to_pylist(), batch.column(4).to_pylist()
            ends = zip(zip(m, batch.column(3), strict=True), zip(n, batch.column(5), strict=True), strict=True)
            keep = pa.array([test((k, x.as_buffer()), (l, y.as_buffer())) for (k, x), (l, y) in ends], pa.bool_())
            yield pa.record_batch([batch.column(k).filter(keep) for k in (0, 1)], ["a", "b"])

    end = lambda c: own.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("own").alias(f"own_{c}"))
    return written(pairs.join(end("a"), "a").join(end("b"), "b").select("a", "b", "n_a", "own_a", "n_b", "own_b").mapInArrow(each, "a long, b long"), name)


def similar(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) whose sets have a similarity of 0.8 or more."""
    left = _compared(pairs, nodes.select("node", "n", F.col("sketch").alias("own")), _may_be_similar, "left")
    live = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return _compared(left, _sets(docs, nodes, live, width), _are_similar, "similar")


def _narrowed(groups: DataFrame) -> DataFrame:
    """Groups of more than LARGE sets replaced by those that meet in one more signature: similar sets meet in two."""
    sizes = groups.groupBy("grp").agg(F.count("*").alias("copies"))
    total, most = sizes.agg(F.sum("copies"), F.max("copies")).first()
    if (most or 0) <= LARGE:
        return groups
    many = sizes.where(F.col("copies") > LARGE)
    large = met(groups, many, "grp", total)
    twice = large.join(groups.withColumnRenamed("grp", "other"), "node").where("grp <> other")
    pairs = twice.select(F.xxhash64(F.least("grp", "other"), F.greatest("grp", "other")).alias("grp"), "node").distinct()
    few = met(groups, sizes.where(F.col("copies") <= LARGE), "grp", total)
    return written(few.unionByName(pairs), "groups")


def _chains(groups: DataFrame) -> DataFrame:
    """Each set of a group with the next one. Rows are dealt by ranges, so a large group is in several tasks (and a link between them is left out)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            g, n = np.r_[g, batch.column(0).to_numpy()], np.r_[n, batch.column(1).to_numpy()]
            next_ = (g[1:] == g[:-1]) & (n[1:] != n[:-1])
            yield pa.record_batch([pa.array(n[:-1][next_]), pa.array(n[1:][next_])], ["a", "b"])
            g, n = g[-1:], n[-1:]

    return groups.select("grp", "node").repartitionByRange("grp", "node").sortWithinPartitions("grp", "node").mapInArrow(each, "a long, b long").distinct()


def _met_before(one: np.ndarray, two: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each pair of rows of two tables of groups, whether they share a group less than the pair's own."""
    before = np.zeros(len(place), bool)
    for k in range(one.shape[1]):
        before |= (one[:, k] < place) & (two == one[:, k : k + 1]).any(axis=1)
    return before


def _apart(groups: DataFrame, nodes: DataFrame, named: DataFrame) -> DataFrame:
    """The pairs of a group that the components in `named` do not join yet, as far as sizes and parities let them be similar.

    Sets that meet in many groups are a row in few of them: a group leaves out a pair whose two sets both tell of a lesser
    group of theirs, where the pair meets too. The least of all their groups never leaves it out.
    """
    facts = ["n", "sketch"]
    named = nodes.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"), *facts)
    sizes = groups.join(named.select("node", "component"), "node").groupBy("grp").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("copies"))
    open_ = written(sizes.where("low <> high").select("grp", "copies", F.ceil(F.col("copies") / TILE).cast("int").alias("tiles")), "open")
    total = groups.count()
    told = met(groups, open_, "grp", total).groupBy("node").agg(F.slice(F.array_sort(F.collect_set("grp")), 1, TOLD).alias("told"))
    named = written(named.join(told, "node"), "told")
    # A large group is cut in tiles, and each pair of tiles goes to a task of its own.
    tile = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    tiled = met(groups, open_, "grp", total).withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = tiled.select(F.xxhash64("grp", F.least("tile", "other"), F.greatest("tile", "other")).alias("task"), "grp", "node", "tile", (F.col("tile") == F.col("other")).alias("same"))
    dealt = dealt.join(named, "node").select("task", "node", "component", "tile", "same", *facts, "grp", "told")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (found := list(batches)):
            return
        table = pa.Table.from_batches(found)
        grp, node, comp, tile, same, size = (table.column(k).to_numpy() for k in range(6))
        place = table.column(7).to_numpy()  # the group itself; grp is one of its pairs of tiles
        order = np.lexsort((node, comp, grp))
        grp, node, comp, tile, same, size, place = (x[order] for x in (grp, node, comp, tile, same, size, place))
        # A set's sketch is the same in all its groups.
        _, first, of = np.unique(node, return_index=True, return_inverse=True)
        sketches = Sketches(table.column(6).combine_chunks().take(pa.array(order[first])))
        lists = table.column(8).combine_chunks().take(pa.array(order[first]))
        count = np.asarray(pa.compute.list_value_length(lists), np.int64)
        told = np.full((len(first), TOLD), np.iinfo(np.int64).max)
        told[np.arange(TOLD) < count[:, None]] = lists.flatten().to_numpy()
        last = np.searchsorted(grp, grp, "right")
        starts = np.flatnonzero(np.r_[True, (grp[1:] != grp[:-1]) | (comp[1:] != comp[:-1])])
        after = np.repeat(np.r_[starts[1:], len(grp)], np.diff(np.r_[starts, len(grp)]))  # where a row's component ends
        many = np.cumsum(last - after)
        k = 0
        while k < len(grp):
            z = max(k + 1, int(np.searchsorted(many, (many[k - 1] if k else 0) + PAIRS_AT_ONCE, "right")))
            n = last[k:z] - after[k:z]
            i = np.repeat(np.arange(k, z), n)
            j = np.repeat(after[k:z], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            ok = ((tile[i] != tile[j]) | same[i]) & (5 * np.minimum(size[i], size[j]) >= 4 * np.maximum(size[i], size[j]))
            i, j = i[ok], j[ok]
            ok = 9 * sketches.differ(of[i], of[j]) <= size[i] + size[j]
            i, j = i[ok], j[ok]
            ok = ~_met_before(told[of[i]], told[of[j]], place[i])
            i, j = i[ok], j[ok]
            pairs = np.unique(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])], 1), axis=0)
            yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])
            k = z

    tasks = max(groups.sparkSession.sparkContext.defaultParallelism, total // 200_000)
    return written(dealt.repartition(tasks, "task").mapInArrow(each, "a long, b long"), "apart").distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH, tries=None) -> DataFrame:
    """(id, key, times, component) of the distinct (id, text) in docs: key is a hash of the text, times how many rows have both.

    Components are those of all links of a similarity of 0.8 or more, and named by a set. Texts with equal sets are linked,
    so also all that are null, empty or without words. tries(fps, n), if given, brings the first links, (a, b) between the
    n distinct fingerprints in column fp; they are compared like any others.
    """
    met_ = _meetings(docs, width)
    facts = ["node", "n", "sketch"]
    rows = met_.where("grp is null").groupBy("id", "key", "node").agg(F.count("*").alias("times"))
    nodes = written(met_.where("grp is null").groupBy(*facts).agg(F.min("key").alias("key"), F.min("fp").alias("fp")), "nodes")
    groups = _narrowed(met_.where("grp is not null").select("grp", "node"))
    likely = _chains(groups)
    if tries is not None:
        # One set stands for all of its fingerprint in links of fingerprints; within a fingerprint sets are neighbours.
        classes = nodes.groupBy("fp").agg(F.min("node").alias("node"))
        linked = written(tries(classes.select("fp"), classes.count()), "tries")
        end = lambda c: classes.select(F.col("fp").alias(c), F.col("node").alias(f"{c}_node"))
        pairs = linked.join(end("a"), "a").join(end("b"), "b").select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))
        likely = _chains(nodes.select(F.col("fp").alias("grp"), "node")).union(pairs).union(likely).distinct()
    found = similar(docs, nodes, likely, width)
    rest = _apart(groups, nodes, written(components(found), "joined"))
    found = found.unionByName(similar(docs, nodes, rest, width))
    rows = written(rows, "rows")
    named = rows.groupBy("node").agg(F.count("*").alias("copies")).join(components(found), "node", "left")
    named = named.select("node", F.coalesce("component", "node").alias("component"), "copies")
    return written(met(rows, named, "node", rows.count()).drop("node"), "named")


def keep_one(docs: DataFrame, width: int = WIDTH, tries=None) -> DataFrame:
    """One row of each component of near_duplicates: that of the smallest doc_id (see simhash_dedup.keep_one)."""
    named = near_duplicates(docs, width, tries)
    heads = named.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("head"), F.count("*").alias("copies"))
    judged = met(named, heads, "component", named.count())
    stays = F.col("id").eqNullSafe(F.col("head.id")) & (F.col("key") == F.col("head.key"))
    gone = judged.where(~stays).select(F.col("id").alias("i"), F.col("key").alias("k"))
    again = written(judged.where(stays & (F.col("times") > 1)).select(F.col("id").alias("i"), F.col("key").alias("k")), "again")
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key"))
    same = lambda t: own_["id"].eqNullSafe(t["i"]) & (own_["key"] == t["k"])
    own_ = own
    out = own.join(gone, same(gone), "left_anti")
    if not again.isEmpty():
        own_ = out
        one = out.join(again, same(again), "left_semi").groupBy("id", "key").agg(F.min_by("row", F.to_json("row")).alias("row"))
        out = out.join(again, same(again), "left_anti").select("row").unionByName(one.select("row"))
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
