"""Modified Kneser-Ney over words: every text's log-probability, by the model of the texts of the other half.

The texts are dealt to two halves by the least hash of their four-word windows, so that no text, nor a copy of it, is judged
by what was counted in it, and most near copies aren't either. Each model is of all texts of its half. Each is interpolated down to a spelling of the word, so no word is impossible.

Texts become blocks of one half: a dictionary of word hashes and the numbers of the words in it, written once, in a table
that is bucketed by block, so that answers come to the blocks. For each order, from the longest down, a block sends the sorted
hashes of its n-grams with what it has counted for them, packed by ranges of the hash. What holds a range adds up for each
half, answers each block in the block's own order with the sums of the other half, and names one block of each half the owner
of the n-gram there, with its count. Only the owner counts it once more for the shorter orders: as one more word before its
last words, and in the sums of its context. So each n-gram of a block is one number in one range, however frequent it or its
words are. What only the counting takes is deleted when its order is done.

Hashes are not compared by word: n distinct n-grams have a chance of about n / 2**b each to be taken for another, where b is
EXTRA_BITS more than the bits of the number of all places (64 at most), n distinct words one of n / 2**48.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, chunks, mix, removed, reused, whole, windows, workspace, written
from .substring_dedup import pack, squeezed, swelled, unpack

ORDER = 3
BLOCK_WORDS, RANGE_KEYS = 3 << 19, 1_000_000
#: The ranges of an order are asked for in so many rounds, so that only a part of the n-grams is on disk at once.
ROUNDS = {3: 2, 2: 3, 1: 2}
#: The texts are scored in so many rounds of blocks, for the same reason.
LAST_ROUNDS = 3
_BEGIN, _END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: Of an n-gram's hash as many bits are kept as the number of all places has, and EXTRA_BITS more. Of a word's hash 48 are kept.
EXTRA_BITS, _WORD_DROP = 24, np.uint64(16)
#: What is asked of an n-gram: its count and, but for the longest, of it as a context: n-grams counted once, twice and more often, and the sum of what counts have over 3.
_FIRST, _ROWS = 1, 5
_OTHER, _OWN, _STATS = 0, 1, 2


def discounts(n: list[int]) -> np.ndarray:
    """What is taken from counts of 0, 1, 2 and more, from the numbers of n-grams counted 1 to 4 times."""
    t = [max(k, 1) for k in n]
    y = t[0] / (t[0] + 2 * t[1])
    cuts = np.clip([0.0, 1 - 2 * y * t[1] / t[0], 2 - 3 * y * t[2] / t[1], 3 - 4 * y * t[3] / t[2]], 0.0, [0.0, 0.99, 1.99, 2.99])
    cuts[1:] = np.maximum(cuts[1:], 0.01)
    return cuts


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Within it the shuffle files of a query go when it ends."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _packed(keys: np.ndarray) -> bytes:
    """Sorted hashes as differences, each plane of bytes compressed by itself."""
    planes = [squeezed(x) for x in np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T]
    return np.array([len(x) for x in planes], np.uint32).tobytes() + b"".join(planes)


def _unpacked(blob: bytes, n: int) -> np.ndarray:
    cuts = np.cumsum([32, *np.frombuffer(blob, np.uint32, 8).tolist()]).tolist()
    planes = np.empty((n, 8), np.uint8)
    for k in range(8):
        planes[:, k] = swelled(blob[cuts[k] : cuts[k + 1]], n)
    return np.cumsum(planes.view(np.uint64).ravel(), dtype=np.uint64)


def _smalls(rows: list[np.ndarray], edges: list[int]) -> list[bytes]:
    """Counts, most of them small, in pieces. A column of them is one symbol of two bits a row, 3 for what is larger. One bit tells
    where the most frequent symbol stands; the others and what counts have over 3 follow, those over 255 apart."""
    size = len(rows[0])
    code, overs, ends = np.zeros(size, np.uint16), [], []
    for k, v in enumerate(rows):
        code |= np.minimum(v, 3).astype(np.uint16) << np.uint16(2 * k)
        at = np.flatnonzero(v >= 3)
        overs.append(v[at].astype(np.int64) - 3)
        ends.append(np.searchsorted(at, edges).tolist())
    common = int(np.bincount(code).argmax()) if size else 0
    rare = np.flatnonzero(code != common)
    ends.append(np.searchsorted(rare, edges).tolist())
    usual, rest = code == common, code[rare]
    planes = [rest.astype(np.uint8)] + [(rest >> np.uint16(8)).astype(np.uint8)] * (len(rows) > 4)
    out = []
    for i in range(len(edges) - 1):
        a, b = ends[-1][i], ends[-1][i + 1]
        over = np.concatenate([v[e[i] : e[i + 1]] for v, e in zip(overs, ends, strict=False)])
        large = over[over >= 255]
        parts = [squeezed(np.packbits(usual[edges[i] : edges[i + 1]])), *(squeezed(x[a:b]) for x in planes), squeezed(np.minimum(over, 255).astype(np.uint8))]
        out.append(np.array([common, b - a, len(over), len(large), *map(len, parts)], np.uint32).tobytes() + large.tobytes() + b"".join(parts))
    return out


def _small(rows: list[np.ndarray]) -> bytes:
    return _smalls(rows, [0, len(rows[0])])[0]


def _counts(blob: bytes, rows: int, n: int) -> np.ndarray:
    width = 7 + (rows > 4)
    common, rare, over, large, *sizes = np.frombuffer(blob, np.uint32, width).tolist()
    start = 4 * width + 8 * large
    cuts = [start, *(start + x for x in np.cumsum(sizes).tolist())]
    parts = [swelled(blob[a:b], m) for a, b, m in zip(cuts, cuts[1:], [-(-n // 8), *[rare] * (width - 6), over], strict=False)]
    code = np.full(n, common, np.uint16)
    rest = parts[1].astype(np.uint16)
    if rows > 4:
        rest |= parts[2].astype(np.uint16) << np.uint16(8)
    code[np.unpackbits(parts[0], count=n) == 0] = rest
    more = parts[-1].astype(np.int64)
    more[more == 255] = np.frombuffer(blob, np.int64, large, 4 * width)
    out, done = np.empty((rows, n), np.int64), 0
    for k in range(rows):
        out[k] = code >> np.uint16(2 * k) & np.uint16(3)
        at = np.flatnonzero(out[k] == 3)
        out[k, at] += more[done : done + len(at)]
        done += len(at)
    return out


def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of hashes in their order, and which of these is the first of its hash: their high bits are sorted with their places in the low ones."""
    bits = len(keys).bit_length()
    low = np.uint64((1 << bits) - 1)
    packed = keys & ~low
    packed |= np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    order = (packed & low).view(np.int64)
    packed >>= np.uint64(bits)
    new = np.ones(len(keys), bool)
    alike = np.flatnonzero(packed[1:] == packed[:-1]) + 1
    found, before = keys[order[alike]], keys[order[alike - 1]]
    if (found < before).any():  # two that are alike but for low bits
        order = np.argsort(keys, kind="stable")
        found = keys[order]
        new[1:] = found[1:] != found[:-1]
    else:
        new[alike] = found != before
    return order, new


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique(keys, return_inverse=True) of hashes."""
    order, new = _sorted(keys)
    number = np.empty(len(keys), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return keys[order[new]], number


def firsts(keys: np.ndarray) -> np.ndarray:
    """np.unique(keys, return_index=True)[1] of hashes."""
    order, new = _sorted(keys)
    return order[new]


#: An n-gram's hash is the sum of its words' hashes, the last's times the first of these.
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


class _Block:
    """The lines of a block's texts, all of one half: ORDER - 1 times _BEGIN, the words, _END. bits: how many of an n-gram's hash are kept."""

    def __init__(self, counts: bytes, words: bytes, tokens: bytes, bits: int):
        n = np.frombuffer(counts, np.int64)
        total = int(n.sum())
        sizes = n + ORDER
        self.starts = np.cumsum(sizes) - sizes
        self.real = np.ones(int(sizes.sum()), bool)
        for k in range(ORDER - 1):
            self.real[self.starts + k] = False
        # All 64 bits of a word's hash have to vary, else those of an n-gram don't.
        self.words = np.r_[mix(unpack(words) << _WORD_DROP), _END, _BEGIN]
        self.begin = len(self.words) - 1
        self.number = np.full(len(self.real), self.begin, np.int32)
        ends = self.starts + sizes - 1
        self.real[ends] = False
        self.number[self.real] = np.ascontiguousarray(swelled(tokens, 4 * total).reshape(4, total).T).view(np.int32).ravel()
        self.real[ends] = True
        self.number[ends] = self.begin - 1
        self.n, self.keep = n, np.uint64((1 << 64) - (1 << 64 - bits))

    def hashes(self, *orders: int) -> list[np.ndarray]:
        """Of the n-grams of some orders, rising, that end at each place; those at the first places are not whole."""
        line, out, done = self.words[self.number], [], 1
        sums = line * _ODD[0]
        for k in orders:
            for i in range(done, k):
                sums[i:] += line[:-i] * _ODD[i]
            done = max(done, k)
            out.append(sums & self.keep)
        return out

    def grams(self, k: int, least: int = 0, below: int = 1 << 64, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The sorted hashes of the n-grams of order k from least on and under below, and for each place the number of the one that ends there, else -1."""
        if k == 1:  # those of the dictionary
            keys, of = numbered(self.words * _ODD[0] & self.keep)
            edges = [int(np.searchsorted(keys, np.uint64(x))) if x < 1 << 64 else len(keys) for x in (least, below)]
            of = np.where((of >= edges[0]) & (of < edges[1]), of - edges[0], -1).astype(np.int32)
            at = of[self.number]
            at[~self._used(1)] = -1
            return keys[edges[0] : edges[1]], at
        hashes = self.hashes(k)[0] if hashes is None else hashes
        used = self._used(k)
        if least > 0:
            used = used & (hashes >= np.uint64(least))
        if below < 1 << 64:
            used = used & (hashes < np.uint64(below))
        used = np.flatnonzero(used)
        keys, of = numbered(hashes[used])
        at = np.full(len(self.number), -1, np.int32)
        at[used] = of
        return keys, at

    def _used(self, k: int) -> np.ndarray:
        if k == ORDER:
            return self.real
        used = self.real.copy()  # and contexts of a text's first word
        used[self.starts + ORDER - 2] = True
        return used

    def asked(self, k: int, above: np.ndarray | None, least: int = 0, below: int = 1 << 64) -> tuple[np.ndarray, list[np.ndarray]]:
        """The hashes of order k in an interval and this block's share of their counts. above: the answers on order k + 1."""
        own, *longer = self.hashes(k) if above is None else self.hashes(k, k + 1)
        keys, at = self.grams(k, least, below, own)
        size = len(keys) + 1  # the first for places outside
        at += 1
        if above is None:
            return keys, [np.bincount(at[self.real], minlength=size)[1:]]
        used = np.flatnonzero(self._used(k + 1))
        c = above[-1]
        owned = np.flatnonzero(c > 0)
        c, place = c[owned], used[firsts(longer[0][used])[owned]]
        ends = at[place]
        mine = np.flatnonzero(ends)
        mine = mine[self.number[place[mine] - (k - 1)] != self.begin]
        counts = np.bincount(ends[mine], minlength=size)
        for i in range(k - 1):  # nothing stands before these, so their own counts count
            places = self.starts[self.n >= i] + ORDER - 1 + i
            counts += np.bincount(at[places], minlength=size)
        context = at[place - 1]
        mine = np.flatnonzero(context)
        context, c = context[mine].astype(np.int64), c[mine]
        kinds = np.bincount(4 * context + np.minimum(c, 3), minlength=4 * size).reshape(size, 4)[1:]
        over = np.flatnonzero(c > 3)
        over = np.bincount(context[over], c[over] - 3, minlength=size)[1:].astype(np.int64)
        return keys, [counts[1:], kinds[:, 1], kinds[:, 2], kinds[:, 3], over]

    def log10_p(self, answers: dict[int, np.ndarray], stats: dict[int, np.ndarray], spelled: np.ndarray) -> np.ndarray:
        """Of each text. stats: of the other half. spelled: of each word of the dictionary and, last, of an end."""
        real = np.flatnonzero(self.real)
        word = self.number[real]
        p = (10.0**spelled)[word]
        least = np.flatnonzero((spelled < -250)[word])  # of very long words, which a double holds as a logarithm only
        log_p = spelled[word[least]]
        hashes = self.hashes(*range(1, ORDER + 1))
        for k in range(1, ORDER + 1):
            at = self.grams(k, hashes=hashes[k - 1])[1]
            off = discounts(list(stats[k][:4]))
            c = answers[k][0]
            own = (c - off[np.minimum(c, 3)])[at[real]]
            if k == 1:
                total, ones, twos, more = (np.full(1, stats[1][i]) for i in (4, 0, 1, 6))
            else:
                ones, twos, more, total = answers[k - 1][1:5]
                total = total + ones + 2 * twos + 3 * more
            some = np.maximum(total, 1)
            weight = np.where(total > 0, (off[1] * ones + off[2] * twos + off[3] * more) / some, 1.0)
            if k == 1:
                own /= some[0]
            else:
                of = shorter[real - 1]
                own /= some[of]
                weight = weight[of]
            p = own + weight * p
            own, weight = own[least], weight[least] if k > 1 else weight
            with np.errstate(divide="ignore"):
                log_p = np.where(own > 0, np.log10(own + weight * 10.0**log_p), np.log10(weight) + log_p)
            shorter = at
        with np.errstate(divide="ignore"):
            p = np.log10(p)
        p[least] = log_p
        return np.add.reduceat(p, np.cumsum(self.n + 1) - (self.n + 1))


_PACKED = ("counts", "words", "tokens")


def halves(w: Words, h: np.ndarray) -> np.ndarray:
    """0 or 1 for each text of a chunk; h: the hashes of its words."""
    wide = windows(np.r_[h, np.zeros(3, np.uint64)], 4)
    fits = whole(w.first, w.counts, 4, len(h))[: len(h)] if len(h) > 3 else np.zeros(len(h), bool)
    fits = np.r_[fits, np.zeros(len(h) - len(fits), bool)] | (np.repeat(w.counts, w.counts) < 4)
    alone = np.flatnonzero(np.repeat(w.counts, w.counts) < 4)
    wide[alone] = mix(h[alone])
    wide[~fits] = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.zeros(len(w.counts), np.uint64)
    some = w.counts > 0
    if some.any():
        out[some] = np.minimum.reduceat(wide, w.first[:-1][some])
    return (mix(out) & np.uint64(1)).astype(np.uint8)


def _blocks(rows: DataFrame, names: tuple[str, ...], measures: Callable, spelled: Callable) -> DataFrame:
    """Blocks of whole texts of one half, of about BLOCK_WORDS words. The more frequent words come first in a block's dictionary."""
    enough = BLOCK_WORDS

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list[tuple], list[tuple]] = ([], [])

        def flush(half: int) -> pa.RecordBatch:
            ids, lang, found, hashes, known, spellings = zip(*held[half], strict=True)
            held[half].clear()
            words, number = numbered(np.concatenate(hashes))
            often = np.frexp(np.bincount(number, minlength=len(words)).astype(float))[1]
            order = np.lexsort((words, -often))
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            number = place[number]
            first = firsts(np.concatenate(known))[order]
            found = [np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True)]
            each_once = pa.concat_arrays([*spellings, pa.array([""], pa.large_string())]).take(pa.array(np.r_[first, sum(map(len, known))]))  # and an end
            p = np.concatenate([spelled(Words(part)) for _, part in chunks(each_once)])
            out = {
                "block": [uuid.uuid4().int >> 65], "half": [half], "places": [len(number) + len(found[0])], "ids": [pa.concat_arrays(ids)], "langs": [pa.concat_arrays(lang)], "found": [squeezed(np.stack(found))], "counts": [found[0].tobytes()],
                "words": [pack(words[order] >> _WORD_DROP)], "tokens": [pa.Codec("zstd", 3).compress(number.view(np.uint8).reshape(-1, 4).T.tobytes(), asbytes=True)], "spelled": [p.astype(np.float32).view(np.uint8).reshape(-1, 4).T.tobytes()],
            }
            types = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), *[pa.binary()] * 5]
            return pa.record_batch([pa.array([v[0].to_pylist()] if k in ("ids", "langs") else v, t) for (k, v), t in zip(out.items(), types, strict=True)], list(out))

        with reused():
            for b in batches:
                for start, part in chunks(b.column(2)):
                    w = Words(part)
                    h = w.hashes()
                    half, found = halves(w, h), measures(w, part, h)
                    h = h >> _WORD_DROP << _WORD_DROP
                    of = np.repeat(half, w.counts)
                    for f in np.unique(half).tolist():
                        texts, mine = np.flatnonzero(half == f), np.flatnonzero(of == f)
                        at = mine[firsts(h[mine])]
                        known = h[at]
                        sizes = (w.ends - w.starts)[at]
                        edges = np.r_[0, np.cumsum(sizes)]
                        data = w.data[np.arange(edges[-1]) + np.repeat(w.starts[at] - edges[:-1], sizes)]
                        own = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
                        cut = lambda k: b.column(k).slice(start, len(part)).take(pa.array(texts))  # noqa: B023, E731
                        held[f].append((cut(0), cut(1), [x[texts] for x in found], h[mine], known, own))
                        if sum(len(x[3]) for x in held[f]) >= enough:
                            yield flush(f)
            for f in (0, 1):
                if held[f]:
                    yield flush(f)

    return rows.select("id", "lang", "text").mapInArrow(each, "block long, half int, places long, ids array<long>, langs array<string>, found binary, counts binary, words binary, tokens binary, spelled binary")


def _answer(told: pa.Table, k: int, rows: int) -> np.ndarray:
    """A block's answers on order k in the order of its hashes."""
    told = told.filter(pa.compute.equal(told.column("k"), k)).sort_by("part")
    found = [_counts(r["blob"], rows, r["n"]) for r in told.to_pylist()]
    return np.concatenate(found, axis=1) if found else np.zeros((rows, 0), np.int64)


def _ask(blocks: DataFrame, above: DataFrame | None, k: int, ranges: int, rounds: range, bits: int) -> DataFrame:
    """(part, block, half, n, hashes, blob): what the blocks have of order k in some of the ranges; part counts from the first of them."""
    names, types = ["part", "block", "half", "n", "hashes", "blob"], [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    ddl = "part int, block long, half int, n long, hashes binary, blob binary"
    bounds = [-(-(r << 64) // ranges) for r in range(rounds.start, rounds.stop + 1)]
    drop = np.uint64(64 - bits)

    def of(block, half, row, found):
        keys, rows = _Block(*row, bits).asked(k, found, bounds[0], bounds[-1])
        edges = [0, *np.searchsorted(keys, np.array(bounds[1:-1], np.uint64)).tolist(), len(keys)]
        keys, blobs = keys >> drop, _smalls(rows, edges)
        for part in range(len(rounds)):
            if (a := edges[part]) < (b := edges[part + 1]):
                yield part, block, half, b - a, _packed(keys[a:b]), blobs[part]

    def table(out):
        return [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, types, strict=True)]

    def each(batches):
        for b in batches:
            for block, half, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with reused():
                    out = list(of(block, half, row, None))
                yield pa.record_batch(table(out), names)

    def met(mine, told):
        with reused():
            out = [x for r in mine.to_pylist() for x in of(r["block"], r["half"], [r[c] for c in _PACKED], _answer(told, k + 1, 1))]
        return pa.Table.from_arrays(table(out), names)

    own = blocks.select("block", "half", *_PACKED)
    return own.mapInArrow(each, ddl) if above is None else own.groupBy("block").cogroup(above.groupBy("block")).applyInArrow(met, ddl)


def _hold(asked: DataFrame, k: int, ranges: int, rounds: range, bits: int) -> DataFrame:
    """(kind, block, k, part, n, blob): what blocks asked for, of the other half; a block's counts in its own half where it is the owner, else 0; what discounts need of the range."""
    rows = _FIRST if k == ORDER else _ROWS
    names, types = ["kind", "block", "k", "part", "n", "blob"], [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    drop = np.uint64(64 - bits)

    def hold(table):
        table = table.sort_by([("half", "ascending"), ("block", "ascending")])
        block, half, n = (table.column(c).to_pylist() for c in ("block", "half", "n"))
        part = table.column("part")[0].as_py() + rounds.start
        keys = np.concatenate([_unpacked(x.as_py(), m) for x, m in zip(table.column("hashes"), n, strict=True)]) << drop
        values = np.concatenate([_counts(x.as_py(), rows, m) for x, m in zip(table.column("blob"), n, strict=True)], axis=1)
        keys -= np.uint64((part << 64) // ranges)
        found, number = numbered(keys << np.uint64(ranges.bit_length() - 1))  # spread over all 64 bits
        edge = sum(m for f, m in zip(half, n, strict=True) if f == 0)
        of = (slice(0, edge), slice(edge, len(keys)))
        sums = [np.bincount(number[x], values[0, x], minlength=len(found)).astype(np.int64) for x in of]
        stats = [[*((s == i).sum() for i in range(1, 5)), s.sum(), (s > 0).sum(), (s > 2).sum()] for s in sums]
        there = np.zeros((2, len(found)), bool)
        for f, x in enumerate(of):
            there[f, number[x]] = True
        both = there[0] & there[1]
        shared = [x.start + np.flatnonzero(both[number[x]]) for x in of]
        out, mine = np.zeros((rows, len(keys)), np.int64), np.zeros(len(keys), np.int64)
        for f, x in enumerate(of):
            asking, told = (number[shared[i]] for i in (f, 1 - f))
            out[0, shared[f]] = sums[1 - f][asking]
            for r in range(1, rows):
                out[r, shared[f]] = np.bincount(told, values[r, shared[1 - f]], minlength=len(found)).astype(np.int64)[asking]
            owner = np.full(len(found), -1)
            owner[number[x][::-1]] = np.arange(x.start, x.stop)[::-1]
            here = np.flatnonzero(owner >= 0)
            mine[owner[here]] = sums[f][here]
        edges = np.r_[0, np.cumsum(n)].tolist()
        told = [(_OTHER, b, k, part, m, blob) for b, m, blob in zip(block, n, _smalls(list(out), edges), strict=True)]
        if k > 1:
            told += [(_OWN, b, k, part, m, blob) for b, m, blob in zip(block, n, _smalls([mine], edges), strict=True)]
        told.append((_STATS, -1, k, part, 0, np.array(stats, np.int64).tobytes()))
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*told, strict=True), types, strict=True)], names)

    def held(table):
        with reused():
            return hold(table)

    return asked.repartitionById(len(rounds), "part").groupBy("part").applyInArrow(held, "kind int, block long, k int, part int, n long, blob binary")


@contextlib.contextmanager
def _bucketed(df: DataFrame, buckets: int):
    """The same rows, read from a table in the shared folder that is dealt by block, so that answers come to the blocks and these stay where they are,
    and that what blocks own is dealt to them once for all rounds. It goes at the end."""
    spark, path, name = df.sparkSession, workspace(df.sparkSession, "blocks"), f"blocks_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, "block").format("parquet").option("compression", "zstd").option("path", path).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")
        removed(spark, path)


def scored(rows: DataFrame, names: tuple[str, ...], measures: Callable, spelled: Callable, size: int = 0) -> DataFrame:
    """One row for each of rows (id, lang, text): id, lang, the measures (names; the first is the number of words), n_grams, log10_p.

    measures(words, texts, hashes of the words) and spelled(words) work on a chunk of texts, the second also on words as texts. A null text is
    empty. Where the other half has no texts, as in a table of one text, all words are spelled. size: about how many words
    there are; only tasks become larger where it is too small.
    """
    spark = rows.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BLOCK_WORDS + 1)
    with shuffles_dropped(spark), _bucketed(_blocks(rows, names, measures, spelled), buckets) as blocks:
        size = blocks.agg(F.sum("places").alias("places"), F.sum(F.octet_length("spelled") / 4).alias("words")).first()
        if size["places"] is None:
            return written(spark.createDataFrame([], _ddl(names)), "measures")
        bits = min(64, int(size["places"]).bit_length() + EXTRA_BITS)
        told, owned, stats, paths = [], [], {}, []
        for k in range(ORDER, 0, -1):
            entries = size["places"] if k > 1 else size["words"]
            ranges = int(entries / RANGE_KEYS) + 1
            many = min(ROUNDS[k], ranges)
            shares = np.cumsum([0, *(10 - r for r in range(many))])  # the later the smaller, as answers take room by then
            cuts = [int(ranges * x // shares[-1]) for x in shares]
            longer = _bucketed(reduce(DataFrame.unionByName, owned).repartition(buckets, "block"), buckets) if owned else contextlib.nullcontext()
            with longer as above:
                if owned:  # copied
                    for path in paths[-len(owned) :]:
                        removed(spark, f"{path}/kind={_OWN}")
                owned = []
                for r in range(many):
                    mine = range(cuts[r], cuts[r + 1])
                    found = _hold(_ask(blocks, above, k, ranges, mine, bits), k, ranges, mine, bits)
                    paths.append(workspace(spark, f"order-{k}"))
                    found.write.partitionBy("kind").parquet(paths[-1])
                    found = spark.read.schema(found.schema).parquet(paths[-1])
                    told.append(found.where(F.col("kind") == _OTHER).drop("kind"))
                    owned.append(found.where(F.col("kind") == _OWN).drop("kind"))
                    for x in found.where(F.col("kind") == _STATS).select("blob").collect():
                        stats[k] = stats.get(k, 0) + np.frombuffer(x["blob"], np.int64).reshape(2, 7)

        def each(mine, answers):
            with reused():
                return judged(mine, answers)

        def judged(mine, answers):
            out = []
            for r in mine.to_pylist():
                block = _Block(*(r[c] for c in _PACKED), bits)
                p = block.log10_p({k: _answer(answers, k, _FIRST if k == ORDER else _ROWS) for k in range(1, ORDER + 1)}, {k: s[1 - r["half"]] for k, s in stats.items()}, np.ascontiguousarray(np.frombuffer(r["spelled"], np.uint8).reshape(4, -1).T).view(np.float32).ravel().astype(float))
                found = swelled(r["found"], 8 * len(names) * len(p)).view(np.int64).reshape(len(names), -1)
                out.append(pa.table([pa.array(r["ids"], pa.int64()), pa.array(r["langs"], pa.string()), *map(pa.array, found), pa.array(block.n + 1), pa.array(p)], ["id", "lang", *names, "n_grams", "log10_p"]))
            return pa.concat_tables(out)

        answers = reduce(DataFrame.unionByName, told)
        out = []
        for r in range(LAST_ROUNDS):
            mine, told = (x.where(F.pmod("block", F.lit(LAST_ROUNDS)) == r) for x in (blocks, answers))
            out.append(written(mine.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(each, _ddl(names)), "measures"))
        for path in paths:
            removed(spark, path)
        return reduce(DataFrame.unionByName, out)


def _ddl(names: tuple[str, ...]) -> str:
    return f"id long, lang string, {', '.join(f'{c} long' for c in names)}, n_grams long, log10_p double"
