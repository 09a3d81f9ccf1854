"""Substring dedup: windows of `width` consecutive words that another document with a smaller id also holds are removed.

Documents are dealt to blocks by a hash of their id and text. A block takes the Rabin-Karp hash of every window and sends, packed by
ranges of the hash, each distinct hash with the smallest id that holds it here. What holds a range of the hash counts where
each hash starts, and tells a block which of its hashes begin in a smaller document elsewhere. The block, whose texts
come from the same shuffle, then removes the windows that lost, here or elsewhere; overlapping windows merge into maximal
intervals of words.

Hashes are 64 bits wide and not compared word by word: n windows have a chance of about n / 2**64 each to be taken for another.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, fields, whole, windows

WIDTH = 50
BLOCK_BYTES, RANGE_WINDOWS, BYTES_A_WORD = 4 << 20, 2_000_000, 6
#: A block sends a piece to each range: beyond this many bytes of text both grow with its square root, up to so many times
#: (a task then holds 64 MB of text, or 32 million windows).
GROWS_FROM, MOST_GROWTH = 8 << 30, 16.0


def squeezed(planes: np.ndarray) -> bytes:
    return pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def swelled(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, n, "zstd", asbytes=True), np.uint8)


def pack(values: np.ndarray) -> bytes:
    """64-bit numbers as differences, byte planes apart, compressed."""
    values = values.view(np.uint64)
    planes = np.diff(values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    return len(values).to_bytes(8, "little") + squeezed(planes)


def unpack(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    planes = swelled(blob[8:], 8 * n).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _windows(ids: pa.Array, texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: each window's hash, row and first word, and the words of each row. Rows without an id take no part."""
    hashes, rows, words, counts, before = [], [], [], [], 0
    known = np.asarray(ids.is_valid())
    for start, part in chunks(texts):
        w = Words(part)
        h = windows(w.hashes(), width)
        good = np.flatnonzero(whole(w.first, w.counts, width, len(h)))
        row = w.rows()[good] + start
        good, row = good[known[row]], row[known[row]]
        hashes.append(h[good])
        rows.append(row.astype(np.int32))
        words.append(good + before)
        counts.append(w.counts)
        before += len(w.starts)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(rows), np.concatenate(words), np.concatenate(counts)


def _runs(h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by hash, where each hash starts in it, and its smallest id."""
    order = np.argsort(h)
    sorted_h = h[order]
    starts = np.flatnonzero(np.r_[True, sorted_h[1:] != sorted_h[:-1]])
    return order, starts, np.minimum.reduceat(ids[order], starts)


def repeated_windows(docs: DataFrame, width: int = WIDTH, digest: bool = False, unchanged: bool = True, carry: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_words, n_removed, spans, and kept (or, if digest, only kept_sha256).

    carry: columns of docs that come along, as the struct `rest`.
    unchanged: if False, kept is null where no word goes, so that such a text is not made a second time.

    spans: the maximal intervals [first, past) of word numbers that go. kept: the other words joined by one space.
    A text that is null or has no words gives 0, 0, no spans and an empty kept; one of fewer than `width` words loses none.
    Rows that repeat an id are documents of equal rank: none removes what another holds. A row whose id is null is kept
    whole and removes nothing. Texts are taken whole; a very long one is a block of its own size.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.struct(*([F.col(f"`{c}`") for c in carry] or [F.lit(0).alias("none")])).alias("rest"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    growth = min(MOST_GROWTH, max(1.0, (total / GROWS_FROM) ** 0.5))
    blocks, ranges = int(total / (growth * BLOCK_BYTES)) + 1, int(total / (growth * BYTES_A_WORD * RANGE_WINDOWS)) + 1
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int")).repartitionById(blocks, "block")

    def count(key, table):
        ids = table.column("id").combine_chunks()
        h, row, _, _ = _windows(ids, table.column("text"), width)
        out = []
        if len(h):
            order, starts, least = _runs(h, ids.fill_null(0).to_numpy()[row])
            distinct = h[order][starts]
            known, at = np.unique(least, return_inverse=True)
            edges = np.searchsorted(distinct, np.array([(k << 64) // ranges for k in range(ranges)], np.uint64)).tolist() + [len(distinct)]
            out = [(k, key[0].as_py(), pack(distinct[a:b]), pack(known), squeezed(at[a:b].astype(np.uint32).view(np.uint8).reshape(-1, 4).T)) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, sent, strict=True)], names)

    sent, names = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()], ["part", "block", "hashes", "known", "least"]

    def judge(table):
        # Straight into arrays of the whole range, from the pieces as they came: a worker has room for each only once.
        blobs = lambda c: (x.as_buffer() for x in table.column(c))
        of = table.column("block").to_pylist()
        sizes = [int.from_bytes(x[:8], "little") for x in blobs("hashes")]
        h, ids, block = np.empty(sum(sizes), np.uint64), np.empty(sum(sizes), np.int64), np.repeat(np.arange(len(of), dtype=np.int32), sizes)
        end = 0
        for size, a, known, at in zip(sizes, *(blobs(c) for c in names[2:]), strict=True):
            own = slice(end, end := end + size)
            h[own] = unpack(a)
            index = swelled(at, 4 * size).reshape(4, -1).T
            ids[own] = unpack(known).view(np.int64)[np.ascontiguousarray(index).view(np.uint32).ravel()]
        order, starts, least = _runs(h, ids)
        n = np.diff(np.r_[starts, len(h)])
        beyond = ids[order]
        beyond -= np.repeat(least, n)  # as bits, since it may pass the ends
        lost = order[beyond != 0]
        lost = lost[np.lexsort((h[lost], block[lost]))]
        who, first = np.unique(block[lost], return_index=True)
        edges = [*first.tolist(), len(lost)]
        return pa.table({"block": pa.array([of[k] for k in who], pa.int32()), "lost": pa.array([pack(h[lost[a:b]]) for a, b in zip(edges, edges[1:], strict=False)], pa.binary())})

    def remove(table, told):
        ids, texts = table.column("id").combine_chunks(), table.column("text").combine_chunks()
        h, row, word, counts = _windows(ids, texts, width)
        gone = np.zeros(int(counts.sum()) + 1, np.int32)
        if len(h):
            number = ids.fill_null(0).to_numpy()[row]
            order, starts, least = _runs(h, number)
            distinct, loses = h[order][starts], np.zeros(len(starts), bool)
            for blob in told.column("lost").to_pylist():
                loses[np.searchsorted(distinct, unpack(blob))] = True
            n = np.diff(np.r_[starts, len(h)])
            off = word[order[(number[order] > np.repeat(least, n)) | np.repeat(loses, n)]]
            np.add.at(gone, off, 1)
            np.add.at(gone, off + width, -1)
        gone = np.cumsum(gone[:-1]) > 0
        rest = table.column("rest").combine_chunks()
        rest = pa.StructArray.from_arrays(rest.flatten(), [f.name for f in rest.type])  # all may be null
        spans, kept, removed = [], [], []
        first = np.r_[0, np.cumsum(counts)]
        for k, text in enumerate(texts.cast(pa.binary())):
            mask = gone[first[k] : first[k + 1]]
            turns = np.flatnonzero(np.diff(mask, prepend=False, append=False)).tolist() if mask.any() else []
            spans.append([{"first": a, "past": b} for a, b in zip(turns[::2], turns[1::2], strict=True)])
            removed.append(int(mask.sum()))
            if not (turns or unchanged):
                kept.append(None)
                continue
            words = (text.as_py() or b"").split()
            left = words if not turns else [w for a, b in zip([0, *turns[1::2]], [*turns[::2], len(words)], strict=True) for w in words[a:b]]
            line = b" ".join(left)
            kept.append(hashlib.sha256(line).hexdigest() if digest else line)
        last = pa.array(kept, pa.string()) if digest else pa.array(kept, pa.binary()).cast(pa.string())
        return pa.Table.from_arrays([rest, ids, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))), last], ["rest", "id", "n_words", "n_removed", "spans", "kept_sha256" if digest else "kept"])

    packed = dealt.groupBy("block").applyInArrow(count, "part int, block int, hashes binary, known binary, least binary")
    lost = packed.repartitionById(ranges, "part").groupBy("part").applyInArrow(judge, "block int, lost binary").repartitionById(blocks, "block")
    out = fields(rows, "rest", after=f"id long, n_words long, n_removed long, spans array<struct<first: long, past: long>>, {'kept_sha256' if digest else 'kept'} string")
    return dealt.groupBy("block").cogroup(lost.groupBy("block")).applyInArrow(remove, out)


def clean(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with each text that loses words replaced by its kept words; other texts and columns stay as they are.

    n_chars, if there is one, follows the new text. A document that loses all its words stays with an empty text.
    """
    found = repeated_windows(docs, width, unchanged=False, carry=tuple(docs.columns))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("rest.text"))
    new = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.char_length("kept").cast("long")).otherwise(F.col("rest.n_chars"))}
    return found.select(*(new.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return repeated_windows(docs, digest=True).select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


SQL = """
WITH words AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents)
), windows AS (
  SELECT doc_id, i, word, CASE WHEN count(*) OVER w = 50 THEN string_agg(word, ' ') OVER w END AS own
  FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)
), lost AS (
  SELECT doc_id, i, word, coalesce(own IS NOT NULL AND min(doc_id) OVER (PARTITION BY own) < doc_id, false) AS begins FROM windows
), cover AS (
  SELECT doc_id, i, word, bool_or(begins) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM lost
), counted AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept
  FROM cover GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN counted USING (doc_id)"""
