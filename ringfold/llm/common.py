"""Shared by the operators: the shared work folder, text blocks as numpy arrays, word hashes."""

from __future__ import annotations

import contextlib
import ctypes
import re
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: A word is a maximal run of characters other than these six.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that are turned into arrays at once.
CHUNK_BYTES = 1 << 20
#: A key that holds more than one row in so many is hot. There are fewer hot keys than this, whatever the input.
HOT_KEYS = 256

if "pyspark.worker" in sys.modules:
    # In Spark's Python workers, and only there: else glibc, once arrays of some MB were freed, keeps such memory in each
    # worker instead of giving it back. It has to be set before the first arrays.
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        pa.set_memory_pool(pa.system_memory_pool())

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = 0x9E3779B97F4A7C55
_P_INVERSE = pow(_P, -1, 1 << 64)


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder for an operator's tables, in the shared folder that the cluster names.

    Only where spark.checkpoint.dir is unset (as in tests, in local mode) a folder is made for it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="ringfold-")
        spark.sparkContext._jsc.sc().conf().set("spark.checkpoint.dir", shared)
        spark.sparkContext.setCheckpointDir(shared)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a table in the shared folder: cuts the lineage and survives lost executors."""
    path = workspace(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table that workspace() named, once nothing reads it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def planned_once(spark: SparkSession):
    """Within it queries of this session run as they are planned at first. Adaptive execution takes a driver's thread for each
    exchange, which lives for a minute more, so that a loop of many small exchanges gathers hundreds of them."""
    key = "spark.sql.adaptive.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def give_back() -> None:
    """Returns memory that this process has freed to the system; else Arrow and glibc keep it for later."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


@contextlib.contextmanager
def reused():
    """Within it one of Spark's Python workers keeps freed arrays of up to 32 MB for the next ones, which saves the system's
    clearing of each page; at the end it gives them back. Elsewhere nothing changes."""
    libc = None
    if "pyspark.worker" in sys.modules:
        with contextlib.suppress(OSError, AttributeError):
            libc = ctypes.CDLL("libc.so.6")
            libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
            libc.mallopt(-1, 256 << 20)  # M_TRIM_THRESHOLD
    try:
        yield
    finally:
        if libc:
            libc.mallopt(-3, 1 << 20)
            libc.mallopt(-1, 128 << 10)
            libc.malloc_trim(0)


def fields(of: DataFrame, name: str, before: str = "", after: str = "") -> StructType:
    """A schema with the column `name` of a table between others; other names may hold anything."""
    parts = lambda ddl: StructType.fromDDL(ddl).fields if ddl else []
    return StructType([*parts(before), StructField(name, of.schema[name].dataType.toNullable()), *parts(after)])


def met(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """The inner join of rows with table, which has one row a key and in `copies` how many of the `total` rows have it.

    What belongs to hot keys is broadcast, as there are fewer than HOT_KEYS of them; only the other rows are dealt by key.
    """
    hot = F.col("copies") * HOT_KEYS > total
    values = [c for c in table.columns if c not in (key, "copies")]
    tagged = rows.join(F.broadcast(table.where(hot).select(key, *values, F.lit(True).alias("hot"))), key, "left")
    rest = tagged.where("hot is null").select(*rows.columns).join(table.where(~hot).select(key, *values), key)
    return tagged.where("hot").drop("hot").unionByName(rest)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 bits; one to one."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64, kept for the next chunk."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1), base, dtype=np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
        if n > 4 * CHUNK_BYTES:  # of one very long text: not kept
            del _powers[base]
    return have[:n]


def chunks(texts: pa.Array, size: int = CHUNK_BYTES):
    """Slices (first row, texts) of about `size` bytes; a longer text stands alone."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lengths = np.asarray(pa.compute.binary_length(texts).fill_null(0), dtype=np.int64)
    ends = np.cumsum(lengths)
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
        yield start, texts.slice(start, stop - start)
        start = stop


class Words:
    """The words of a chunk of texts: byte ranges of `data`, and for text k the words first[k]:first[k+1]."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.fill_null("").cast(pa.large_string())
        _, offsets, data = texts.buffers()
        edges = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.data = raw[edges[0] : edges[-1]]
        if lower:
            self.data = _LOWER[self.data]
        self.edges = edges - edges[0]
        ink = ~_WHITE[self.data]
        self.ink = ink
        n = len(self.data)
        opens, closes = ink.copy(), ink.copy()
        opens[1:] &= ~ink[:-1]
        closes[:-1] &= ~ink[1:]
        firsts = self.edges[:-1][self.edges[:-1] < n]
        opens[firsts] = ink[firsts]
        lasts = self.edges[1:][self.edges[1:] > 0] - 1
        closes[lasts] = ink[lasts]
        self.starts = np.flatnonzero(opens)
        self.ends = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, self.edges)
        self.counts = np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        value = (self.data.astype(np.uint64) + np.uint64(1)) * powers(_P, len(self.data))
        value[~self.ink] = 0
        h = np.add.reduceat(value, self.starts)
        h *= powers(_P_INVERSE, len(self.data))[self.starts]
        return mix(h + (self.ends - self.starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def windows(hashes: np.ndarray, width: int, base: int = 0xA0761D6478BD642F) -> np.ndarray:
    """Rolling polynomial hash of every `width` consecutive hashes (their texts' borders are the caller's)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(base, len(hashes)), out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * powers(pow(base, -1, 1 << 64), n))


def whole(first: np.ndarray, counts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of the n = words - width + 1 windows lie within one text."""
    inside = np.zeros(max(n, 0) + 1, np.int32)
    some = counts >= width
    np.add.at(inside, first[:-1][some], 1)
    np.add.at(inside, first[:-1][some] + counts[some] - width + 1, -1)
    return np.cumsum(inside[:-1]).astype(bool)
