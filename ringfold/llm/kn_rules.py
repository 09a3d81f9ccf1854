"""Quality rules: word, symbol and repetition counts, and bands of n-gram perplexity for each language.

Perplexities are those of a modified Kneser-Ney model of words (`word_kn.py`). What it has never seen is spelled by the model
here: a modified Kneser-Ney model of four symbols. Symbols are 62 classes of bytes (letters, digits, capitals, some
punctuation, parts of UTF-8), so that an n-gram is a number under 2**24: the model's size is bounded however large the corpus.
Spark counts the four-grams of all documents. The model is kept as arrays sorted by n-gram, one pair for each order: the
interpolated log-probability of each n-gram seen, and the weight that each context passes to the shorter one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import word_kn
from .common import Words, chunks, reused, whole, windows, written

ORDER, BITS, BEGIN, END = 4, 6, 0, 1
#: Mean log10 probabilities are counted in bins of this width for the bands.
BIN = 0.002
#: SHORT: on sf0.1 the mean of a text of n >= 50 words spreads about its language's median by 5 to 6 / sqrt(n) (good texts whose mean is under -2.2, by their quartiles; 8.9 for shorter texts).
SPREADS, SHORT = 4.0, 5.0
_SYMBOL = np.full(256, 41, dtype=np.int64)
for _n, _chars in enumerate([" \t\r\x0b\x0c", "\n", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"], 2):
    _SYMBOL[np.frombuffer(_chars.encode(), np.uint8)] = _n
_SYMBOL[97:123] = np.arange(6, 32)
for _n, _chars in enumerate([".", ",", "!", "|", "#*$%&<>", "'\"`", "()[]{}", ":;?", "-_/\\"], 32):
    _SYMBOL[np.frombuffer(_chars.encode(), np.uint8)] = _n
_SYMBOL[0x80:0xC0] = 42 + (np.arange(0x80, 0xC0) & 15)
_SYMBOL[0xC0:0xE0], _SYMBOL[0xC2:0xC4], _SYMBOL[0xE0:0xF0], _SYMBOL[0xF0:] = 59, 58, 60, 61
_MARK = np.zeros(256, dtype=bool)
_MARK[np.frombuffer(b"#*$%&|<>", np.uint8)] = True


def four_grams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The four-grams of a chunk's texts, each text's last the one of its end, and where each text's begin."""
    n = len(w.counts)
    starts = w.edges[:-1] + 4 * np.arange(n)
    lasts = w.edges[1:] + 4 * np.arange(n) + 3
    own = np.ones(len(w.data) + 4 * n, dtype=bool)
    for k in range(3):
        own[starts + k] = False
    line = np.full(len(own), BEGIN, dtype=np.int32)
    own[lasts] = False
    line[own] = _SYMBOL.astype(np.int32)[w.data]
    own[lasts] = True
    line[lasts] = END
    keys = line.copy()
    for k in range(1, ORDER):
        keys[k:] |= line[:-k] << np.int32(BITS * k)
    return keys[own], w.edges[:-1] + np.arange(n)


def count_grams(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram int, n long) over all texts; null counts as empty."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << BITS * ORDER, np.int64)
        with reused():
            for b in batches:
                for _, part in chunks(b.column(0)):
                    np.add.at(n, four_grams(Words(part))[0], 1)
        grams = np.flatnonzero(n)
        n = n[grams]
        yield pa.record_batch([pa.array(grams.astype(np.int32)), pa.array(n)], ["gram", "n"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(each, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


@dataclass
class KneserNey:
    """For each order 1..4 the sorted n-grams with their probabilities, and the sorted contexts with their weights."""

    grams: list[np.ndarray]
    probabilities: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    size: int = 0  # of all texts, in bytes and ends

    @classmethod
    def of(cls, gram: np.ndarray, n: np.ndarray) -> KneserNey:
        order = np.argsort(gram)
        grams, counts = [gram[order].astype(np.int64)], [n[order].astype(np.int64)]
        for k in range(ORDER - 1, 0, -1):  # lower orders count the symbols that may precede
            g, c = np.unique(grams[0] & ((1 << BITS * k) - 1), return_counts=True)
            grams, counts = [g, *grams], [c, *counts]
        model = cls(grams, [], [], [], int(n.sum()))
        for k in range(ORDER):
            g, c = grams[k], counts[k]
            off = word_kn.discounts([int((c == i).sum()) for i in range(1, 5)])[np.minimum(c, 3)]
            context = g >> BITS
            h, at = np.unique(context, return_inverse=True)
            total = np.bincount(at, c)
            weight = np.bincount(at, off) / total
            lower = model.p(g & ((1 << BITS * k) - 1), k) if k else 1 / (1 << BITS)
            model.probabilities.append((c - off) / total[at] + weight[at] * lower)
            model.contexts.append(h)
            model.weights.append(weight)
        return model

    def p(self, gram: np.ndarray, order: int = ORDER) -> np.ndarray:
        """The probability of each n-gram's last symbol after the others."""
        have = self.grams[order - 1]
        at = np.minimum(np.searchsorted(have, gram), len(have) - 1)
        out = self.probabilities[order - 1][at]
        miss = np.flatnonzero(have[at] != gram)
        if len(miss):
            g = gram[miss]
            lower = self.p(g & ((1 << BITS * (order - 1)) - 1), order - 1) if order > 1 else np.full(len(g), 1.0 / (1 << BITS))
            h = self.contexts[order - 1]
            k = np.minimum(np.searchsorted(h, g >> BITS), len(h) - 1)
            out[miss] = np.where(h[k] == g >> BITS, self.weights[order - 1][k], 1.0) * lower
        return out


def train(docs: DataFrame, text_col: str = "text") -> KneserNey | None:
    """The model of all texts; its counts are under 2**24 rows. None if there are no rows."""
    with word_kn.shuffles_dropped(docs.sparkSession):
        found = count_grams(docs, text_col).toArrow()
    return KneserNey.of(found.column("gram").to_numpy(), found.column("n").to_numpy()) if len(found) else None


_SIZE = np.maximum(np.bincount(_SYMBOL, minlength=64), 1)


def spelled(w: Words, model: KneserNey | None) -> np.ndarray:
    """The log10 probability of each text's bytes and its end, where the bytes of a symbol are alike."""
    grams, firsts = four_grams(w)
    grams, at = np.unique(grams, return_inverse=True)
    p = model.p(grams.astype(np.int64)) if model else np.full(len(grams), 1.0 / (1 << BITS))
    return np.add.reduceat(np.log10(p / _SIZE[grams & 63])[at], firsts)


_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_grams", "log10_p")


def measures(w: Words, texts: pa.Array, hashes: np.ndarray) -> list[np.ndarray]:
    """The first five of _COLUMNS for a chunk of texts."""
    per_text = lambda flags: np.diff(np.searchsorted(np.flatnonzero(flags), w.edges))
    chars = np.diff(np.r_[0, np.cumsum(w.ends - w.starts)][w.first]) - per_text((w.data & 0xC0) == 0x80)
    h = windows(hashes, 8, base=0xE7037ED1A0B428DB)
    good = np.flatnonzero(whole(w.first, w.counts, 8, len(h)))
    key = h[good] ^ (w.rows()[good].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    number = word_kn.numbered(key)[1]
    twice = good[np.bincount(number)[number] > 1]
    cover = np.zeros(len(w.starts) + 1, np.int32)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + 8, -1)
    repeats = np.diff(np.r_[0, np.cumsum(np.cumsum(cover[:-1]) > 0)][w.first])
    lines = []
    for text in texts.cast(pa.binary()):
        own = [x for x in (text.as_py() or b"").split(b"\n") if x.strip()]
        lines.append(len(own) - len(set(own)))
    return [w.counts, chars, per_text(_MARK[w.data]), np.array(lines, np.int64), repeats]


def rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", spreads: float = SPREADS, short: float = SHORT) -> DataFrame:
    """One row for each row of docs: id, lang, _COLUMNS, perplexity, lower, upper, base_failed, kept.

    base_failed: fewer than 20 words, or over 30 % of the words within 8-word windows that the text repeats.
    n_grams: the words and the end. log10_p: their log10 probability, by the model of the texts of the other half.
    kept: not base_failed, and the perplexity lies in its language's band. The band's ends are where the mean log10
    probability of a word is `spreads` times as far from the language's median as its lower and upper quartile are, and
    `short` / sqrt(words) further for chance. A null lang is a language of its own; a null text is empty (and fails).
    """
    model = train(docs, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    found = word_kn.scored(rows, _COLUMNS[:5], measures, lambda w: spelled(w, model), model.size // 6 if model else 0)
    mean = F.col("log10_p") / F.col("n_grams")
    bins = found.groupBy("lang", F.floor(mean / BIN).alias("bin")).count()
    up = Window.partitionBy("lang").orderBy("bin")
    share = bins.withColumn("upto", F.sum("count").over(up)).withColumn("all", F.sum("count").over(Window.partitionBy("lang")))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bin"))) * BIN
    bands = share.groupBy("lang").agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3")).withColumnRenamed("lang", "of")
    joined = found.join(bands, F.col("lang").eqNullSafe(F.col("of")), "left")
    chance = short / F.sqrt("n_grams")
    low = F.col("q2") - spreads * (F.col("q2") - F.col("q1") + BIN) - chance
    high = F.col("q2") + spreads * (F.col("q3") - F.col("q2") + BIN) + chance
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    perplexity = lambda x: F.pow(F.lit(10.0), -x)
    return joined.select(
        "id", "lang", *_COLUMNS, perplexity(mean).alias("perplexity"), perplexity(high).alias("lower"), perplexity(low).alias("upper"),
        failed.alias("base_failed"), (~failed & mean.between(low, high)).alias("kept"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    found = rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), *_COLUMNS[:5], "base_failed", "kept", "perplexity")
