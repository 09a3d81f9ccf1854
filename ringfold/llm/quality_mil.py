"""Quality classifier: gated attention over the passages of a document, learned from labels of whole documents.

A text is cut into passages of PASSAGE words. Each is encoded from its classes of bytes, their pairs, and a few word
statistics. Attention weights, made of a tanh part gated by a sigmoid part, say how much each passage speaks for its
document; the weighted sum of the passages is scored by a logistic unit. All of it is trained together on the driver, on a
sample of at most `sample` labelled documents of each class, each of at most MAX_SAMPLE_BYTES; scoring covers whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, chunks, fields, give_back
from .kn_rules import _SYMBOL

#: The sample's texts and features are at most 2 * SAMPLE * MAX_SAMPLE_BYTES = 200 MB and about 1.5 times that on the driver.
PASSAGE, SAMPLE, MAX_SAMPLE_BYTES = 96, 3000, 1 << 15
HIDDEN, GATE, EPOCHS, BATCH, RATE, DECAY = 24, 12, 30, 128, 0.004, 1e-4
#: Classes for pairs: begin/end, blank, line end, digit, capital, vowel, consonant, stop, mark, bracket or quote, other, beyond ASCII.
_COARSE = np.array([0, 0, 1, 2, 3, 4, *(5 if c in "aeiou" else 6 for c in "abcdefghijklmnopqrstuvwxyz"), 7, 7, 8, 8, 8, 9, 9, 7, 10, 10, *[11] * 20])
_PAIRS, _CLASSES = 12, 62
FEATURES = _CLASSES + _PAIRS * _PAIRS + 6


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row of FEATURES for each passage, and each text's number of passages, at least one."""
    w = Words(texts)
    counts = np.maximum(1, -(-w.counts // PASSAGE))
    first = np.r_[0, np.cumsum(counts)]
    n = int(first[-1])
    within = np.arange(n) - np.repeat(first[:-1], counts)
    opening = np.repeat(w.edges[:-1], counts)
    later = within > 0
    opening[later] = w.starts[(np.repeat(w.first[:-1], counts) + within * PASSAGE)[later]]
    size = np.diff(np.r_[opening, len(w.data)])
    of_byte = np.repeat(np.arange(n), size)
    symbol = _SYMBOL[w.data]
    one = np.bincount(of_byte * _CLASSES + symbol, minlength=n * _CLASSES).reshape(n, _CLASSES)
    coarse = _COARSE[symbol]
    before = np.r_[np.zeros(1, coarse.dtype), coarse][: len(coarse)]
    before[w.edges[:-1][w.edges[:-1] < len(coarse)]] = 0  # a text begins, whatever text lies before it
    two = np.bincount(of_byte * _PAIRS**2 + before * _PAIRS + coarse, minlength=n * _PAIRS**2).reshape(n, -1)
    row = w.rows()
    of_word = first[row] + (np.arange(len(row)) - w.first[row]) // PASSAGE
    words = np.bincount(of_word, minlength=n)
    h = w.hashes()
    again = np.r_[False, (h[1:] == h[:-1]) & (of_word[1:] == of_word[:-1])] if len(h) else np.zeros(0, bool)
    order = np.lexsort((h, of_word))
    new = np.r_[True, (h[order][1:] != h[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])] if len(h) else np.zeros(0, bool)
    share = lambda flags, of: np.bincount(of, flags, minlength=n) / np.maximum(words, 1)
    length = (w.ends - w.starts).astype(np.float64)
    mean = share(length, of_word)
    rest = [np.log1p(words), mean, np.sqrt(np.maximum(share(length**2, of_word) - mean**2, 0)), share(again, of_word), share(new, of_word[order]), np.log1p(np.repeat(w.counts, counts))]
    per_byte = 1 / np.maximum(size, 1)[:, None]
    return np.concatenate([np.sqrt(one * per_byte), np.sqrt(two * per_byte), np.stack(rest, axis=1)], axis=1).astype(np.float32), counts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Attention:
    """Parameters of the model; centre and scale standardise the features."""

    prior: float
    centre: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        p = self.weights
        first = np.r_[0, np.cumsum(counts)[:-1]]
        h = np.tanh(x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        a = (t * g) @ p["w"]
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, first), counts))
        a /= np.repeat(np.add.reduceat(a, first), counts)
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "y": _sigmoid(z @ p["c"] + p["b"]), "first": first}

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -6, 6)

    def score(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(counts), self.prior)
        # Matrix products round differently in other batches: the last digits are dropped.
        return np.round(self.forward(self.standard(x), counts)["y"], 9)

    @classmethod
    def fit(cls, x: np.ndarray, counts: np.ndarray, label: np.ndarray, weight: np.ndarray, prior: float, seed: int = 1) -> Attention:
        """Adam on weighted cross-entropy; the same input gives the same model."""
        rng = np.random.default_rng(seed)
        init = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        model = cls(prior, x.mean(axis=0, dtype=np.float64), x.std(axis=0, dtype=np.float64) + 1e-3)
        p = model.weights = {"E": init(x.shape[1], HIDDEN), "e": np.zeros(HIDDEN), "V": init(HIDDEN, GATE), "U": init(HIDDEN, GATE), "w": init(GATE), "c": init(HIDDEN), "b": np.full(1, np.log(prior / (1 - prior)))}
        x = model.standard(x)
        first = np.r_[0, np.cumsum(counts)]
        m, v, step = {k: 0.0 for k in p}, {k: 0.0 for k in p}, 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(counts))
            for k in range(0, len(order), BATCH):
                bags = order[k : k + BATCH]
                n = counts[bags]
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[bags], n)
                grad = model._gradient(x[at], n, label[bags], weight[bags])
                step += 1
                for name in p:
                    d = grad[name] + DECAY * p[name]
                    m[name] = 0.9 * m[name] + 0.1 * d
                    v[name] = 0.999 * v[name] + 0.001 * d * d
                    p[name] = p[name] - RATE * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
        return model

    def _gradient(self, x, counts, label, weight):
        p, f = self.weights, self.forward(x, counts)
        dy = (f["y"] - label) * weight / weight.sum()
        dz = np.repeat(dy[:, None] * p["c"], counts, axis=0)
        da = (dz * f["h"]).sum(axis=1)
        ds = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, f["first"]), counts))
        dt = ds[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2)
        dg = ds[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        return {"E": x.T @ dh, "e": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ ds, "c": f["z"].T @ dy, "b": dy.sum(keepdims=True)}


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")), F.lit(0)) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Attention:
    """A model of P(label 1), from rows that are not held out.

    The sample has the smallest hashes of their ids; classes are weighed as they stand among all labels. Of several labels
    of a document the largest counts; null labels and labels without a document don't. Where one class is missing, every
    score is the labels' share of 1 (one of each added).
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col)).cast("int").alias("label"))
    known = known.where(~held_out(F.col("id")))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect() if r["label"] in (0, 1)}
    prior = (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2)
    if len(sizes) < 2:
        return Attention(prior)
    # About 1.3 times the sample are picked by their hash where they lie, so that few rows are ranked.
    share = F.when(F.col("label") == 1, sample / sizes[1]).otherwise(sample / sizes[0])
    known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < 100 + 1.3 * (1 << 20) * share)
    turn = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("id"), "id"))
    chosen = known.where("label in (0, 1)").withColumn("turn", turn).where(F.col("turn") <= sample).select("id", "label")  # 2 * sample rows at most
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.octet_length("text") <= MAX_SAMPLE_BYTES)
    bags = texts.join(F.broadcast(chosen), "id").select("id", "label", "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, part in chunks(b.column(2)):
                x, counts = passages(part)
                cuts = np.cumsum(counts)[:-1]
                rows = [a.tobytes() for a in np.split(x, cuts)]
                yield pa.record_batch([b.column(0).slice(start, len(part)), b.column(1).slice(start, len(part)), pa.array(rows, pa.binary())], ["id", "label", "x"])

    found = bags.mapInArrow(each, "id long, label int, x binary").toArrow().sort_by([("id", "ascending"), ("x", "ascending")])
    label = found.column("label").to_numpy().astype(float)
    if len(set(label)) < 2:
        return Attention(prior)
    x = [np.frombuffer(a.as_py(), np.float32).reshape(-1, FEATURES) for a in found.column("x")]
    counts = np.array([len(a) for a in x])
    share = {k: sizes[k] / (label == k).sum() for k in (0, 1)}
    weight = np.where(label == 1, share[1], share[0])
    model = Attention.fit(np.concatenate(x), counts, label, weight / weight.mean(), prior)
    del found, x
    give_back()
    return model


def score(docs: DataFrame, model: Attention, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, score double, and the columns named in carry as the struct rest) for every row.

    A null text is an empty one; a row without an id is scored like others, and rows that repeat are scored one by one. Texts
    are scored whole, however long.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, part in chunks(b.column(1)):
                rest = b.column(2).slice(start, len(part))
                rest = pa.StructArray.from_arrays(rest.flatten(), [f.name for f in rest.type])
                yield pa.record_batch([b.column(0).slice(start, len(part)), pa.array(model.score(*passages(part)).astype(np.float64)), rest], ["id", "score", "rest"])

    extra = F.struct(*([F.col(f"`{c}`") for c in carry] or [F.lit(0).alias("none")])).alias("rest")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), extra)
    return rows.mapInArrow(each, fields(rows, "rest", before="id long, score double"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
