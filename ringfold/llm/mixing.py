"""Temperature mixing of sources, realised as budgeted block permutations.

A source's share of all tokens is raised to an exponent and normalised. The exponent is the largest (nearest to the shares
themselves, at most 1) at which the weights reach a target entropy; if then some source would be repeated more than
`max_epochs` times, it is raised again until none is. Both are found by bisection over the sources' token counts alone.

A source's budget is its weight times the total budget, given out in epochs: each is a permutation of the source's documents,
dealt into blocks by a hash of (seed, epoch, id), with all documents in whole epochs and, in the last one, those whose tokens
fit the rest of the budget. Where the last epoch is cut is found from sums over blocks; only the block that holds the
cut is looked at by document.

The mix itself is dealt into blocks of about BLOCK_DOCS rows. A source's epochs, one permutation after the other, are spread
evenly over all blocks, so each block has the sources by their weights; within a block the rows are permuted again.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

SEED, BLOCK_DOCS = 42, 4096
#: Tokens of the mix that one task writes.
TOKENS_A_PART = 8_000_000
ENTROPY, MAX_EPOCHS = 0.98, 2.0


def weights(tokens: Mapping[object, int], exponent: float) -> dict:
    """Normalised token shares to the power of exponent; a source without tokens weighs nothing."""
    total = sum(tokens.values())
    raised = {k: (n / total) ** exponent if n else 0.0 for k, n in tokens.items()}
    scale = sum(raised.values())
    return {k: x / scale if scale else 0.0 for k, x in raised.items()}


def entropy(w: Mapping[object, float]) -> float:
    return -sum(x * math.log(x) for x in w.values() if x > 0)


def epochs(tokens: Mapping[object, int], w: Mapping[object, float], budget: float | None) -> dict:
    """How often each source is gone through. Without a budget it is such that the least is exactly once."""
    rate = {k: w[k] / n for k, n in tokens.items() if n}
    scale = budget if budget is not None else 1 / min(rate.values(), default=1.0)
    exact = lambda x: float(round(x)) if abs(x - round(x)) < 1e-9 else x
    return {k: exact(rate[k] * scale) if k in rate else 1.0 for k in tokens}


def exponent(tokens: Mapping[object, int], target_entropy: float | None = ENTROPY, max_epochs: float | None = MAX_EPOCHS, budget: float | None = None, steps: int = 60) -> float:
    """The exponent in 0..1. target_entropy is a share of the entropy of equal weights.

    The repetition limit wins over the entropy. A limit that no exponent meets (with a budget above what it allows) gives 1.
    """
    some = {k: n for k, n in tokens.items() if n}
    if len(some) < 2:
        return 1.0

    def largest(good) -> float:
        """The largest exponent that is good, given that small ones are."""
        low, high = 0.0, 1.0
        if good(high):
            return high
        for _ in range(steps):
            mid = (low + high) / 2
            low, high = (mid, high) if good(mid) else (low, mid)
        return low

    at = 1.0 if target_entropy is None else largest(lambda t: entropy(weights(some, t)) >= target_entropy * math.log(len(some)) - 1e-12)
    within = lambda t: max(epochs(some, weights(some, t), budget).values()) <= max_epochs * (1 + 1e-12)
    if max_epochs is None or within(at):
        return at
    return 1.0 if not within(1.0) else at + (1 - at) * (1 - largest(lambda x: within(at + (1 - at) * (1 - x))))


def _turn(epoch: Column, seed: int) -> Column:
    """A document's place in an epoch, as 0..2**62-1."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch, F.col("id")), 2)


def _copies(seed: int) -> Column:
    """How often the mix has a row that has met its source's plan."""
    fits = F.when(F.col("rest") <= 0, 0).when(F.col("last").isNull() | (_turn(F.col("whole"), seed) <= F.col("last")), 1).otherwise(0)
    return F.col("whole") + fits


def _meet(rows: DataFrame, plan: list[tuple]) -> DataFrame:
    """Rows with id and source, and their source's plan: a row a source, so the rows are not shuffled."""
    table = rows.sparkSession.createDataFrame([p[:7] for p in plan], "of string, weight double, epochs double, whole long, rest long, blocks long, last long")
    table = F.broadcast(table) if len(plan) <= 100_000 else table
    return rows.join(table, F.col("source").eqNullSafe(F.col("of"))).drop("of")


def _planned(rows: DataFrame, budget: int | None, target_entropy: float | None, max_epochs: float | None, seed: int) -> list[tuple]:
    """For each source of (id, source, n_tokens): weight, epochs, whole epochs, tokens left for the last, blocks, the last
    place of its permutation that fits (null: all do), rows and tokens."""
    sums = rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")).collect()  # a row a source
    tokens = {r["source"]: r["tokens"] for r in sums}
    w = weights(tokens, exponent(tokens, target_entropy, max_epochs, budget))
    goes = epochs(tokens, w, budget)
    plan = [(r["source"], w[r["source"]], goes[r["source"]], int(goes[r["source"]]), int(round(goes[r["source"]] % 1 * tokens[r["source"]])), max(1, r["rows"] // BLOCK_DOCS), None, r["rows"], tokens[r["source"]]) for r in sums]
    placed = _meet(rows, plan).where("rest > 0").withColumn("turn", _turn(F.col("whole"), seed)).withColumn("block", (F.col("turn") / F.lit(2.0**62) * F.col("blocks")).cast("long"))
    up = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    by_block = placed.groupBy("source", "block", "rest").agg(F.sum("n_tokens").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(up), F.lit(0)))
    cut = by_block.where("before <= rest and before + n > rest").select(F.col("source").alias("of"), F.col("block").alias("cut"), "before")
    # The one block of each source in which the budget ends, by document.
    inside = placed.select("source", "block", "turn", "n_tokens", "rest").join(cut, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("cut")))
    upto = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("turn"))
    last = inside.withColumn("upto", F.col("before") + upto).groupBy("source").agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("turn"))).alias("last"), F.min("turn").alias("first"))
    ends = {r["source"]: r["last"] if r["last"] is not None else r["first"] - 1 for r in last.collect()}  # a row a source
    return [(*p[:6], ends.get(p[0]), *p[7:]) for p in plan]


def _rows(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """(id, source, n_tokens), written once, as it is read for sums, for blocks and for the result."""
    n = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return written(docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), n.alias("n_tokens")), "tokens")


def mix(
    docs: DataFrame, budget: int | None = None, target_entropy: float | None = ENTROPY, max_epochs: float | None = MAX_EPOCHS,
    seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """Every row of docs as (id, source, n_tokens, weight, epochs, copies); copies says how often the mix has the row.

    Tokens are words. Without a budget the least repeated source is taken exactly once and no row gets 0 copies. A null
    source is a source of its own. A null text has no tokens; a source without any weighs 0 and is taken once. Rows that
    repeat an id (and source) have the same place in every permutation, so either all or none of them fit the rest.
    """
    rows = _rows(docs, id_col, source_col, text_col)
    met = _meet(rows, _planned(rows, budget, target_entropy, max_epochs, seed))
    return met.select("id", "source", "n_tokens", "weight", "epochs", _copies(seed).alias("copies"))


def _scheduled(met: DataFrame, plan: list[tuple], seed: int) -> tuple[DataFrame, int]:
    """A row for each copy of rows that have met their plan, with epoch (from 0), block and turn (the order in the block), and the number of blocks."""
    count = sum(p[3] * p[7] + p[4] / max(p[8], 1) * p[7] for p in plan)
    blocks = max(1, round(count / BLOCK_DOCS))
    copies = met.withColumn("copies", _copies(seed).cast("int")).where("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    turn, one = _turn(F.col("epoch").cast("long"), seed), 2.0**62
    # How far through its source's epochs a copy is; the last epoch is as long as its share of the budget.
    part = F.when(F.col("epoch") < F.col("whole"), F.col("epoch") + turn / one).otherwise(F.col("whole") + turn / (F.coalesce("last", F.lit(1 << 62)) + 1) * (F.col("epochs") - F.col("whole")))
    block = F.least(F.floor(part / F.col("epochs") * blocks), F.lit(blocks - 1)).cast("int")
    return copies.withColumns({"block": block, "turn": F.xxhash64(F.lit(seed), F.lit("block"), "epoch", "id", "source")}), blocks


def schedule(
    docs: DataFrame, budget: int | None = None, target_entropy: float | None = ENTROPY, max_epochs: float | None = MAX_EPOCHS,
    seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """The mix in its order: (id, source, n_tokens, weight, epochs, epoch, block, place), a row for each copy that mix counts.

    Blocks and places in them count from 0. Edge cases are those of mix; rows that repeat an id and source lie next to each
    other.
    """
    rows = _rows(docs, id_col, source_col, text_col)
    plan = _planned(rows, budget, target_entropy, max_epochs, seed)
    found, _ = _scheduled(_meet(rows, plan), plan, seed)
    place = F.row_number().over(Window.partitionBy("block").orderBy("turn", "id", "source", "epoch", "n_tokens")) - 1
    return found.select("id", "source", "n_tokens", "weight", "epochs", "epoch", "block", place.alias("place"))


def realise(
    docs: DataFrame, budget: int | None = None, target_entropy: float | None = ENTROPY, max_epochs: float | None = MAX_EPOCHS,
    seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """The rows of docs, each as often as schedule has it, with the columns of docs.

    Partitions are ranges of blocks, and rows lie in the schedule's order, so that what is written is the mix block by block.
    """
    slim = _rows(docs, id_col, source_col, text_col)
    plan = _planned(slim, budget, target_entropy, max_epochs, seed)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"))
    found, blocks = _scheduled(_meet(rows, plan), plan, seed)
    tokens = sum(p[3] * p[8] + p[4] for p in plan)
    parts = min(blocks, max(docs.sparkSession.sparkContext.defaultParallelism, tokens // TOKENS_A_PART))
    out = found.repartitionById(parts, (F.col("block").cast("long") * parts / blocks).cast("int")).sortWithinPartitions("block", "turn", "id", "source", "epoch")
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    found = schedule(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "source", "n_tokens", "weight", "epochs", "epoch", "block", "place")
