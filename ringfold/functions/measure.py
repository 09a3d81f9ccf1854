"""Timers and counters: a log (rank, path, seq, value) on each rank, aggregated over the ranks."""

from __future__ import annotations

import json
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPS = ("min", "max", "sum", "gather")
SCHEMA = "rank int, path string, seq int, value double"


def accumulated(events: DataFrame) -> DataFrame:
    """(rank, path, seq, value) of events (rank, path, at, value, append boolean), in the order of `at`.

    An appended value opens a new datapoint, an added one goes to the last; the first value of a path always opens one.
    """
    w = Window.partitionBy("rank", "path").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(Window.partitionBy("rank", "path").orderBy("at")) == 1
    opened = events.withColumn("first", first).withColumn("seq", F.sum((F.col("append") | F.col("first")).cast("int")).over(w) - 1)
    return opened.groupBy("rank", "path", F.col("seq").cast("int").alias("seq")).agg(F.sum("value").alias("value"))


def aggregated(log: DataFrame, ops: Sequence[str] = ("max",)) -> DataFrame:
    """(path, seq, one column an operation) over the ranks; gather is an array by rank."""
    if not ops or any(o not in OPS for o in ops):
        raise TypeError(f"operations are {OPS}")
    gather = F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"])
    make = {"min": F.min("value"), "max": F.max("value"), "sum": F.sum("value"), "gather": gather}
    return log.groupBy("path", "seq").agg(*(make[o].alias(o) for o in ops))


def diverging(log: DataFrame, size: int) -> DataFrame:
    """(path, ranks, least, most): paths that some rank lacks, or with unequal numbers of datapoints."""
    n = log.groupBy("path", "rank").agg(F.count("*").alias("n")).groupBy("path")
    return n.agg(F.count("*").alias("ranks"), F.min("n").alias("least"), F.max("n").alias("most")).where((F.col("ranks") != size) | (F.col("least") != F.col("most")))


def flat_lines(table: DataFrame, op: str) -> DataFrame:
    """(line): path:op=[v1, v2] with six decimals."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col(op).alias("v")))), lambda x: F.format_string("%.6f", x["v"].cast("double")))
    return table.groupBy("path").agg(F.concat(F.col("path"), F.lit(f":{op}=["), F.concat_ws(", ", values), F.lit("]")).alias("line")).select("line")


class Timer:
    """Times nested sections of the driver's program for a rank; `now` gives the time."""

    default_op = "max"

    def __init__(self, rank: int = 0, now=time.monotonic):
        self.rank, self.now, self.enabled = rank, now, True
        self.clear()

    def clear(self) -> None:
        self.open: list[tuple[str, float]] = []
        self.values: dict[str, list[float]] = {}
        self.ops: dict[str, tuple[str, ...]] = {}

    def start(self, key: str) -> None:
        if self.enabled:
            self.open.append((key, self.now()))

    synchronize_and_start = start

    def _stop(self, append: bool, ops: Sequence[str] | None) -> None:
        if not self.enabled:
            return
        if not self.open:
            raise RuntimeError("no section is open")
        path = ".".join(["root", *(k for k, _ in self.open)])
        _, began = self.open.pop()
        own, took = self.values.setdefault(path, []), self.now() - began
        if append or not own:
            own.append(took)
        else:
            own[-1] += took
        if ops:
            self.ops[path] = tuple(ops)

    def stop(self) -> None:
        self._stop(False, None)

    def stop_and_add(self, ops: Sequence[str] | None = None) -> None:
        self._stop(False, ops)

    def stop_and_append(self, ops: Sequence[str] | None = None) -> None:
        self._stop(True, ops)

    def enable(self) -> None:
        self.enabled = True

    def disable(self) -> None:
        self.enabled = False

    def rows(self) -> list[tuple[int, str, int, float]]:
        return [(self.rank, path, k, float(v)) for path, own in self.values.items() for k, v in enumerate(own)]

    def aggregate(self, spark: SparkSession, others: Sequence[Timer] = ()) -> DataFrame:
        """Over this and other ranks' measurements, by each path's operations."""
        rows = [x for t in (self, *others) for x in t.rows()]
        table = aggregated(spark.createDataFrame(rows, SCHEMA), OPS)
        names = {p: o for t in (self, *others) for p, o in t.ops.items()}
        chosen = spark.createDataFrame([(p, list(names.get(p, (self.default_op,)))) for p in {x[1] for x in rows}], "path string, ops array<string>")
        return table.join(chosen, "path")


class Counter(Timer):
    """Whole numbers, one level deep, summed over the ranks by default."""

    default_op = "sum"

    def add(self, key: str, value: int) -> None:
        own = self.values.setdefault(f"root.{key}", [])
        if own:
            own[-1] += value
        else:
            own.append(value)

    def append(self, key: str, value: int) -> None:
        self.values.setdefault(f"root.{key}", []).append(value)


def to_json_text(table: DataFrame, config: dict | None = None) -> str:
    """The aggregated table as JSON: data by path (at most a row a path and datapoint), and the configuration."""
    data: dict[str, dict[str, list]] = {}
    for r in table.orderBy("path", "seq").toLocalIterator():
        for o in OPS:
            if o in table.columns and ("ops" not in table.columns or o in r["ops"]):
                data.setdefault(r["path"], {}).setdefault(o, []).append(r[o])
    return json.dumps({"data": data, "config": config or {}}, indent=1)


_timer, _counter = Timer(), Counter()


def timer() -> Timer:
    return _timer


def counter() -> Counter:
    return _counter
