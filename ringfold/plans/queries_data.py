"""Registered queries: data movement, reductions, scans, operations. Buffers are views of orders over P ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringfold.functions.reduce_ops import Op, op
from ringfold.operators import Communicator
from ringfold.sources import views

P = 5
B = f"b AS (SELECT CAST(o_orderkey % {P} AS INTEGER) AS rnk, o_orderkey // {P} AS pos, o_custkey AS value FROM orders)"
R = f"r AS (SELECT CAST(unnest(range({P})) AS INTEGER) AS rnk)"
N = f"n AS (SELECT count(*) // {P} AS n, count(*) // {P * P} AS c FROM orders)"
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def registered(name: str, sql: str | None = None):
    """Registers fn(comm, buffer, spark, sf_dir); the column rank is called rnk in results."""

    def add(fn):
        def run(spark, sf_dir):
            out = fn(Communicator(spark, P), views.orders(spark, sf_dir, P), spark, sf_dir)
            return out.withColumnRenamed("rank", "rnk")

        QUERIES[name] = run
        if sql:
            ORACLE[name] = f"WITH {B}, {R}, {N} {sql}" if not sql.lstrip().startswith("WITH") else sql
        return fn

    return add


def ragged(buf):
    """Rank r keeps its first r elements of every four: rank 0 is empty."""
    return buf.where((F.col("pos") % 4) < F.col("rank")).withColumn("pos", F.expr("pos div 4") * F.col("rank") + F.col("pos") % 4)


RAGGED = "g AS (SELECT rnk, pos // 4 * rnk + pos % 4 AS pos, value FROM b WHERE pos % 4 < rnk)"
COUNTS = f"cnt AS (SELECT r.rnk, count(g.rnk) AS cnt FROM r LEFT JOIN g ON g.rnk = r.rnk GROUP BY r.rnk)"
DISPLS = "dsp AS (SELECT rnk, cnt, CAST(coalesce(sum(cnt) OVER (ORDER BY rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS displ FROM cnt)"
OTHER = "SELECT r.rnk, x.pos, x.value FROM x, r"


@registered("c01_bcast", "SELECT r.rnk, b.pos, b.value FROM b, r WHERE b.rnk = 2")
def bcast(comm, buf, *_):
    return comm.bcast(send_recv_buf=buf, root=2)


@registered("c02_bcast_single", "SELECT r.rnk, b.pos, b.value FROM b, r WHERE b.rnk = 3 AND b.pos = 0")
def bcast_single(comm, buf, *_):
    return comm.bcast_single(send_recv_buf=buf, root=3)


@registered("c03_gather", "SELECT CAST(1 AS INTEGER) AS rnk, rnk * n + pos AS pos, value FROM b, n")
def gather(comm, buf, *_):
    return comm.gather(send_buf=buf, root=1)


@registered("c04_gatherv", f", {RAGGED}, {COUNTS}, {DISPLS} SELECT CAST(0 AS INTEGER) AS rnk, displ + pos AS pos, value FROM g JOIN dsp USING (rnk)")
def gatherv(comm, buf, *_):
    return comm.gatherv(send_buf=ragged(buf))


@registered("c04_gatherv_counts", f", {RAGGED}, {COUNTS}, {DISPLS} SELECT rnk, cnt AS count, displ FROM dsp")
def gatherv_counts(comm, buf, *_):
    found = comm.gatherv(send_buf=ragged(buf), out=["recv_counts", "recv_displs"])
    return found.recv_counts.join(found.recv_displs, "rank")


@registered("c05_allgather", "SELECT r.rnk, b.rnk * n + pos AS pos, value FROM b, n, r")
def allgather(comm, buf, *_):
    return comm.allgather(send_buf=buf)


@registered("c06_allgather_inplace", "SELECT r.rnk, pos, value FROM b, n, r WHERE pos // c = b.rnk")
def allgather_inplace(comm, buf, *_):
    return comm.allgather_inplace(send_recv_buf=buf)


@registered("c07_allgatherv", f", {RAGGED}, {COUNTS}, {DISPLS}, x AS (SELECT displ + pos AS pos, value FROM g JOIN dsp USING (rnk)) {OTHER}")
def allgatherv(comm, buf, *_):
    return comm.allgatherv(send_buf=ragged(buf))


@registered("c08_scatter", "SELECT CAST(pos // c AS INTEGER) AS rnk, pos % c AS pos, value FROM b, n WHERE rnk = 0")
def scatter(comm, buf, *_):
    return comm.scatter(send_buf=buf)


@registered("c09_scatter_single", f"SELECT CAST(pos AS INTEGER) AS rnk, CAST(0 AS BIGINT) AS pos, value FROM b WHERE rnk = 4 AND pos < {P}")
def scatter_single(comm, buf, *_):
    return comm.scatter_single(send_buf=buf, root=4)


@registered("c10_scatterv", ", s(rnk, cnt, displ) AS (VALUES (0, 3, 0), (1, 0, 3), (2, 10, 2), (3, 7, 20), (4, 50, 25)) SELECT CAST(s.rnk AS INTEGER) AS rnk, b.pos - displ AS pos, value FROM b JOIN s ON b.pos >= displ AND b.pos < displ + cnt WHERE b.rnk = 0")
def scatterv(comm, buf, *_):
    return comm.scatterv(send_buf=buf, send_counts=[3, 0, 10, 7, 50], send_displs=[0, 3, 2, 20, 25])


@registered("c11_alltoall", "SELECT CAST(pos // c AS INTEGER) AS rnk, rnk * c + pos % c AS pos, value FROM b, n")
def alltoall(comm, buf, *_):
    return comm.alltoall(send_buf=buf)


@registered("c12_alltoall_inplace", "SELECT CAST(pos // 7 AS INTEGER) AS rnk, rnk * 7 + pos % 7 AS pos, value FROM b WHERE pos < 35")
def alltoall_inplace(comm, buf, *_):
    return comm.alltoall_inplace(send_recv_buf=buf, send_recv_count=7)


def pair_counts(comm, buf):
    """count(rank, peer) = (rank + peer) * (elements of a rank div 30)."""
    k = buf.agg(F.expr(f"count(*) div {30 * P}").alias("k"))
    ends = F.sequence(F.lit(0), F.lit(P - 1))
    return k.withColumn("rank", F.explode(ends)).withColumn("peer", F.explode(ends)).select("rank", "peer", ((F.col("rank") + F.col("peer")) * F.col("k")).alias("count"))


SEGMENTS = f""", q AS (SELECT a.rnk AS src, z.rnk AS dst, (a.rnk + z.rnk) * (n // 30) AS cnt FROM r a, r z, n),
seg AS (SELECT src, dst, cnt, coalesce(sum(cnt) OVER (PARTITION BY src ORDER BY dst ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sd,
  coalesce(sum(cnt) OVER (PARTITION BY dst ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rd FROM q)"""


@registered("c13_alltoallv", SEGMENTS + " SELECT dst AS rnk, CAST(rd + pos - sd AS BIGINT) AS pos, value FROM b JOIN seg ON b.rnk = src AND pos >= sd AND pos < sd + cnt")
def alltoallv(comm, buf, *_):
    return comm.alltoallv(send_buf=buf, send_counts=pair_counts(comm, buf))


@registered("c13_alltoallv_counts", SEGMENTS + " SELECT dst AS rnk, src AS peer, CAST(cnt AS BIGINT) AS count, CAST(rd AS BIGINT) AS displ FROM seg")
def alltoallv_counts(comm, buf, *_):
    found = comm.alltoallv(send_buf=buf, send_counts=pair_counts(comm, buf), out=["recv_counts", "recv_displs"])
    return found.recv_counts.join(found.recv_displs, ["rank", "peer"])


@registered("c15_barrier", "SELECT rnk, count(*) AS elements FROM b GROUP BY rnk")
def barrier(comm, buf, *_):
    (done,) = comm.barrier(buf)
    return done.groupBy("rank").agg(F.count("*").alias("elements"))


def _sql_reduce(agg: str, where: str = "") -> str:
    return f"SELECT CAST(0 AS INTEGER) AS rnk, pos, CAST({agg} AS BIGINT) AS value FROM b {where} GROUP BY pos"


for _name, _op, _agg in [
    ("a01_reduce_sum", "plus", "sum(value)"), ("o01_reduce_max", "max", "max(value)"), ("o02_reduce_min", "min", "min(value)"), ("o08_reduce_bit_and", "bit_and", "bit_and(value)"),
    ("o09_reduce_bit_or", "bit_or", "bit_or(value)"), ("o10_reduce_bit_xor", "bit_xor", "bit_xor(value)"),
]:
    registered(_name, _sql_reduce(_agg))(lambda comm, buf, *_, o=_op: comm.reduce(send_buf=buf, op=o))


@registered("o04_reduce_product", "SELECT CAST(0 AS INTEGER) AS rnk, pos, CAST(product(value % 7 + 1) AS BIGINT) AS value FROM b GROUP BY pos")
def product(comm, buf, *_):
    return comm.reduce(send_buf=buf.withColumn("value", F.col("value") % 7 + 1), op="multiplies")


for _name, _agg in [("logical_and", "bool_and(value % 5 <> 0)"), ("logical_or", "bool_or(value % 5 <> 0)"), ("logical_xor", "bit_xor(CAST(value % 5 <> 0 AS INTEGER)) = 1")]:
    registered(f"o05_reduce_{_name}", f"SELECT CAST(0 AS INTEGER) AS rnk, pos, {_agg} AS value FROM b GROUP BY pos")(
        lambda comm, buf, *_, o=_name: comm.reduce(send_buf=buf.withColumn("value", F.col("value") % 5 != 0), op=o)
    )

MINUS = op(lambda a, b: a - b, commutative=False)
CLAMPED = op(lambda a, b: F.least(a + b, F.lit(3000)), commutative=True)


@registered("o13_reduce_noncommutative", "SELECT CAST(0 AS INTEGER) AS rnk, pos, list_reduce(list(value ORDER BY rnk), lambda x, y: x - y) AS value FROM b GROUP BY pos")
def noncommutative(comm, buf, *_):
    return comm.reduce(send_buf=buf, op=MINUS)


@registered("o14_reduce_custom", "SELECT CAST(0 AS INTEGER) AS rnk, pos, CAST(least(list_reduce(list(value ORDER BY rnk), lambda x, y: least(x + y, 3000)), 9000000000) AS BIGINT) AS value FROM b GROUP BY pos")
def custom(comm, buf, *_):
    return comm.reduce(send_buf=buf, op=CLAMPED)


@registered("o15_reduce_function", "SELECT pos, list_reduce(list(value ORDER BY rnk), lambda x, y: (x * 31 + y) % 1000003) AS value FROM b GROUP BY pos")
def python_function(comm, buf, *_):
    from ringfold.functions.reduce_ops import python_reduce

    rows = buf.groupBy("pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias("xs"))
    return rows.select("pos", python_reduce(lambda x, y: (x * 31 + y) % 1000003, "long")("xs").alias("value"))


@registered("o03_complex_sum", "SELECT pos, CAST(sum(value) AS BIGINT) AS re, CAST(sum(value % 11) AS BIGINT) AS im FROM b GROUP BY pos")
def complex_sum(comm, buf, *_):
    from ringfold.functions.reduce_ops import COMPLEX_PLUS

    z = buf.withColumn("value", F.struct(F.col("value").alias("re"), (F.col("value") % 11).alias("im")))
    return comm.reduce(send_buf=z, op=COMPLEX_PLUS).select("pos", "value.re", "value.im")


@registered("a02_reduce_single", "SELECT r.rnk, CASE WHEN r.rnk = 1 THEN CAST(t AS BIGINT) END AS value FROM r, (SELECT sum(value) AS t FROM b WHERE pos = 0)")
def reduce_single(comm, buf, *_):
    return comm.reduce_single(send_buf=buf, op="sum", root=1)


@registered("a03_allreduce", ", x AS (SELECT pos, CAST(sum(value) AS BIGINT) AS value FROM b GROUP BY pos) " + OTHER)
def allreduce(comm, buf, *_):
    return comm.allreduce(send_buf=buf, op="sum")


@registered("a04_allreduce_inplace", ", x AS (SELECT pos, max(value) AS value FROM b WHERE pos < 100 GROUP BY pos) " + OTHER + " UNION ALL SELECT rnk, pos, value FROM b WHERE pos >= 100")
def allreduce_inplace(comm, buf, *_):
    return comm.allreduce_inplace(send_recv_buf=buf, op="max", send_recv_count=100)


@registered("a05_allreduce_single", "SELECT r.rnk, CAST(0 AS BIGINT) AS pos, t AS value FROM r, (SELECT min(value) AS t FROM b WHERE pos = 0)")
def allreduce_single(comm, buf, *_):
    return comm.allreduce_single(send_buf=buf, op="min")


@registered("a06_iallreduce", ", x AS (SELECT pos, min(value) AS value FROM b GROUP BY pos) " + OTHER)
def iallreduce(comm, buf, *_):
    from ringfold.streaming.requests import NonBlocking

    return NonBlocking(comm).iallreduce(send_buf=buf, op="min").wait()


def _running(agg: str, last: str) -> str:
    return f"{agg} OVER (PARTITION BY pos ORDER BY rnk ROWS BETWEEN UNBOUNDED PRECEDING AND {last})"


@registered("a07_scan", f"SELECT rnk, pos, CAST({_running('sum(value)', 'CURRENT ROW')} AS BIGINT) AS value FROM b")
def scan(comm, buf, *_):
    return comm.scan(send_buf=buf, op="sum")


@registered("a08_scan_inplace", f"SELECT rnk, pos, {_running('max(value)', 'CURRENT ROW')} AS value FROM b WHERE pos < 50")
def scan_inplace(comm, buf, *_):
    return comm.scan_inplace(send_recv_buf=buf, op="max", send_recv_count=50)


@registered("a09_scan_single", f"SELECT rnk, pos, {_running('bit_xor(value)', 'CURRENT ROW')} AS value FROM b WHERE pos = 0")
def scan_single(comm, buf, *_):
    return comm.scan_single(send_buf=buf, op="bit_xor")


@registered("o13_scan_noncommutative", "SELECT a.rnk, a.pos, list_reduce(list(z.value ORDER BY z.rnk), lambda x, y: x - y) AS value FROM b a JOIN b z ON a.pos = z.pos AND z.rnk <= a.rnk GROUP BY ALL")
def scan_noncommutative(comm, buf, *_):
    return comm.scan(send_buf=buf, op=MINUS)


@registered("a10_exscan", f"SELECT rnk, pos, CASE WHEN rnk = 0 THEN CAST(0 AS BIGINT) ELSE CAST({_running('sum(value)', '1 PRECEDING')} AS BIGINT) END AS value FROM b")
def exscan(comm, buf, *_):
    return comm.exscan(send_buf=buf, op="sum")


@registered("a10_exscan_values_on_rank_0", f"SELECT rnk, pos, CASE WHEN rnk = 0 THEN CAST(-17 AS BIGINT) ELSE {_running('max(value)', '1 PRECEDING')} END AS value FROM b")
def exscan_values(comm, buf, *_):
    return comm.exscan(send_buf=buf, op="max", values_on_rank_0=-17)


@registered("a11_exscan_inplace", f"SELECT rnk, pos, CASE WHEN rnk = 0 THEN CAST(9223372036854775807 AS BIGINT) ELSE {_running('min(value)', '1 PRECEDING')} END AS value FROM b")
def exscan_inplace(comm, buf, *_):
    return comm.exscan_inplace(send_recv_buf=buf, op="min")


@registered("a12_exscan_single", f"SELECT rnk, pos, CASE WHEN rnk > 0 THEN list_reduce({_running('list(value)', '1 PRECEDING')}, lambda x, y: x - y) END AS value FROM b WHERE pos = 0")
def exscan_single(comm, buf, *_):
    return comm.exscan_single(send_buf=buf, op=MINUS)


@registered("a13_is_same_on_all_ranks", "SELECT count(DISTINCT c) = 1 AS same FROM (SELECT count(*) AS c FROM b GROUP BY rnk)")
def is_same(comm, buf, *_):
    return comm.is_same_on_all_ranks(comm.counts(buf).withColumnRenamed("count", "value"))


@registered("a14_num_numa_nodes", "SELECT count(DISTINCT s_nationkey) AS nodes FROM supplier")
def numa(comm, buf, spark, sf_dir):
    return comm.num_numa_nodes(views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("rank"), F.col("s_nationkey").alias("host")))


def _tree_sql(levels: int, combine: str = "max(v) FILTER (i % 2 = 0) + max(v) FILTER (i % 2 = 1)") -> str:
    steps = ["l0 AS (SELECT o_orderkey AS i, o_totalprice AS v FROM orders)"]
    steps += [f"l{k + 1} AS (SELECT i // 2 AS i, CASE WHEN count(*) = 2 THEN {combine} ELSE max(v) END AS v FROM l{k} GROUP BY i // 2)" for k in range(levels)]
    return "WITH " + ", ".join(steps) + f" SELECT v AS value FROM l{levels}"


def _reproducible(comm, spark, sf_dir, what):
    buf = views.orders(spark, sf_dir, P, "o_totalprice")
    indexed = buf.select((F.col("pos") * P + F.col("rank")).alias("idx"), "value")
    return comm.reproducible_reduce(indexed=indexed, op=what)


@registered("a15_reproducible_sum", _tree_sql(21))
def reproducible_sum(comm, buf, spark, sf_dir):
    return _reproducible(comm, spark, sf_dir, "plus")


@registered("l10_reproducible_minus", _tree_sql(21, "max(v) FILTER (i % 2 = 0) - max(v) FILTER (i % 2 = 1)"))
def reproducible_minus(comm, buf, spark, sf_dir):
    return _reproducible(comm, spark, sf_dir, Op("minus", None, lambda a, b: a - b, commutative=False))


@registered("l09_reproducible_distribution", f", {RAGGED}, {COUNTS}, {DISPLS} SELECT bool_and(cnt = 0 OR nxt = displ + cnt) AND min(displ) = 0 AS valid FROM (SELECT cnt, displ, coalesce(lead(displ) OVER (ORDER BY displ, rnk), displ + cnt) AS nxt FROM dsp WHERE cnt > 0)")
def distribution(comm, buf, *_):
    found = comm.gatherv(send_buf=ragged(buf), out=["recv_counts", "recv_displs"])
    return comm.check_distribution(found.recv_counts.join(found.recv_displs, "rank").select("rank", F.col("count").alias("send_count"), "displ"))
