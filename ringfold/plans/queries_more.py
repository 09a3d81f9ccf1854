"""Registered queries: messages, groups, graphs, sorting, sparse exchange, containers, measurements, algorithms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringfold.functions import measure
from ringfold.operators import Group, RankRange
from ringfold.operators import nested
from ringfold.operators.groups import any_contains
from ringfold.operators.topology import Topology, edges
from ringfold.sources import views

from . import algorithms
from .queries_data import P, SEGMENTS, pair_counts, registered

LOG = f"m AS (SELECT CAST(user_id % {P} AS INTEGER) AS src, CAST(event_id % {P} AS INTEGER) AS dest, CAST(length(event_type) AS INTEGER) AS tag, event_id AS seq, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"


def message_log(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    cents = F.round(F.col("value") * 100).cast("long")
    return e.select((F.col("user_id") % P).cast("int").alias("src"), (F.col("event_id") % P).cast("int").alias("dest"), F.length("event_type").alias("tag"), F.col("event_id").alias("seq"), F.array(cents, F.col("event_id")).alias("payload"))


@registered("p01_send_modes", "SELECT CAST(rnk AS INTEGER) AS src, CAST((rnk + 1) % 5 AS INTEGER) AS dest, mode, count(*) AS elements, CAST(sum(value) AS BIGINT) AS total FROM b, (VALUES ('standard'), ('buffered'), ('synchronous'), ('ready')) t(mode) GROUP BY ALL")
def send(comm, buf, *_):
    to = comm.rank_shifted_cyclic(F.col("rank"), 1)
    log = comm.send(send_buf=buf, destination=to)
    for k, mode in enumerate(("bsend", "ssend", "rsend"), 1):
        log = getattr(comm, mode)(send_buf=buf, destination=to, log=log, seq=k)
    return log.select("src", "dest", "mode", F.size("payload").cast("long").alias("elements"), F.aggregate("payload", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@registered("p05_isend", "SELECT CAST(rnk AS INTEGER) AS src, CAST(0 AS INTEGER) AS dest, count(*) AS elements FROM b GROUP BY rnk")
def isend(comm, buf, *_):
    from ringfold.streaming.requests import NonBlocking

    log = NonBlocking(comm).isend(send_buf=buf, destination=0).wait()
    return log.select("src", "dest", F.size("payload").cast("long").alias("elements"))


FIRST = ", {log}, f AS (SELECT *, row_number() OVER (PARTITION BY dest ORDER BY seq, src, tag) AS n FROM m WHERE {where})"


@registered("p09_recv", FIRST.format(log=LOG, where="src = 2") + ", g AS (SELECT dest, src, tag, unnest([{'p': 0, 'v': cents}, {'p': 1, 'v': seq}]) AS u FROM f WHERE n = 1) SELECT dest AS rnk, CAST(u.p AS BIGINT) AS pos, u.v AS value, src AS source, tag, CAST(2 AS INTEGER) AS count FROM g")
def recv(comm, buf, spark, sf_dir):
    return comm.recv(log=message_log(spark, sf_dir), source=2)


@registered("p10_recv_single", FIRST.format(log=LOG, where="tag = 5") + " SELECT dest AS rnk, cents AS value FROM f WHERE n = 1")
def recv_single(comm, buf, spark, sf_dir):
    return comm.recv_single(log=message_log(spark, sf_dir), tag=5)


@registered("p11_try_recv", FIRST.format(log=LOG, where="src = 1 AND dest <> 3") + " SELECT r.rnk, cents, src AS source, tag FROM r LEFT JOIN (SELECT * FROM f WHERE n = 1) ON dest = r.rnk")
def try_recv(comm, buf, spark, sf_dir):
    found = comm.try_recv(log=message_log(spark, sf_dir).where("dest <> 3"), source=1)
    return found.select("rank", F.col("payload")[0].alias("cents"), "source", "tag")


@registered("p12_irecv", FIRST.format(log=LOG, where="true") + " SELECT dest AS rnk, seq AS value FROM f WHERE n = 1")
def irecv(comm, buf, spark, sf_dir):
    from ringfold.streaming.requests import NonBlocking

    return NonBlocking(comm).irecv(log=message_log(spark, sf_dir)).wait().where("pos = 1").select("rank", "value")


@registered("p13_sendrecv_shift", "SELECT CAST((rnk + 1) % 5 AS INTEGER) AS rnk, pos, value, rnk AS source FROM b")
def sendrecv(comm, buf, *_):
    return comm.sendrecv(send_buf=buf, destination=comm.rank_shifted_cyclic(F.col("rank"), 1))


@registered("p14_probe", FIRST.format(log=LOG, where="true") + " SELECT dest AS rnk, src AS source, tag, CAST(2 AS INTEGER) AS count FROM f WHERE n = 1")
def probe(comm, buf, spark, sf_dir):
    return comm.probe(log=message_log(spark, sf_dir))


@registered("p15_iprobe", f", {LOG} SELECT r.rnk, EXISTS (SELECT 1 FROM m WHERE dest = r.rnk AND src = 0 AND tag = 5) AS found FROM r")
def iprobe(comm, buf, spark, sf_dir):
    return comm.iprobe(log=message_log(spark, sf_dir), source=0, tag=5)


@registered("p09_fifo_match", f", {LOG}, s AS (SELECT *, row_number() OVER (PARTITION BY src, dest, tag ORDER BY seq) AS n FROM m), w AS (SELECT *, row_number() OVER (PARTITION BY src, dest, tag ORDER BY -seq) AS n FROM m WHERE seq % 3 = 0) SELECT s.src, s.dest, s.tag, s.seq, -w.seq AS recv_seq FROM s JOIN w USING (src, dest, tag, n)")
def fifo(comm, buf, spark, sf_dir):
    log = message_log(spark, sf_dir)
    wanted = log.where("seq % 3 = 0").select("src", "dest", "tag", (-F.col("seq")).alias("seq"))
    return comm.match(sends=log.drop("payload"), receives=wanted)


# Groups: world ranks are customers; a color is a market segment.
@registered("g02_split", "SELECT c_mktsegment AS color, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY -c_nationkey, c_custkey) - 1 AS INTEGER) AS rnk, c_custkey AS world_rank FROM customer")
def split(comm, buf, spark, sf_dir):
    c = views.table(spark, sf_dir, "customer")
    return comm.split(colors=c.select(F.col("c_custkey").alias("rank"), F.col("c_mktsegment").alias("color"), (-F.col("c_nationkey")).alias("key")))


@registered("g03_split_shared_memory", "SELECT s_nationkey AS color, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INTEGER) AS rnk, s_suppkey AS world_rank FROM supplier")
def split_shared(comm, buf, spark, sf_dir):
    s = views.table(spark, sf_dir, "supplier")
    return comm.split_to_shared_memory(hosts=s.select(F.col("s_suppkey").alias("rank"), F.col("s_nationkey").alias("host")))


@registered("g04_create_subcommunicators", "SELECT * FROM (VALUES (0, 1), (1, 3), (2, 0), (3, 4)) t(rnk, world_rank)")
def subcommunicators(comm, *_):
    return comm.create_subcommunicators(ranges=[RankRange(1, 3, 2), RankRange(0, 4, 4)])


def _groups(spark, sf_dir):
    n = views.table(spark, sf_dir, "nation")
    even = n.where("n_nationkey % 2 = 0").select(F.expr("cast(n_nationkey div 2 as int)").alias("ord"), F.col("n_nationkey").alias("world_rank"))
    third = n.where("n_nationkey % 3 = 0").select((8 - F.expr("n_nationkey div 3")).cast("int").alias("ord"), F.col("n_nationkey").alias("world_rank"))
    return Group(even), Group(third)


EVEN = "a AS (SELECT n_nationkey // 2 AS ord, n_nationkey AS world_rank FROM nation WHERE n_nationkey % 2 = 0), z AS (SELECT 8 - n_nationkey // 3 AS ord, n_nationkey AS world_rank FROM nation WHERE n_nationkey % 3 = 0)"
NUMBER = "CAST(row_number() OVER (ORDER BY {0}) - 1 AS INTEGER) AS ord, CAST(world_rank AS INTEGER) AS world_rank"


@registered("g12_group_difference", f", {EVEN} SELECT {NUMBER.format('ord')} FROM a WHERE world_rank NOT IN (SELECT world_rank FROM z)")
def difference(comm, buf, spark, sf_dir):
    a, z = _groups(spark, sf_dir)
    return a.difference(z).members


@registered("g12_group_intersection", f", {EVEN} SELECT {NUMBER.format('ord')} FROM a WHERE world_rank IN (SELECT world_rank FROM z)")
def intersection(comm, buf, spark, sf_dir):
    a, z = _groups(spark, sf_dir)
    return a.intersection(z).members


@registered("g12_group_union", f", {EVEN}, u AS (SELECT 0 AS part, * FROM a UNION ALL SELECT 1, * FROM z WHERE world_rank NOT IN (SELECT world_rank FROM a)) SELECT {NUMBER.format('part, ord')} FROM u")
def union(comm, buf, spark, sf_dir):
    a, z = _groups(spark, sf_dir)
    return a.set_union(z).members


@registered("g13_translate_ranks", f", {EVEN} SELECT CAST(a.ord AS INTEGER) AS rnk, CAST(z.ord AS INTEGER) AS other_rank FROM a LEFT JOIN z USING (world_rank)")
def translate(comm, buf, spark, sf_dir):
    a, z = _groups(spark, sf_dir)
    return a.translate_ranks_to(z)


@registered("g11_group_compare", "SELECT * FROM (VALUES ('self', 'identical'), ('reversed', 'similar'), ('other', 'unequal')) t(pair, result)")
def compare(comm, buf, spark, sf_dir):
    a, z = _groups(spark, sf_dir)
    back = Group(a.members.withColumn("ord", -F.col("ord")))
    pairs = [("self", a, a), ("reversed", a, back), ("other", a, z)]
    out = None
    for name, x, y in pairs:
        one = x.compare(y).select(F.lit(name).alias("pair"), "result")
        out = one if out is None else out.unionByName(one)
    return out


@registered("g05_communicator_compare", "SELECT 'congruent' AS result")
def communicator_compare(comm, buf, spark, sf_dir):
    mine = comm.create_subcommunicators(ranks=[3, 1])
    return comm.compare(mine, comm.create_subcommunicators(ranks=[3, 1]))


@registered("g06_convert_rank", "SELECT * FROM (VALUES (0, 2), (1, NULL), (2, 0)) t(rnk, other_rank)")
def convert(comm, *_):
    return comm.convert_rank(comm.create_subcommunicators(ranks=[4, 0, 2]), comm.create_subcommunicators(ranks=[2, 3, 4]))


@registered("g07_rank_shifted_checked", "SELECT rnk, CAST(rnk + 1 AS INTEGER) AS shifted FROM r WHERE rnk < 4")
def shifted_checked(comm, *_):
    return comm.ranks.where("rank < 4").select("rank", comm.rank_shifted_checked(F.col("rank"), 1).alias("shifted"))


@registered("g08_rank_shifted_cyclic", "SELECT rnk, CAST((rnk - 7 % 5 + 5) % 5 AS INTEGER) AS shifted FROM r")
def shifted_cyclic(comm, *_):
    return comm.ranks.select("rank", comm.rank_shifted_cyclic(F.col("rank"), -7).alias("shifted"))


@registered("g14_rank_ranges", "SELECT c_custkey AS rnk FROM customer WHERE c_custkey = 1 OR (c_custkey BETWEEN 2 AND 60 AND (c_custkey - 2) % 2 = 0) OR (c_custkey BETWEEN 5 AND 95 AND (c_custkey - 95) % 9 = 0)")
def ranges(comm, buf, spark, sf_dir):
    chosen = [RankRange(1, 1, 1), RankRange(2, 60, 2), RankRange(95, 5, -9)]
    return views.table(spark, sf_dir, "customer").where(any_contains(chosen, F.col("c_custkey"))).select(F.col("c_custkey").alias("rank"))


# Graphs: a ring, and three parallel edges to the successor.
def _ring(comm, spark):
    return Topology(comm, edges(spark, {r: [(r - 1) % P, (r + 1) % P] for r in range(P)}))


@registered("c14_neighbor_ring", f", h AS (SELECT rnk, pos, value, pos // 10 AS k, pos % 10 AS j FROM b WHERE pos < 20) SELECT CAST(CASE WHEN k = 0 THEN (rnk + 4) % 5 ELSE (rnk + 1) % 5 END AS INTEGER) AS rnk, (1 - k) * 10 + j AS pos, value FROM h")
def neighbor_ring(comm, buf, spark, sf_dir):
    return _ring(comm, spark).neighbor_alltoall(send_buf=buf.where("pos < 20"))


@registered("c14_neighbor_multi_edge", "SELECT CAST((rnk + 1) % 5 AS INTEGER) AS rnk, pos, value FROM b WHERE pos < 3")
def neighbor_multi(comm, buf, spark, sf_dir):
    graph = Topology.from_out_edges(comm, edges(spark, {r: [(r + 1) % P] * 3 for r in range(P)}))
    return graph.neighbor_alltoall(send_buf=buf.where("pos < 3"), send_count=1)


# The same graphs, with whole buffers: a block is the buffer's size divided by the out-degree.
@registered("c14_neighbor_ring_whole", ", h AS (SELECT rnk, value, n // 2 AS m, pos // (n // 2) AS k, pos % (n // 2) AS j FROM b, n) SELECT CAST(CASE WHEN k = 0 THEN (rnk + 4) % 5 ELSE (rnk + 1) % 5 END AS INTEGER) AS rnk, (1 - k) * m + j AS pos, value FROM h")
def neighbor_ring_whole(comm, buf, spark, sf_dir):
    return _ring(comm, spark).neighbor_alltoall(send_buf=buf)


@registered("c14_neighbor_multi_edge_whole", "SELECT CAST((rnk + 1) % 5 AS INTEGER) AS rnk, pos, value FROM b")
def neighbor_multi_whole(comm, buf, spark, sf_dir):
    graph = Topology.from_out_edges(comm, edges(spark, {r: [(r + 1) % P] * 3 for r in range(P)}))
    return graph.neighbor_alltoall(send_buf=buf)


GRAPH = {1: [(2, 4), (3, 3), (2, 2)], 4: [(1, 7)]}
GRAPH_SQL = "e(rnk, ord, peer, weight) AS (VALUES (1, 0, 2, 4), (1, 1, 3, 3), (1, 2, 2, 2), (4, 0, 1, 7))"


@registered("g15_graph_in_edges", f", {GRAPH_SQL} SELECT peer AS rnk, CAST(row_number() OVER (PARTITION BY peer ORDER BY rnk, ord) - 1 AS INTEGER) AS ord, rnk AS peer, weight FROM e")
def in_edges(comm, buf, spark, sf_dir):
    return Topology.from_out_edges(comm, edges(spark, GRAPH)).in_edges


@registered("g16_neighbor_index", f", {GRAPH_SQL} SELECT rnk, peer, min(ord) AS index FROM e GROUP BY rnk, peer")
def neighbor_index(comm, buf, spark, sf_dir):
    return Topology.from_out_edges(comm, edges(spark, GRAPH)).rank_to_out_neighbor_index()


@registered("g17_degrees", f", {GRAPH_SQL} SELECT r.rnk, (SELECT count(*) FROM e WHERE e.rnk = r.rnk) AS out_degree, (SELECT count(*) FROM e WHERE peer = r.rnk) AS in_degree FROM r")
def degrees(comm, buf, spark, sf_dir):
    graph = Topology.from_out_edges(comm, edges(spark, GRAPH))
    return graph.out_degree().join(graph.in_degree(), "rank")


SORTED = "s AS (SELECT value, row_number() OVER (ORDER BY {0}, rnk, pos) - 1 AS index, CAST(ceil(count(*) OVER () / 5) AS BIGINT) AS share FROM b) SELECT CAST(index // share AS INTEGER) AS rnk, index % share AS pos, value, index FROM s"


@registered("l01_sort", ", " + SORTED.format("value"))
def sort(comm, buf, *_):
    return comm.sort(send_buf=buf)


@registered("l03_sort_descending", ", " + SORTED.format("value DESC"))
def sort_descending(comm, buf, *_):
    return comm.sort(send_buf=buf, by=[F.col("value").desc()])


@registered("l03_sort_struct", ", " + SORTED.format("value % 10, value // 10, value"))
def sort_struct(comm, buf, *_):
    z = buf.withColumn("value", F.struct((F.col("value") % 10).alias("x"), F.expr("value div 10").alias("y"), F.col("value").alias("z")))
    return comm.sort(send_buf=z).withColumn("value", F.col("value.z"))


@registered("e01_globally_sorted", "SELECT true AS is_sorted")
def globally_sorted(comm, buf, *_):
    return algorithms.globally_sorted(comm.sort(send_buf=buf))


@registered("e04_top_k", "SELECT rnk, pos, value FROM b ORDER BY value, rnk, pos LIMIT 10")
def top_k(comm, buf, *_):
    return comm.top_k(send_buf=buf, k=10)


OWNER = f"t AS (SELECT CAST(o_orderkey % {P} AS INTEGER) AS src, CAST(c_nationkey % {P} AS INTEGER) AS dst, o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders JOIN customer ON o_custkey = c_custkey)"


def owned(spark, sf_dir):
    """Orders with their own rank and the rank that owns their customer's nation."""
    c = views.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    o = views.table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return o.select((F.col("o_orderkey") % P).cast("int").alias("rank"), (F.col("c_nationkey") % P).cast("int").alias("dest"), F.col("o_orderkey").alias("k"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))


@registered("l04_sparse_exchange", f", {OWNER} SELECT dst AS rnk, src AS source, count(*) AS messages, CAST(sum(cents) AS BIGINT) AS cents FROM t GROUP BY dst, src")
def sparse(comm, buf, spark, sf_dir):
    # A message for every 16 orders of a pair of ranks, so that none grows with the data.
    messages = owned(spark, sf_dir).groupBy("rank", "dest", F.expr("k div 80").alias("part")).agg(F.collect_list("cents").alias("msg"))
    got = comm.alltoallv_sparse(messages=messages.select("rank", "dest", "msg"))
    return got.groupBy("rank", "source").agg(F.sum(F.size("msg")).cast("long").alias("messages"), F.sum(F.aggregate("msg", F.lit(0).cast("long"), lambda a, x: a + x)).alias("cents"))


@registered("l04_sparse_callback", f", {OWNER} SELECT dst AS rnk, src AS source, CAST(sum(cents % 97) AS BIGINT) AS digest FROM t GROUP BY dst, src")
def sparse_callback(comm, buf, spark, sf_dir):
    messages = owned(spark, sf_dir).groupBy("rank", "dest", F.expr("k div 80").alias("part")).agg(F.collect_list("cents").alias("msg"))
    received = lambda rank, source, msg: {"rank": [rank], "source": [source], "digest": [sum(int(x) % 97 for x in msg)]}
    got = comm.alltoallv_sparse(messages=messages.select("rank", "dest", "msg"), on_message=received, schema="rank int, source int, digest long")
    return got.groupBy("rank", "source").agg(F.sum("digest").alias("digest"))


@registered("l05_grid", f"""SELECT CAST(r AS INTEGER) AS rnk, CAST(CASE WHEN r // c >= {P} // c THEN r % c ELSE r // c END AS INTEGER) AS "row", CAST(r % c AS INTEGER) AS col
FROM range({P}) ranks(r), (SELECT CAST(CASE WHEN {P} >= floor(sqrt({P})) * ceil(sqrt({P})) THEN ceil(sqrt({P})) ELSE floor(sqrt({P})) END AS BIGINT) AS c)""")
def grid(comm, *_):
    return comm.grid()


@registered("l06_grid_envelope", SEGMENTS + " SELECT dst AS rnk, CAST(rd + pos - sd AS BIGINT) AS pos, value, src AS source, dst AS destination FROM b JOIN seg ON b.rnk = src AND pos >= sd AND pos < sd + cnt")
def envelope(comm, buf, *_):
    return comm.grid_alltoallv_with_envelope(send_buf=buf, send_counts=pair_counts(comm, buf))


@registered("l08_dispatch_strategy", SEGMENTS + " SELECT CAST(max(bytes) AS BIGINT) AS max_bytes, CASE WHEN max(bytes) < 2000 THEN 'grid' ELSE 'direct' END AS strategy FROM (SELECT sum(cnt) * 8 AS bytes FROM seg GROUP BY src)")
def strategy(comm, buf, *_):
    return comm.chosen_strategy(send_counts=pair_counts(comm, buf), element_bytes=8)


@registered("l08_alltoallv_dispatch", SEGMENTS + " SELECT dst AS rnk, CAST(rd + pos - sd AS BIGINT) AS pos, value FROM b JOIN seg ON b.rnk = src AND pos >= sd AND pos < sd + cnt")
def dispatch(comm, buf, *_):
    return comm.alltoallv_dispatch(send_buf=buf, send_counts=pair_counts(comm, buf))


@registered("l11_shrink_agree", "SELECT CAST(row_number() OVER (ORDER BY rnk) - 1 AS INTEGER) AS rnk, rnk AS world_rank, (SELECT bit_and(value) FROM b) AS agreed FROM r WHERE rnk NOT IN (1, 3)")
def shrink(comm, buf, *_):
    return comm.shrink(failed=[1, 3]).crossJoin(F.broadcast(comm.agree(flags=buf).withColumnRenamed("value", "agreed")))


# Containers: rank r has, for each destination d, the first (r + d) % 4 values.
@registered("u01_flatten", ", q AS (SELECT a.rnk, z.rnk AS peer, (a.rnk + z.rnk) % 4 AS count FROM r a, r z) SELECT rnk, peer, CAST(count AS BIGINT) AS count, CAST(coalesce(sum(count) OVER (PARTITION BY rnk ORDER BY peer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS displ FROM q")
def flatten(comm, buf, *_):
    return nested.flatten(_containers(buf), P)[1]


def _containers(buf):
    own = buf.where("pos < 4").groupBy("rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("xs"))
    parts = F.array(*(F.slice("xs", 1, (F.col("rank") + d) % 4) for d in range(P)))
    return own.select("rank", F.map_filter(F.map_from_arrays(F.array(*(F.lit(d) for d in range(P))), parts), lambda k, v: F.size(v) > 0).alias("container"))


@registered("u02_with_flattened", ", q AS (SELECT a.rnk AS src, z.rnk AS dst, (a.rnk + z.rnk) % 4 AS cnt, coalesce(sum((a.rnk + z.rnk) % 4) OVER (PARTITION BY z.rnk ORDER BY a.rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rd FROM r a, r z) SELECT dst AS rnk, CAST(rd + pos AS BIGINT) AS pos, value FROM b JOIN q ON b.rnk = src AND pos < cnt")
def with_flattened(comm, buf, *_):
    return nested.with_flattened(comm, _containers(buf))


@registered("u03_span", "SELECT 'middle' AS part, rnk, pos - 10 AS pos, value FROM b WHERE pos >= 10 AND pos < 25 UNION ALL SELECT 'last', rnk, pos - (n - 5), value FROM b, n WHERE pos >= n - 5 UNION ALL SELECT 'back', rnk, CAST(0 AS BIGINT), value FROM b, n WHERE pos = n - 1")
def span(comm, buf, *_):
    s = nested.Span(buf)
    zero = F.lit(0).cast("long")
    parts = [("middle", s.subspan(10, 15)), ("last", s.last(5)), ("back", s.back().withColumn("pos", zero))]
    out = None
    for name, part in parts:
        one = part.select(F.lit(name).alias("part"), "rank", "pos", "value")
        out = one if out is None else out.unionByName(one)
    return out


@registered("u04_checked_casts", "SELECT o_orderkey AS k, value * 40 BETWEEN -32768 AND 32767 AS fits, TRY_CAST(value * 40 AS SMALLINT) AS small FROM (SELECT o_orderkey, o_custkey AS value FROM orders)")
def casts(comm, buf, spark, sf_dir):
    o = views.table(spark, sf_dir, "orders")
    x = F.col("o_custkey") * 40
    return o.select(F.col("o_orderkey").alias("k"), nested.in_range(x, "smallint").alias("fits"), F.when(nested.in_range(x, "smallint"), nested.throwing_cast(F.when(nested.in_range(x, "smallint"), x), "smallint")).alias("small"))


@registered("u07_serialized", "SELECT r.rnk, n_nationkey AS k, n_name AS name FROM nation, r")
def serialized(comm, buf, spark, sf_dir):
    n = views.table(spark, sf_dir, "nation")
    sent = n.select(F.lit(0).alias("rank"), F.col("n_nationkey").cast("long").alias("pos"), nested.as_serialized(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))).alias("value"))
    got = comm.bcast(send_recv_buf=sent)
    return got.select("rank", nested.as_deserializable(F.col("value"), "k int, name string").alias("x")).select("rank", "x.k", "x.name")


# Measurements: events are a log of rank user_id % P.
EVENTS = f"v AS (SELECT CAST(user_id % {P} AS INTEGER) AS rnk, 'root.' || event_type AS path, event_id AS w, CAST(round(value * 100) AS BIGINT) AS value, event_id % 4 = 0 AS append FROM events)"
ACCUMULATED = EVENTS + ", o AS (SELECT *, CAST(sum(CAST(append OR opens AS INTEGER)) OVER (PARTITION BY rnk, path ORDER BY w) - 1 AS INTEGER) AS seq FROM (SELECT *, row_number() OVER (PARTITION BY rnk, path ORDER BY w) = 1 AS opens FROM v)), acc AS (SELECT rnk, path, seq, CAST(sum(value) AS BIGINT) AS value FROM o GROUP BY rnk, path, seq)"


def _events(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % P).cast("int").alias("rank"), F.concat(F.lit("root."), "event_type").alias("path"), F.col("event_id").alias("at"), F.round(F.col("value") * 100).cast("long").alias("value"), (F.col("event_id") % 4 == 0).alias("append"))


@registered("m02_local_aggregation", f", {ACCUMULATED} SELECT rnk, path, seq, value FROM acc")
def local_aggregation(comm, buf, spark, sf_dir):
    return measure.accumulated(_events(spark, sf_dir))


@registered("m03_global_aggregation", f", {ACCUMULATED} SELECT path, seq, min(value) AS min, max(value) AS max, CAST(sum(value) AS BIGINT) AS sum FROM acc GROUP BY path, seq")
def global_aggregation(comm, buf, spark, sf_dir):
    return measure.aggregated(measure.accumulated(_events(spark, sf_dir)), ("min", "max", "sum"))


@registered("m03_gather", f", {ACCUMULATED} SELECT path, seq, string_agg(CAST(value AS VARCHAR), ',' ORDER BY rnk) AS gathered FROM acc GROUP BY path, seq")
def gathered(comm, buf, spark, sf_dir):
    found = measure.aggregated(measure.accumulated(_events(spark, sf_dir)), ("gather",))
    return found.select("path", "seq", F.concat_ws(",", F.transform("gather", lambda x: x.cast("string"))).alias("gathered"))


@registered("m04_divergence", f", {ACCUMULATED}, c AS (SELECT path, rnk, count(*) AS n FROM acc GROUP BY path, rnk) SELECT path, count(*) AS ranks, min(n) AS least, max(n) AS most FROM c GROUP BY path HAVING count(*) <> {P} OR min(n) <> max(n)")
def divergence(comm, buf, spark, sf_dir):
    return measure.diverging(measure.accumulated(_events(spark, sf_dir)), P)


@registered("m05_counter", f", {EVENTS} SELECT path, CAST(0 AS INTEGER) AS seq, count(*) AS sum FROM v GROUP BY path")
def counted(comm, buf, spark, sf_dir):
    ones = _events(spark, sf_dir).withColumns({"value": F.lit(1).cast("long"), "append": F.lit(False)})
    return measure.aggregated(measure.accumulated(ones), ("sum",))


@registered("m07_flat_lines", f", {EVENTS}, a AS (SELECT path, rnk, sum(value) AS value FROM v GROUP BY path, rnk) SELECT path || ':max=[' || printf('%.6f', CAST(max(value) AS DOUBLE)) || ']' AS line FROM a GROUP BY path")
def flat_lines(comm, buf, spark, sf_dir):
    log = measure.accumulated(_events(spark, sf_dir).withColumn("append", F.lit(False)))
    return measure.flat_lines(measure.aggregated(log, ("max",)), "max")


BFS_DEPTH = 40
LINKS = "e AS (SELECT o_orderkey AS src, (o_orderkey * 2 + o_custkey) % (SELECT count(*) FROM orders) AS dst FROM orders UNION SELECT o_orderkey, (o_orderkey * 3 + 1) % (SELECT count(*) FROM orders) FROM orders)"


@registered("e02_bfs_levels", f"WITH RECURSIVE {LINKS}, t(vertex, level) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT dst, level + 1 FROM t JOIN e ON vertex = src WHERE level < {BFS_DEPTH}) SELECT vertex, CAST(min(level) AS INTEGER) AS level FROM t GROUP BY vertex")
def bfs(comm, buf, spark, sf_dir):
    o = views.table(spark, sf_dir, "orders")
    n = o.agg(F.count("*").alias("n"))
    both = F.array((F.col("o_orderkey") * 2 + F.col("o_custkey")) % F.col("n"), (F.col("o_orderkey") * 3 + 1) % F.col("n"))
    links = o.crossJoin(F.broadcast(n)).select(F.col("o_orderkey").alias("src"), F.explode(both).alias("dst"))
    return algorithms.bfs_levels(links, 0)


@registered("e03_suffix_array", "WITH t AS (SELECT string_agg(n_name, ' ' ORDER BY n_nationkey) AS s FROM nation), i AS (SELECT s, unnest(range(length(s))) AS start FROM t) SELECT row_number() OVER (ORDER BY substr(s, start + 1)) - 1 AS slot, start FROM i")
def suffix_array(comm, buf, spark, sf_dir):
    n = views.table(spark, sf_dir, "nation")
    text = n.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]), " ").alias("s"))
    chars = text.select(F.posexplode(F.split("s", "")).alias("pos", "ch")).where("ch <> ''").withColumn("pos", F.col("pos").cast("long"))
    return algorithms.suffix_array(chars)


@registered("flagship", f", {OWNER}, c AS (SELECT dst, count(*) AS received, CAST(sum(cents) AS BIGINT) AS cents FROM t GROUP BY dst), f AS (SELECT r.rnk, coalesce(received, 0) AS received, coalesce(cents, 0) AS cents FROM r LEFT JOIN c ON dst = r.rnk) SELECT rnk, received, cents, CAST(coalesce(sum(received) OVER (ORDER BY rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM f")
def flagship(comm, buf, spark, sf_dir):
    """Orders go to the rank that owns their customer's nation; each rank's sums, and where its rows begin among all."""
    got = owned(spark, sf_dir).groupBy(F.col("dest").alias("rank")).agg(F.count("*").alias("received"), F.sum("cents").alias("cents"))
    whole = comm.ranks.join(got, "rank", "left").select("rank", F.coalesce("received", F.lit(0)).alias("received"), F.coalesce("cents", F.lit(0)).alias("cents"))
    counts = whole.select("rank", F.lit(0).cast("long").alias("pos"), F.col("received").alias("value"))
    first = comm.exscan(send_buf=counts, op="sum").select("rank", F.col("value").alias("first"))
    return whole.join(first, "rank")
