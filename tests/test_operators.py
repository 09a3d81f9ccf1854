"""Closed forms, algebra and edge cases, for several numbers of ranks."""

import pytest
from pyspark.sql import functions as F

from ringfold.functions.reduce_ops import BUILTIN, op
from ringfold.operators import Communicator, Group, RankRange
from ringfold.operators import nested
from ringfold.operators.buffer import from_lists, merge_into
from ringfold.operators.topology import Topology, edges

SIZES = (1, 2, 4, 5, 13)


def lists(df, p):
    out = [{} for _ in range(p)]
    for r in df.collect():
        assert r["pos"] not in out[r["rank"]]
        out[r["rank"]][r["pos"]] = r["value"]
    assert all(sorted(own) == list(range(len(own))) for own in out)
    return [[own[k] for k in sorted(own)] for own in out]


def buf(spark, data, kind="long"):
    return from_lists(spark, data, kind)


@pytest.mark.parametrize("p", SIZES)
def test_ragged_gather(spark, p):
    comm = Communicator(spark, p)
    got = comm.allgatherv(send_buf=buf(spark, [[float(r)] * r for r in range(p)], "double"), out=["recv_counts", "recv_displs"])
    assert lists(got.recv_buf, p) == [[float(r) for r in range(p) for _ in range(r)]] * p if p > 1 else lists(got.recv_buf, p) == [[]]
    assert [r["count"] for r in got.recv_counts.orderBy("rank").collect()] == list(range(p))
    assert [r["displ"] for r in got.recv_displs.orderBy("rank").collect()] == [r * (r - 1) // 2 for r in range(p)]


@pytest.mark.parametrize("p", SIZES)
def test_scatterv_and_back(spark, p):
    comm = Communicator(spark, p)
    data = [r for r in range(p) for _ in range(r + 1)]
    got = comm.scatterv(send_buf=buf(spark, [data] + [[]] * (p - 1)), send_counts=[r + 1 for r in range(p)])
    assert lists(got, p) == [[r] * (r + 1) for r in range(p)]
    assert lists(comm.gatherv(send_buf=got), p)[0] == data


@pytest.mark.parametrize("p", SIZES)
def test_alltoall_is_its_own_inverse(spark, p):
    comm = Communicator(spark, p)
    data = [[100 * r + k for k in range(3 * p)] for r in range(p)]
    once = comm.alltoall(send_buf=buf(spark, data))
    assert lists(once, p) == [[100 * s + 3 * r + k for s in range(p) for k in range(3)] for r in range(p)]
    assert lists(comm.alltoall(send_buf=once), p) == data
    counts = spark.createDataFrame([(r, q, 3) for r in range(p) for q in range(p)], "rank int, peer int, count long")
    assert lists(comm.alltoallv(send_buf=buf(spark, data), send_counts=counts), p) == lists(once, p)


@pytest.mark.parametrize("p", (2, 5))
def test_alltoallv_with_reversed_displacements(spark, p):
    comm = Communicator(spark, p)
    data = [[r] * (p * (p - 1) // 2) for r in range(p)]
    counts = spark.createDataFrame([(r, q, q) for r in range(p) for q in range(p)], "rank int, peer int, count long")
    displs = spark.createDataFrame([(r, s, r * (p - 1 - s)) for r in range(p) for s in range(p)], "rank int, peer int, displ long")
    got = lists(comm.alltoallv(send_buf=buf(spark, data), send_counts=counts, recv_displs=displs), p)
    assert got == [[s for s in range(p - 1, -1, -1) for _ in range(r)] for r in range(p)]


@pytest.mark.parametrize("p", SIZES)
def test_reductions_and_scans(spark, p):
    comm = Communicator(spark, p)
    b = buf(spark, [[r, 42] for r in range(p)])
    assert lists(comm.allreduce(send_buf=b, op="sum"), p) == [[p * (p - 1) // 2, 42 * p]] * p
    scan, ex = lists(comm.scan(send_buf=b, op="plus"), p), lists(comm.exscan(send_buf=b, op="plus", values_on_rank_0=[0, 0]), p)
    assert ex == [[r * (r - 1) // 2, 42 * r] for r in range(p)]
    assert scan == [[x + r, y + 42] for r, (x, y) in enumerate(ex)]
    right = op(lambda a, x: x, commutative=False)
    tags = buf(spark, [[r + 17] for r in range(p)])
    assert lists(comm.scan(send_buf=tags, op=right), p) == [[r + 17] for r in range(p)]
    assert lists(comm.exscan(send_buf=tags, op=right, values_on_rank_0=0), p) == [[r + 16 if r else 0] for r in range(p)]
    assert lists(comm.exscan(send_buf=buf(spark, [[0]] * p), op="plus", values_on_rank_0=1337), p) == [[0 if r else 1337] for r in range(p)]


def test_null_partial_result_is_not_rank_0(spark):
    comm = Communicator(spark, 3)
    b = buf(spark, [[None], [5], [None]])
    assert lists(comm.exscan(send_buf=b, op="max", values_on_rank_0=7), 3) == [[7], [None], [5]]


@pytest.mark.parametrize("name", sorted(BUILTIN))
def test_builtin_operations(spark, name):
    values = [3, 6, 5]
    logical = name.startswith("logical")
    b = buf(spark, [[bool(v % 2)] if logical else [v] for v in values], "boolean" if logical else "int")
    wanted = {"max": 6, "min": 3, "plus": 14, "multiplies": 90, "logical_and": False, "logical_or": True, "logical_xor": False, "bit_and": 3 & 6 & 5, "bit_or": 7, "bit_xor": 3 ^ 6 ^ 5}
    got = Communicator(spark, 3).reduce(send_buf=b, op=name)
    assert got.schema["value"].dataType.simpleString() == ("boolean" if logical else "int")
    assert lists(got, 3)[0] == [wanted[name]]
    with pytest.raises(TypeError):
        op(name, commutative=True)


def test_rejected_parameters(spark):
    comm = Communicator(spark, 2)
    b = buf(spark, [[1], [2]])
    for bad in (lambda: comm.reduce(send_buf=b), lambda: comm.gather(recv=b), lambda: op(lambda a, x: a), lambda: op("nothing")):
        with pytest.raises(TypeError):
            bad()
    with pytest.raises(TypeError):
        comm.reduce(send_buf=buf(spark, [["a"], ["b"]], "string"), op="sum")
    for bad in (lambda: comm.bcast(send_recv_buf=b, root=2), lambda: Communicator(spark, 0), lambda: comm.with_default_tag(-1)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(Exception, match="multiple"):
        comm.alltoall(send_buf=buf(spark, [[1, 2, 3], [4, 5, 6]])).collect()
    with pytest.raises(Exception, match="differ in size"):
        comm.gather(send_buf=buf(spark, [[1, 2], [3]])).collect()


def test_resize_policies(spark):
    old, new = buf(spark, [[1, 2, 3]]), buf(spark, [[9, 8]])
    assert lists(merge_into(old, new), 1) == [[9, 8]]
    assert lists(merge_into(old, new, "no_resize"), 1) == [[9, 8, 3]]
    assert lists(merge_into(new, old, "grow_only"), 1) == [[1, 2, 3]]
    with pytest.raises(Exception, match="too small"):
        merge_into(new, old, "no_resize").collect()


@pytest.mark.parametrize("p", (3, 5))
def test_neighbours(spark, p):
    comm = Communicator(spark, p)
    ring = Topology(comm, edges(spark, {r: [(r - 1) % p, (r + 1) % p] for r in range(p)}))
    sent = buf(spark, [[(r - 1) % p, (r + 1) % p] for r in range(p)])
    assert lists(ring.neighbor_alltoall(send_buf=sent), p) == [[r, r] for r in range(p)]
    parallel = Topology.from_out_edges(comm, edges(spark, {r: [(r + 1) % p] * 3 for r in range(p)}))
    assert lists(parallel.neighbor_alltoall(send_buf=buf(spark, [[r] * 3 for r in range(p)])), p) == [[(r - 1) % p] * 3 for r in range(p)]


def test_reproducible_reduce_is_the_same_however_dealt(spark):
    comm = Communicator(spark, 4)
    rows = [(k, float(v)) for k, v in enumerate([5, 2, 3, 1, 7])]
    minus = op(lambda a, x: a - x, commutative=False)
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "idx long, value double").repartition(3)
        assert comm.reproducible_reduce(indexed=df, op=minus).first()["value"] == ((5 - 2) - (3 - 1)) - 7
        assert comm.reproducible_reduce(indexed=df, op="multiplies").first()["value"] == 210
    good = spark.createDataFrame([(0, 2, 3), (1, 3, 0), (2, 0, 9)], "rank int, send_count long, displ long")
    gap = spark.createDataFrame([(0, 2, 4), (1, 3, 0)], "rank int, send_count long, displ long")
    assert comm.check_distribution(good).first()["valid"] and not comm.check_distribution(gap).first()["valid"]


@pytest.mark.parametrize("p", (1, 4))
def test_sort(spark, p):
    comm = Communicator(spark, p)
    data = [[(7919 * (r * 50 + k)) % 101 for k in range(50 * r)] for r in range(p)]
    got = comm.sort(send_buf=buf(spark, data))
    assert [v for own in lists(got, p) for v in own] == sorted(v for own in data for v in own)
    assert [r["value"] for r in comm.top_k(send_buf=buf(spark, data), k=3).collect()] == sorted(v for own in data for v in own)[:3]


def test_groups(spark):
    world, empty = Group.of(spark, range(6)), Group.of(spark, [])
    ranks = lambda g: [r["world_rank"] for r in g.members.orderBy("ord").collect()]
    some = Group.of(spark, [4, 1, 9])
    assert ranks(world.difference(empty)) == list(range(6)) and ranks(world.intersection(empty)) == []
    assert ranks(some.set_union(world)) == [4, 1, 9, 0, 2, 3, 5] and ranks(some.intersection(world)) == [4, 1]
    assert [r["other_rank"] for r in some.translate_ranks_to(world).orderBy("rank").collect()] == [4, 1, None]
    assert RankRange(2, 6, 2).ranks() == [2, 4, 6] and RankRange(6, 2, -2).size == 3
    assert world.is_identical(world).first()["result"] and not world.has_same_ranks(some).first()["result"]


def test_messages(spark):
    comm = Communicator(spark, 4)
    to = comm.rank_shifted_cyclic(F.col("rank"), 1)
    b = buf(spark, [[r, 10 * r] for r in range(4)])
    log = comm.ssend(send_buf=b, destination=to, tag=3)
    got = comm.recv(log=log, tag=3).orderBy("rank", "pos").collect()
    assert [(r["rank"], r["value"], r["source"]) for r in got] == [(r, v, (r - 1) % 4) for r in range(4) for v in ((r - 1) % 4, 10 * ((r - 1) % 4))]
    assert comm.recv(log=log, source=None).count() == 0 and comm.probe(log=log, tag=4).count() == 0
    assert comm.send(send_buf=b, destination=None).count() == 0
    with pytest.raises(Exception, match="longer"):
        comm.recv(log=log, recv_count=1).collect()


@pytest.mark.parametrize("p", (2, 5))
def test_flatten(spark, p):
    comm = Communicator(spark, p)
    sparse = spark.createDataFrame([(r, {d: [r] * ((r + d) % 3) for d in range(0, p, 2)}) for r in range(p)], "rank int, container map<int, array<long>>")
    assert lists(nested.with_flattened(comm, sparse), p) == [[r for r in range(p) for _ in range((r + d) % 3 if d % 2 == 0 else 0)] for d in range(p)]
    dense = spark.createDataFrame([(r, [[d] for d in range(p)]) for r in range(p)], "rank int, container array<array<long>>")
    assert lists(nested.with_flattened(comm, dense), p) == [[d] * p for d in range(p)]
    with pytest.raises(TypeError):
        nested.flatten(sparse.withColumn("container", F.lit(1)), p)


def test_plans(spark, sf):
    """Projections stay projections, and reductions combine before they shuffle."""
    comm = Communicator(spark, 5)
    from ringfold.sources import views

    b = views.orders(spark, sf, 5)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for free in (comm.gather(send_buf=b, send_count=60), comm.alltoall(send_buf=b, send_count=60), comm.bcast(send_recv_buf=b), comm.scatter(send_buf=b, send_count=60)):
        assert "Exchange" not in plan(free) and "Join" not in plan(free)
    reduced = plan(comm.allreduce(send_buf=b, op="sum"))
    assert reduced.count("Exchange") == 1 and "partial_sum" in reduced
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan(b)
