"""Non-blocking operations, measurements, algorithms, sources."""

import math

import pytest

from ringfold.functions.measure import Counter, Timer, to_json_text
from ringfold.operators import Communicator, Environment, comm_world, world_size
from ringfold.operators.buffer import from_lists
from ringfold.plans import algorithms
from ringfold.sources import views
from ringfold.streaming.requests import NonBlocking, Request, RequestPool, start, wait_all


def test_requests(spark):
    comm = NonBlocking(Communicator(spark, 3))
    b = from_lists(spark, [[1], [2], [3]], "long")
    result = comm.iallreduce(send_buf=b, op="sum")
    assert {r["value"] for r in result.wait().collect()} == {6}
    with pytest.raises(RuntimeError):
        result.wait()
    pool = RequestPool()
    assert pool.wait_any() == pool.index_end == 0
    pool.add(start(b, lambda d: d.count()))
    pool.add(start(b, lambda d: d.count() + 1))
    pool.wait_all()
    assert pool.test_all() and {pool.wait_any(), pool.test_any()} == {0, 1}
    assert pool.test_any() == pool.index_end == 2
    assert Request().is_null() and Request().test() and wait_all([Request()]) == [None]
    with pytest.raises(AttributeError):
        comm.inothing


def test_timer_and_counter(spark):
    clock = iter(range(100))
    t = Timer(now=lambda: next(clock))
    for _ in range(5):
        t.start("outer")
        t.start("inner")
        t.stop()
        t.stop_and_append(["max", "min"])
    assert [len(t.values[p]) for p in ("root.outer", "root.outer.inner")] == [5, 1]
    rows = {(r["path"], r["seq"]): r for r in t.aggregate(spark).collect()}
    assert rows["root.outer.inner", 0]["max"] == 5 and rows["root.outer", 4]["ops"] == ["max", "min"]
    with pytest.raises(RuntimeError):
        t.stop()
    a, b = Counter(0), Counter(1)
    a.add("x", 3), a.add("x", 4), b.add("x", 10)
    table = a.aggregate(spark, [b])
    assert table.first()["sum"] == 17 and table.first()["gather"] == [7.0, 10.0]
    assert '"sum"' in to_json_text(table)


def test_bfs_on_a_path(spark):
    path = spark.createDataFrame([(v, v + 1) for v in range(7)] + [(7, 0)], "src long, dst long")
    assert {r["vertex"]: r["level"] for r in algorithms.bfs_levels(path, 0).collect()} == {v: v for v in range(8)}


@pytest.mark.parametrize("text", ["banana", "a" * 40, "ab" * 20, "the cat sat on the mat", "x"])
def test_suffix_array(spark, text):
    chars = spark.createDataFrame(list(enumerate(text)), "pos long, ch string")
    got = [r["start"] for r in algorithms.suffix_array(chars).orderBy("slot").collect()]
    assert got == sorted(range(len(text)), key=lambda k: text[k:])


def test_byte_file(spark, tmp_path):
    (tmp_path / "f").write_bytes(bytes(range(11)))
    rows = views.byte_file(spark, str(tmp_path / "f"), 3).collect()
    assert sorted((r["rank"], r["pos"], r["value"]) for r in rows) == [(min(k // 3, 2), k - 3 * min(k // 3, 2), k) for k in range(11)]


def test_default_communicator(spark):
    comm = comm_world(spark)
    assert comm.size == spark.sparkContext.defaultParallelism and comm.is_root(0) and comm.num_numa_nodes(comm.ranks.selectExpr("rank", "rank div 2 as host")).first()["nodes"] == -(-comm.size // 2)
    with pytest.raises(RuntimeError):
        comm.abort()


def test_neighbour_exchange_takes_whole_buffers(spark, sf):
    from ringfold.plans import catalog

    rows = spark.read.parquet(f"{sf}/orders.parquet").count()
    for name in ("c14_neighbor_ring_whole", "c14_neighbor_multi_edge_whole"):
        assert catalog.queries()[name](spark, sf).count() == rows, name


def test_bfs_raises_where_levels_are_left(spark):
    import pytest

    path = spark.createDataFrame([(v, v + 1) for v in range(7)], "src long, dst long")
    with pytest.raises(RuntimeError, match="max_levels"):
        algorithms.bfs_levels(path, 0, 3)


@pytest.mark.parametrize("p", [1, 3, 4, 5, 11, 13])
def test_grid_of_any_number_of_ranks(spark, p):
    """Rows and columns differ by one at most; ranks of an incomplete last row keep their column and join another row."""
    got = {r["rank"]: (r["row"], r["col"]) for r in Communicator(spark, p).grid().collect()}
    low, high = math.isqrt(p), math.ceil(math.sqrt(p))
    cols = high if p >= low * high else low
    full = p // cols * cols
    assert got == {r: (r // cols if r < full else r % cols, r % cols) for r in range(p)}


def test_non_blocking_barrier_and_extracted_requests(spark):
    comm = NonBlocking(Communicator(spark, 3))
    b = from_lists(spark, [[1], [2], [3]], "long")
    found = comm.ibarrier(b).wait()
    assert [x.count() for x in found] == [3]
    result = comm.iallreduce(send_buf=b, op="sum")
    request = result.extract()
    assert {r["value"] for r in request.wait().collect()} == {6} and result.done
    with pytest.raises(RuntimeError):
        result.wait()


def test_environment(spark):
    assert Environment.is_valid_tag(0) and Environment.is_valid_tag(Environment.tag_upper_bound)
    assert not Environment.is_valid_tag(-1) and not Environment.is_valid_tag(Environment.tag_upper_bound + 1)
    assert Environment.wtime() <= Environment.wtime() and 0 < Environment.wtick() < 1
    assert world_size(spark) == comm_world(spark).size
