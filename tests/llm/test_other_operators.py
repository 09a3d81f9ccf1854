"""Url filter, WARC and neighbour search, the pipeline, and the registered queries."""

import base64
import gzip
import hashlib
import pathlib
import random
import re
import shutil
import subprocess
import sys

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from ringfold.llm import ann, queries, url_filter, warc
from ringfold.llm.common import workspace

PAGES = "page_id long, url string, html string, host string, judged string, id string, value int"

URLS = [
    None, "", "nothing", "http://", "HTTP://Example.NET/en/x", "https://a.example.net/en/", "https://example.netx/en/", "x://sub.b.example.com/de/y?q#f", "http://example.org/fr/1", "http://blog.x.org/es/2",
    "http://m.x.org/p?a=1&page=2&b", "http://x.org/ads/1", "http://x.org/loads/1", "http://x.org/a?utm_source=b", "http://x.org/y.EXE", "https://q.org/fr/z.html", "http://tracker.example.org", "://://a/b", "http://h\n/p\nq", "http://é.net/en/", "http://x.org/banner/deep/a.gif",
]


@pytest.fixture(scope="module")
def pages(spark):
    htmls = ["<p>a\r\n\r\nb</p>", None, "", "WARC/1.1 ü\r\n\r\nContent-Length: 3", "x" * 200_000]
    rows = [(k, u, htmls[k % len(htmls)], "h", "j", "i", 1) for k, u in enumerate(URLS)]
    return spark.createDataFrame([*rows, rows[0], rows[4], (None, None, None, None, None, None, None), (2, "other", "y", None, None, None, None)], PAGES).repartition(3)


@pytest.fixture(scope="module")
def no_pages(pages):
    return pages.limit(0)


# Url filter


def test_url_filter_against_all_rules(pages, no_pages):
    rows = {}
    for inline in (True, False):
        out = url_filter.judge(pages, inline=inline)
        assert out.columns == pages.columns
        rows[inline] = sorted(map(str, out.select("page_id", "url", "judged").collect()))
    assert rows[True] == rows[False]
    con = duckdb.connect()
    frame = pages.select("page_id", "url").toArrow()  # noqa: F841
    con.register("pages", frame)
    wanted = con.sql(url_filter.SQL).fetchall()
    got = url_filter.judge(pages).select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict").collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, wanted))
    verdicts = {r["url"]: (r["judged"]["rule"], r["judged"]["verdict"]) for r in url_filter.judge(pages).collect()}
    assert verdicts["HTTP://Example.NET/en/x"] == ("example.net/en/", "allow") and verdicts["https://example.netx/en/"] == (None, "allow")
    assert verdicts["x://sub.b.example.com/de/y?q#f"] == ("example.com/de/", "block") and verdicts["http://x.org/y.EXE"] == (None, "block")
    assert verdicts["http://x.org/loads/1"] == (None, "allow") and verdicts["http://x.org/ads/1"] == (None, "block") and verdicts[None] == (None, "allow")
    assert url_filter.judge(no_pages).count() == 0


def test_many_rules_and_clashing_columns(spark):
    """Thousands of rules in both forms of the index, against all rules tried on all urls; columns like those used inside."""
    rng = random.Random(2)
    rules = [url_filter.PatternRule(f"/t{rng.randrange(4000)}/x{rng.randrange(9)}", rng.choice(["block", "block", "allow"])) for _ in range(3000)] + [url_filter.PatternRule("*q=*z|")]
    urls = [f"http://h.org/t{rng.randrange(4000)}/x{rng.randrange(9)}/y?q={rng.choice('az')}" for _ in range(300)] + [None, "", "x" * 100_000 + "/t1/x1"]
    frame = spark.createDataFrame([(u, 1, 2) for u in urls], "url string, __hits int, hits_0 int")
    out = [url_filter.judge(frame, rules=rules, inline=x) for x in (True, False)]
    assert all(o.columns == [*frame.columns, "judged"] for o in out)
    got = [sorted((r["url"] or "", r["judged"]["verdict"]) for r in o.collect()) for o in out]
    assert got[0] == got[1]
    compiled = [(re.compile(r.regex), r.verdict) for r in rules]
    for url, verdict in got[0]:
        hits = {v for x, v in compiled if x.search(url)}
        assert verdict == ("block" if hits == {"block"} else "allow")


def test_rules_stand_under_their_rarest_token():
    rules = [url_filter.PatternRule(p) for p in ("/ads/common/", "/ads/rare1/", "/ads/", "*x*")]
    assert url_filter.index(rules) == {"common": [0], "rare1": [1], "ads": [2], "": [3]}
    assert url_filter.index(rules, {"ads": 1, "common": 9, "rare1": 9})["ads"] == [0, 1, 2]


def test_url_filter_plan_is_native(pages):
    plan = url_filter.judge(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan


# WARC


@pytest.mark.parametrize("named", [True, False])
def test_warc_round_trip(spark, pages, no_pages, named, tmp_path):
    """A capture for each row, also for rows that repeat others, and for null and empty urls beside each other."""
    pages = pages.unionByName(spark.createDataFrame([(5, None, "x"), (5, "", "x"), (5, "", "x")], "page_id long, url string, html string"), allowMissingColumns=True)
    path, key = workspace(spark, "warc"), None
    if named:
        pages.write.parquet(str(tmp_path / "pages"))
        pages = spark.read.parquet(str(tmp_path / "pages"))
        key = F.concat_ws(":", "_metadata.file_path", "_metadata.row_index")
    warc.write_warc(pages, path, records_a_file=10, key=key)
    rows = [(r["page_id"], r["url"], r["html"]) for r in pages.select("page_id", "url", "html").collect()]
    found = warc.read_warc(spark, path).collect()
    tell = lambda i, u, n: (i is None, i or 0, u is None, u or "", n)
    assert sorted(tell(r["page_id"], r["url"], r["payload_bytes"]) for r in found) == sorted(tell(i, u, len((h or "").encode())) for i, u, h in rows)
    largest = {}
    for i, u, h in rows:
        largest[h or ""] = max(largest.get(h or "", (-1, "")), (-1 if i is None else i, u or ""))
    of_digest = {base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(): h for h in largest}
    for r in found:
        html = of_digest[r["response"]["digest"]]
        assert r["metadata"]["payload_bytes"] == len(html.encode())
        first = r["response"]["type"] == "response"
        assert not first or largest[html] == (-1 if r["page_id"] is None else r["page_id"], r["url"] or "")
        assert r["response"]["payload"].decode() == (html if first else "")
        assert r["refers_to_page"] == (None if first else largest[html][0])
        assert r["request"]["head"].startswith(b"GET ")
    responses = [r["response"]["digest"] for r in found if r["response"]["type"] == "response"]
    assert len(responses) == len(set(responses)) == len(of_digest)
    empty = workspace(spark, "warc")
    warc.write_warc(no_pages, empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_archives_of_many_members_are_read_piece_by_piece(monkeypatch):
    monkeypatch.setattr(warc, "_PIECE", 7)
    record = lambda k: b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (k, b"z" * k)
    sizes = [0, 1, 50, 4]
    for archive in (b"".join(gzip.compress(record(k)) for k in sizes), gzip.compress(b"".join(map(record, sizes))), b"".join(map(record, sizes))):
        assert [len(block) for _, block in warc.parse(archive)] == sizes
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parse(gzip.compress(record(50))[:-20]))


def test_small_payloads_are_no_revisits(spark, pages):
    path = workspace(spark, "warc")
    warc.write_warc(pages, path, min_bytes=1)
    found = warc.read_warc(spark, path, payload=False)
    assert found.where("metadata.payload_bytes = 0 and response.type = 'revisit'").count() == 0
    assert found.where("metadata.payload_bytes > 0 and response.type = 'revisit'").count() > 0


def test_broken_archives_are_errors():
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parse(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\nabc"))
    with pytest.raises(ValueError, match="no record"):
        list(warc.parse(b"HTTP/1.1"))


# Neighbours


def exact(rows, k):
    """Answers of the rows whose id is divisible by 20, from (id, vector): all other rows are candidates."""
    out = []
    for q, (i, v) in enumerate(rows):
        if i % 20 == 0:
            best = sorted((-float((np.array(v) * np.array(w)).sum()), j) for n, (j, w) in enumerate(rows) if n != q)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return out


def test_neighbours_of_few_vectors_are_exact(spark):
    rng = np.random.default_rng(0)
    rows = [(k, rng.normal(size=4).tolist()) for k in range(150)] + [(1000 + k, [1.0, 2.0, 3.0, 4.0]) for k in range(60)]
    rows += [rows[0], rows[0], rows[40], (20, [5.0, 0.0, 0.0, 0.0]), (1000, [1.0, 2.0, 3.0, 4.0]), (41, [9.0, 9.0, 9.0, 9.0])]  # repeated rows, and ids with other vectors
    odd = [(2000, None), (2020, [0.0] * 4), (2040, [1.0, float("nan"), 0.0, 0.0]), (2060, [1.0, 2.0]), (None, [1.0] * 4), (2080, [1.0, None, 1.0, 1.0]), (2100, [float("inf"), 1.0, 1.0, 1.0])]
    frame = spark.createDataFrame([(i, v, 9, "s") for i, v in rows + odd], "vec_id long, embedding array<double>, shard int, id string")
    found = ann.nearest(frame, frame.where("vec_id % 20 = 0"), 5, shard_rows=70).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found) == sorted(exact(rows, 5))
    few = frame.where("vec_id in (1, 2, 3, 5)")
    assert ann.nearest(few, few, 20).groupBy("query_id").count().where("count <> 3").count() == 0
    two = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 5.0]), (20, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in ann.nearest(two, two.where("vec_id = 20")).orderBy("rank").collect()] == [(20, 1, 1, 5.0), (20, 2, 1, 1.0)]
    assert ann.nearest(frame.limit(0), frame).count() == 0


def test_shards_grow_with_the_input():
    assert [ann.rows_a_shard(n) for n in (10, 1 << 20, 1 << 28, 1 << 40)] == [16_384, 16_384, 1 << 18, 1 << 20]


def test_recall(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    found = ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), shard_rows=150).collect()
    rows = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in vectors.collect()}
    wanted = {x[:1] + x[2:3] for x in exact(list(rows.items()), 20)}
    assert len({(r["query_id"], r["vec_id"]) for r in found} & wanted) >= 0.95 * len(wanted)


def test_graph_recall_and_degree():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(1500, 16)), 5 + 1e-3 * rng.normal(size=(500, 16))])  # a third in one tiny ball
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = ann.Graph(x)
    best = np.argsort(-(x[::10] @ x.T), axis=1)[:, :10]
    got = graph.nearest(x[::10], 10)
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(got.tolist(), best.tolist(), strict=True)]) > 0.9
    assert graph.edges.shape[1] == ann.DEGREE and all(len(set(e[e >= 0])) == (e >= 0).sum() and k not in e for k, e in enumerate(graph.edges))


# Pipeline and registration


def test_pipeline_stages(spark, edge, empty, sf):
    random.seed(0)
    docs = edge.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        docs = corpus_pipeline.written(stage(spark, docs, sf), name.replace(" ", "-"))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    nothing = empty.select(docs.columns)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, sf).count() == 0


def test_pipeline_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert out.columns == [*docs.columns, "ids"] and 0 < out.select("doc_id").distinct().count() < docs.count()
    labels = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    kept = out.select("doc_id").distinct().join(labels, "doc_id").groupBy("quality").count()
    assert {r["quality"]: r["count"] for r in kept.collect()}.get(0, 0) < labels.where("quality = 0").count() / 2


# Near-duplicates by shingle similarity


def brute_similar(texts):
    """Components of texts under five-word similarity of 0.8 or more, by comparing all pairs."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or (both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both)):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return root


def test_pipeline_keeps_one_of_edited_copies(spark, sf):
    """Edited copies from 0.7 to 1 similar, of all lengths, one large group, one common line; compared with all pairs."""
    rng = random.Random(8)
    say = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    line, texts = say(12), ["", None, " ", "a b", "A  b", "a b c"]
    for n in [5, 6, 8, 9, 10, 12, 15, 20, 28, 40, 60, 90, 140, 250, 600, 1500]:
        for edits in (0, 1, 1, 1, 2, 3, 5, max(1, n // 45), max(1, n // 40)):
            base = say(n)
            copy = list(base)
            for _ in range(edits):
                k = rng.randrange(len(copy)) if rng.random() < 0.6 else rng.choice([0, len(copy) - 1])
                copy[k : k + rng.choice([0, 1])] = say(rng.choice([0, 1, 1]))
            texts += [" ".join(base), " ".join(copy), " ".join(line + say(n)), " ".join([*copy, *say(n // 12)])]
    base = say(120)
    for _ in range(80):
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(120)] = say(1)[0]
        texts.append(" ".join(copy))
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, sf).select("doc_id").collect()}
    root = brute_similar(texts)
    assert kept == {k for k in range(len(texts)) if root[k] == k} and len(kept) < len(texts) * 0.8


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(name, spark, sf):
    """Names, types and rows."""
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df, wanted = queries.QUERIES[name](spark, sf), con.sql(queries.ORACLE[name])
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    assert {n: kinds[t] for n, t in df.dtypes} == {n: str(t) for n, t in zip(wanted.columns, wanted.types, strict=True)}
    key = lambda r: tuple(repr(r[n]) for n in df.columns)
    rows = [dict(zip(wanted.columns, r, strict=True)) for r in wanted.fetchall()]
    assert sorted(map(key, df.collect())) == sorted(map(key, rows)) and rows


def test_every_operator_is_registered():
    names = list(queries.QUERIES)
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)]
    assert set(queries.QUERIES) < set(__spark_entry__.queries()) and "pipeline" in __spark_entry__.queries()


def test_entry_without_this_package(tmp_path):
    """In a copy without this package, its tests and the pipeline the entry imports with the other queries; so it does where an import fails."""
    root = pathlib.Path(__spark_entry__.__file__).parent
    for name in ("ringfold", "__spark_entry__.py", "corpus_pipeline.py"):
        (shutil.copytree if (root / name).is_dir() else shutil.copy)(root / name, tmp_path / name)
    say = "import __spark_entry__ as e; q = e.queries(); print('flagship' in q, [n for n in q if n.startswith('op1') or n == 'pipeline'], set(e.oracle_sql()) <= set(q))"
    run = lambda before="": subprocess.run([sys.executable, "-c", before + say], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.strip()
    assert run() == "True ['op1_url_filter', 'op10_simhash_dedup', 'pipeline'] True"
    assert run("import sys; sys.modules['xxhash'] = None; ") == "True [] True"
    shutil.rmtree(tmp_path / "ringfold" / "llm")
    assert run() == "True [] True"
    (tmp_path / "corpus_pipeline.py").unlink()
    assert run() == "True [] True"


def test_pipeline_sends_small_batches(spark, sf):
    """Each stage's rows go to Python in batches of some MB, which an executor can hold for every task."""
    import pyarrow as pa

    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = {x: spark.conf.get(x) for x in names}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    try:
        for _, stage in corpus_pipeline.STAGES[2:]:
            for x in names:
                spark.conf.unset(x)
            stage(spark, docs, sf)
            sizes = [r["n"] for r in spark.range(5_000).coalesce(1).mapInArrow(lambda batches: (pa.record_batch([pa.array([b.num_rows])], ["n"]) for b in batches), "n long").collect()]
            assert sum(sizes) == 5_000 and max(sizes) <= 1_000
    finally:
        for x, v in before.items():
            spark.conf.set(x, v)
