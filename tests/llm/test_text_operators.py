"""Operators on documents against brute force, on edge cases and on the smallest tables."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from ringfold.llm import hmm_lm, kn_rules, mixing, quality_mil, sentencepiece_codec, shingle_join, simhash_dedup, substring_dedup, word_kn
from ringfold.llm.common import Words, windows, workspace

from .conftest import edge_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
words = lambda t: WORD.findall(t or "")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def everything(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def same(got, wanted):
    key = lambda x: tuple((v is None, v if v is not None else 0) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(wanted, key=key)


# SimHash


def brute_fingerprint(text, width=4):
    w = [x.encode().lower() for x in words(text)]
    shingles = [b" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, budget=4):
    """By id, from (id, fp) rows."""
    distinct = sorted(set(f for _, f in fps))
    array = np.array(distinct, np.uint64)
    label = np.arange(len(array))
    near = np.bitwise_count(array[:, None] ^ array[None, :]) <= budget
    while True:
        new = np.array([label[near[k]].min() for k in range(len(array))])
        if (new == label).all():
            break
        label = new
    of = dict(zip(distinct, label.tolist(), strict=True))
    least = {}
    for i, f in fps:
        if i is not None:
            least[of[f]] = min(least.get(of[f], i), i)
    return [(i, f, least.get(of[f])) for i, f in fps]


@pytest.mark.parametrize("which", ["edge", "docs"])
def test_simhash(request, which):
    frame = request.getfixturevalue(which)
    got = [(r["id"], r["fp"] % (1 << 64), r["component"]) for r in simhash_dedup.near_duplicates(frame).collect()]
    same(got, brute_components([(i, brute_fingerprint(t)) for i, t in everything(frame)]))


@pytest.mark.parametrize("limit", [32768, 4])
def test_trie_links_of_dense_groups(spark, limit):
    """Large groups are cut into pairs of subtries without losing a link."""
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    more = fps[rng.integers(0, 60, 200)]
    for _ in range(3):
        more = more ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))
    fps = np.unique(np.concatenate([fps, more, fps[:1] ^ np.arange(32, dtype=np.uint64)]))
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = {r["node"]: r["component"] for r in simhash_dedup.components(simhash_dedup.links(frame, 4, limit)).collect()}
    wanted = brute_components([(int(np.uint64(x).view(np.int64)), int(x)) for x in fps])
    assert {i: found.get(i, i) for i, _, _ in wanted} == {i: c for i, _, c in wanted}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 300)] + [(1000, 1001), (5, 5)], "a long, b long")
    found = {r["node"]: r["component"] for r in simhash_dedup.components(edges).collect()}
    assert found == {**{k: 0 for k in range(1, 301)}, 1001: 1000}


def test_components_gather_no_threads_on_the_driver(spark):
    threads = lambda: {t.getId() for t in spark._jvm.java.lang.Thread.getAllStackTraces().keySet() if t.getName().startswith("shuffle-exchange")}
    edges = spark.range(40).selectExpr("id AS a", "id + 1 AS b")
    before, adaptive = threads(), spark.conf.get("spark.sql.adaptive.enabled")
    assert simhash_dedup.components(edges).select("component").distinct().count() == 1
    assert len(threads() - before) < 8  # of the first step and of the count here
    assert spark.conf.get("spark.sql.adaptive.enabled") == adaptive


@pytest.mark.parametrize("a_task", [1 << 20, 40])
def test_components_of_links_in_one_task_or_many(spark, a_task):
    """Few links take a plan or two on the driver; where they are in many tasks, stars join what the tasks have left apart."""
    rng = random.Random(3)
    pairs = [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1100)] + [(7, 7)]
    smallest = {x: x for p in pairs for x in p}
    for _ in smallest:
        for a, b in pairs:
            smallest[a] = smallest[b] = min(smallest[a], smallest[b])
    jobs = lambda: {*spark.sparkContext.statusTracker().getJobIdsForGroup()}
    before = jobs()
    got = {r["node"]: r["component"] for r in simhash_dedup.components(spark.createDataFrame(pairs, "a long, b long").repartition(4), links_a_task=a_task).collect()}
    assert got == {x: c for x, c in smallest.items() if x != c}
    assert a_task == 40 or len(jobs() - before) < 9


def test_keep_one(edge, empty):
    """One row of each group: neither copies, nor repeated rows, nor copies without an id stay beside it."""
    kept = simhash_dedup.keep_one(edge)
    assert kept.columns == edge.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert ids.count(0) == 1 and 1 not in ids and 4 not in ids and ids.count(None) == 0 and ids.count(3) == 1
    assert simhash_dedup.keep_one(empty).count() == 0


def test_keep_one_judges_rows_not_ids(spark):
    rng = random.Random(4)
    a, b, c = (" ".join(f"w{rng.randrange(900)}" for _ in range(60)) for _ in range(3))
    frame = spark.createDataFrame([(7, a, 1), (7, b, 2), (3, b, 3), (None, c, 4), (None, c, 4), (9, a.upper(), 5), (7, a, 6)], "doc_id long, text string, `a.b` int")
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in simhash_dedup.keep_one(frame).collect())
    assert kept == sorted([(7, a), (3, b), (0, c)])


def test_hot_signatures_lose_no_pair(spark, monkeypatch):
    """Texts with a common line, in groups cut into pairs of signatures and tiles."""
    monkeypatch.setattr(shingle_join, "LARGE", 5)
    monkeypatch.setattr(shingle_join, "TILE", 4)
    rng = random.Random(6)
    say = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    line, texts = say(9), []
    for n in (4, 8, 20, 45) * 12:
        base = say(n)
        texts += [[*line, *base], [*line, *base[:-1], *say(1)]]
    frame = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    kept = {r["doc_id"] for r in simhash_dedup.keep_one(frame).collect()}
    assert kept == {k for k in range(len(texts)) if root[k] == k} and len(kept) < len(texts)


def test_sets_fingerprints():
    import pyarrow as pa

    texts = [t for _, t, *_ in edge_rows()]
    v, first = shingle_join.shingle_sets(pa.array(texts, pa.string()))
    got = shingle_join.fingerprints(v, first)
    for k in range(len(texts)):
        own = v[first[k] : first[k + 1]].tolist()
        assert int(got[k]) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in own) > len(own))


# Substring dedup


def brute_removal(rows, width=50):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - width + 1 if i is not None else 0):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - width + 1 if i is not None else 0):
            if first[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("which", ["edge", "docs"])
def test_substring_dedup(request, which, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(substring_dedup, "RANGE_WINDOWS", 3_000)
    frame = request.getfixturevalue(which)
    found = substring_dedup.repeated_windows(frame, digest=True).select("id", "n_words", "n_removed", "kept_sha256").collect()
    wanted = brute_removal(everything(frame))
    assert sum(w[2] for w in wanted) > 0
    same(found, wanted)


def test_clean_keeps_columns_and_untouched_texts(edge, empty):
    out = substring_dedup.clean(edge)
    assert out.columns == edge.columns and out.count() == edge.count()
    texts = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert (5, " \t\n\r\x0b\x0c ") in texts and (3, None) in texts and (16, "") in texts
    assert out.where("n_chars <> length(text)").count() == 0
    assert substring_dedup.clean(empty).count() == 0


def test_clean_of_dotted_columns_repeated_and_missing_ids(spark):
    text = " ".join(f"w{k}" for k in range(90))
    frame = spark.createDataFrame([(None, text, 1), (4, text, 2), (4, text, 3), (3, text, 4), (None, None, 5)], "doc_id long, text string, `a.b` int")
    out = substring_dedup.clean(frame)
    assert out.columns == frame.columns
    assert sorted((r["a.b"], len((r["text"] or "").split())) for r in out.collect()) == [(1, 90), (2, 0), (3, 0), (4, 90), (5, 0)]


def test_very_long_texts(spark):
    """Texts of over 5 MiB, beside short ones: alone in their chunk, whole in every count."""
    rng = np.random.default_rng(5)
    long = " ".join(f"x{n}" for n in rng.integers(0, 1 << 30, 520_000))
    assert len(long) > 5 << 20
    rows = [(1, long), (2, "a b " + long[-3000:]), (3, long + " end"), (4, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    n = len(long.split())
    shared = len(rows[1][1].split()) - 3  # the first word may be cut
    got = {r["id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.repeated_windows(frame, digest=True).collect()}
    assert got[1] == (n, 0) and got[3] == (n + 1, n) and shared <= got[2][1] <= shared + 1 and got[4] == (0, 0)
    assert {r["doc_id"] for r in simhash_dedup.keep_one(frame).collect()} == {1, 2, 4}
    assert {r["id"]: r["n_words"] for r in kn_rules.rules(frame.withColumn("lang", F.lit("en"))).collect()}[3] == n + 1
    scored = {r["id"]: (r["n_tokens"], r["score"]) for r in hmm_lm.likelihoods(frame).collect()}
    assert scored[3][0] == n + 2 and all(-math.inf < s < 0 for _, s in scored.values())
    out = sentencepiece_codec.decode(sentencepiece_codec.encode(frame)).collect()
    assert {r["doc_id"]: r["decoded"] for r in out} == dict(rows)
    assert {r["id"]: r["n_tokens"] for r in mixing.mix(frame.withColumn("source", F.lit("s"))).collect()}[1] == n


def test_spans_are_maximal(spark):
    long = " ".join(f"w{k}" for k in range(120))
    frame = spark.createDataFrame([(1, long), (2, "x " + long + " y")], "doc_id long, text string")
    row = substring_dedup.repeated_windows(frame).where("id = 2").first()
    assert [tuple(s) for s in row["spans"]] == [(1, 121)] and row["kept"] == "x y"


def test_packing():
    rng = np.random.default_rng(0)
    for n in (0, 1, 1000):
        x = np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        assert (substring_dedup.unpack(substring_dedup.pack(x)) == x).all()


def test_words_are_bytes_between_the_six_white_characters():
    import pyarrow as pa

    texts = [t for _, t, *_ in edge_rows()]
    w = Words(pa.array(texts, pa.string()).slice(1))
    own = [x.encode() for t in texts[1:] for x in words(t)]
    assert [w.data[a:b].tobytes() for a, b in zip(w.starts, w.ends, strict=True)] == own
    assert w.counts.tolist() == [len(words(t)) for t in texts[1:]]
    h = w.hashes()
    assert len(set(h.tolist())) == len(set(own)) and len({(x, y) for x, y in zip(h.tolist(), own, strict=True)}) == len(set(own))
    assert len(windows(h[:5], 8)) == 0


# Quality rules


def brute_rules(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    at = {}
    for k in range(len(w) - 7):
        at.setdefault(tuple(w[k : k + 8]), []).append(k)
    cover = {j for own in at.values() if len(own) > 1 for k in own for j in range(k, k + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)


@pytest.mark.parametrize("which", ["edge", "docs"])
def test_rule_counts(request, which):
    frame = request.getfixturevalue(which)
    found = kn_rules.rules(frame).collect()
    same([(r["id"], *(r[c] for c in kn_rules._COLUMNS[:5])) for r in found], [(i, *brute_rules(t)) for i, t in everything(frame)])
    for r in found:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["lower"] <= r["perplexity"] * (1 + 1e-12) and r["perplexity"] <= r["upper"] * (1 + 1e-12))


def test_kneser_ney_is_a_distribution(docs):
    model = kn_rules.train(docs)
    rng = np.random.default_rng(0)
    for context in [*rng.choice(model.grams[3] >> 6, 20), 0, 63 << 12 | 63 << 6 | 63]:
        assert abs(model.p(np.arange(64) + (int(context) << 6)).sum() - 1) < 1e-9


def test_kneser_ney_counts(edge):
    """Spark's counts are those of a dictionary."""
    grams = Counter()
    for _, t in everything(edge):
        line = [0, 0, 0, *kn_rules._SYMBOL[np.frombuffer((t or "").encode(), np.uint8)].tolist(), 1]
        grams.update(line[k] << 18 | line[k + 1] << 12 | line[k + 2] << 6 | line[k + 3] for k in range(len(line) - 3))
    assert {r["gram"]: r["n"] for r in kn_rules.count_grams(edge).collect()} == grams


def test_rules_reject_junk(docs, spark, sf):
    found = kn_rules.rules(docs).join(spark.read.parquet(f"{sf}/labels.parquet"), F.col("id") == F.col("doc_id"))
    rate = {r["quality"]: r["rate"] for r in found.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("rate")).collect()}
    assert rate[1] > 0.9 and rate[0] < 0.75


def test_rules_of_an_empty_table(empty):
    assert kn_rules.rules(empty).count() == 0


# Quality classifier


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    found = quality_mil.score(docs, quality_mil.train(docs, labels)).where(quality_mil.held_out(F.col("id")))
    rows = found.join(labels, F.col("id") == F.col("doc_id")).select("score", "quality").collect()
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.95
    assert np.mean([g >= 0.3 for g in good]) > 0.97 and np.mean([b < 0.3 for b in bad]) > 0.8


def test_classifier_edge_cases(edge, empty, spark):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(12)] + [(1, None, 0), (None, 1, 0), (2, 1, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality_mil.train(edge, labels)
    found = quality_mil.score(edge, model, carry=tuple(edge.columns))
    assert found.count() == edge.count() and found.where("not (score between 0 and 1)").count() == 0
    again = quality_mil.score(edge, quality_mil.train(edge, labels))
    key = lambda r: (r["id"] is None, r["id"] or 0, r["score"])
    assert sorted(map(key, again.collect())) == sorted(map(key, found.collect()))
    alone = quality_mil.train(edge, labels.where("quality = 1"))
    assert not alone.weights and quality_mil.score(edge, alone).where("score > 0.5").count() == edge.count()
    assert quality_mil.score(empty, quality_mil.train(empty, labels.limit(0))).count() == 0


def test_gradients():
    rng = np.random.default_rng(3)
    x, counts = rng.normal(size=(9, quality_mil.FEATURES)), np.array([2, 3, 4])
    label, weight = np.array([0.0, 1.0, 1.0]), np.array([1.0, 2.0, 0.5])
    model = quality_mil.Attention.fit(x.astype(np.float32), counts, label, weight, 0.6)

    def loss():
        y = model.forward(x, counts)["y"]
        return -(weight * (label * np.log(y) + (1 - label) * np.log(1 - y))).sum() / weight.sum()

    grad = model._gradient(x, counts, label, weight)
    for name, p in model.weights.items():
        at = tuple(0 for _ in p.shape)
        old = p[at]
        p[at] = old + 1e-5
        up = loss()
        p[at] = old - 1e-5
        down = loss()
        p[at] = old
        assert grad[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-8)


# Hidden Markov model


def test_base_scores(edge, docs, monkeypatch):
    monkeypatch.setattr(hmm_lm, "BLOCK_BYTES", 30_000)
    for frame in (edge, docs):
        rows = everything(frame)
        toks = lambda t: [x.encode().lower() for x in words(t)] + [None]
        learned = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 != 2
        c = Counter(w for i, t in rows if learned(i) for w in toks(t))
        n, v = sum(c.values()), len(c)
        found = hmm_lm.likelihoods(frame).collect()
        assert all(r["train_tokens"] == n for r in found)
        got = sorted((-1 if r["id"] is None else r["id"], r["n_tokens"], r["n_known"], r["base_score"]) for r in found)
        wanted = sorted((-1 if i is None else i, len(toks(t)), sum(c[w] > 0 for w in toks(t)), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks(t))) for i, t in rows)
        assert [x[:3] for x in got] == [x[:3] for x in wanted]
        assert [x[3] for x in got] == pytest.approx([x[3] for x in wanted], rel=1e-9)


def test_forward_recursion():
    model = hmm_lm.Hmm.random()
    rng = np.random.default_rng(0)
    counts = np.array([3, 1, 70, 3])
    classes = rng.integers(0, 256, counts.sum()).astype(np.uint8)
    at, wanted = 0, []
    for n in counts:
        a = model.start * model.emit[:, classes[at]]
        for k in classes[at + 1 : at + n]:
            a = (a @ model.move) * model.emit[:, k]
        wanted.append(math.log10(a.sum()))
        at += n
    assert model.log10_forward(classes, counts) == pytest.approx(wanted, rel=1e-9)


def brute_expected(model, sequences):
    """Counts of start, move and emit, and the log-likelihood, step by step."""
    start, move, emit, loglik = np.zeros(hmm_lm.STATES), np.zeros_like(model.move), np.zeros_like(model.emit), 0.0
    for x in sequences:
        alphas, scales = [], []
        for t, k in enumerate(x):
            a = (alphas[-1] @ model.move if t else model.start) * model.emit[:, k]
            scales.append(a.sum())
            alphas.append(a / a.sum())
        loglik += sum(map(math.log, scales))
        b = np.ones(hmm_lm.STATES)
        for t in range(len(x) - 1, -1, -1):
            gamma = alphas[t] * b
            emit[:, x[t]] += gamma / gamma.sum()
            if t == 0:
                start += gamma / gamma.sum()
            else:
                for i in range(hmm_lm.STATES):
                    move[i] += alphas[t - 1][i] * model.move[i] * model.emit[:, x[t]] * b / scales[t]
                b = model.move @ (model.emit[:, x[t]] * b) / scales[t]
    return start, move, emit, loglik


@pytest.mark.parametrize("held", [None, 1, 60, 500])
def test_baum_welch_against_brute_force(held):
    """Whole texts, also those over 48 tokens, in one piece or many."""
    model, rng = hmm_lm.Hmm.random(), np.random.default_rng(2)
    counts = np.array([3, 200, 1, 57, 130, 1, 49])
    classes = rng.integers(0, 256, counts.sum()).astype(np.uint8)
    wanted = brute_expected(model, np.split(classes, np.cumsum(counts)[:-1]))
    for got, w in zip(model.expected(classes, counts, held), wanted, strict=True):
        assert got == pytest.approx(w, rel=1e-9, abs=1e-12)
    for x in model.expected(classes[:0], counts[:0], held):
        assert np.all(np.asarray(x) == 0)


def test_baum_welch_never_loses_likelihood_and_beats_the_base(docs):
    blocks = hmm_lm.encode(docs)
    row = blocks.first()
    classes, counts = hmm_lm.sequences(row["train"], row["counts"], row["classes"])
    model, last = hmm_lm.Hmm.random(), -math.inf
    for _ in range(4):
        start, move, emit, loglik = model.expected(classes, counts)
        assert loglik > last
        last, model = loglik, hmm_lm.Hmm.of(start, move, emit)
    held = hmm_lm.score(blocks, hmm_lm.train(blocks)).where(~hmm_lm.trained(F.col("id")))
    total = held.agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert total["s"] > total["b"]


def test_forward_of_classes_hardly_ever_seen():
    """A class that training never saw, beside 1e10 of each other: the text stays possible."""
    emit = np.full((hmm_lm.STATES, 256), 1e10)
    emit[:, 9] = 0
    model = hmm_lm.Hmm.of(np.full(hmm_lm.STATES, 1e10), np.full((hmm_lm.STATES,) * 2, 1e10), emit)
    got = model.log10_forward(np.full(64, 9, np.uint8), np.array([64]))[0]
    assert got == pytest.approx(64 * math.log10(model.emit[0, 9]), rel=1e-9) and got < -700


def test_scores_follow_the_trained_model(docs, spark, monkeypatch):
    """The whole score of each text, step by step from the trained states and the counts of its words."""
    monkeypatch.setattr(hmm_lm, "BLOCK_BYTES", 60_000)
    blocks = hmm_lm.encode(docs)
    model = hmm_lm.train(blocks, steps=2)
    import pyarrow as pa

    rows = everything(docs)
    kind, counts = {}, Counter()
    for i, t in rows:
        w = Words(pa.array([t or ""]), lower=True)
        own = [w.data[a:b].tobytes() for a, b in zip(w.starts, w.ends, strict=True)]
        kind.update(zip(own, hmm_lm.word_classes(w).tolist(), strict=True))
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(own)
            counts[None] += 1
    kind[None] = hmm_lm.END_CLASS
    tokens, distinct = Counter(), Counter()
    for w, n in counts.items():
        tokens[kind[w]] += n
        distinct[kind[w]] += 1
    got = {r["id"]: r["score"] for r in hmm_lm.score(blocks, model).collect()}
    for i, t in rows[:40]:
        total, a = 0.0, None
        for x in [x.encode().lower() for x in words(t)] + [None]:
            k = kind[x]
            a = (model.start if a is None else a @ model.move) * model.emit[:, k]
            total += math.log10(a.sum()) + math.log10((counts[x] + 1) / (tokens[k] + distinct[k] + 1))
            a = a / a.sum()
        assert got[i] == pytest.approx(total, rel=1e-9)


def test_hmm_of_an_empty_table(empty):
    assert hmm_lm.likelihoods(empty).count() == 0


# Mixing


def test_mixing_meets_its_budgets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 50)
    rows = [(k, "big" if k % 3 else f"s{k % 7}", "w " * (1 + k % 11)) for k in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    found = mixing.mix(frame, target_entropy=0.999, max_epochs=3.0).collect()
    tokens, mixed, goes = Counter(), Counter(), {}
    for r in found:
        tokens[r["source"]] += r["n_tokens"]
        mixed[r["source"]] += r["n_tokens"] * r["copies"]
        goes[r["source"]] = r["epochs"]
        assert r["copies"] in (int(r["epochs"]), int(r["epochs"]) + 1)
    for s in tokens:
        assert 0 <= goes[s] * tokens[s] - mixed[s] + 0.5 and goes[s] * tokens[s] - mixed[s] <= 12
    assert min(goes.values()) == 1.0 and max(goes.values()) <= 3.0 + 1e-9


def test_mixing_cuts_where_brute_force_does(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 20)
    frame = spark.createDataFrame([(k, "ab"[k % 2], "w " * (k % 5)) for k in range(400)], "doc_id long, source string, text string")
    found = mixing.mix(frame, budget=300, target_entropy=None, max_epochs=None).collect()
    turn = {r["doc_id"]: r["t"] for r in frame.select("doc_id", F.shiftrightunsigned(F.xxhash64(F.lit(mixing.SEED), F.lit(0).cast("long"), "doc_id"), 2).alias("t")).collect()}
    for s in "ab":
        own = sorted((turn[r["id"]], r["n_tokens"], r["copies"]) for r in found if r["source"] == s)
        left = round(next(r["epochs"] for r in found if r["source"] == s) * sum(x[1] for x in own))
        for _, n, copies in own:
            left -= n
            assert copies == (left >= 0)


def brute_hash(seed, *values):
    """Spark's xxhash64 of a seed and integers or strings: each hash seeds the next."""
    h = 42
    for v in (seed, *values):
        raw = v.encode() if isinstance(v, str) else v
        h = xxhash.xxh64_intdigest(raw, h)
    return h


def test_schedule_against_brute_force(spark, monkeypatch):
    """Every copy in its block and place: epochs as permutations by hash, spread evenly, permuted in each block."""
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 40)
    monkeypatch.setattr(mixing, "TOKENS_A_PART", 100)
    rows = [(k, "a" if k % 4 else "bc"[k % 8 == 0], "w " * (1 + k % 7)) for k in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    tokens, size = Counter(), Counter()
    for _, s, t in rows:
        tokens[s] += len(t) // 2
        size[s] += 1
    w = mixing.weights(tokens, mixing.exponent(tokens, 0.97, 3.0))
    goes = mixing.epochs(tokens, w, None)
    int32, int64 = (lambda v: v.to_bytes(4, "little", signed=True)), (lambda v: v.to_bytes(8, "little", signed=True))
    turn = lambda e, i: brute_hash(int32(mixing.SEED), int64(e), int64(i)) >> 2
    copies, count = [], 0
    for s in tokens:
        whole = int(goes[s])
        rest = round(goes[s] % 1 * tokens[s])
        own = sorted((turn(whole, i), i, len(t) // 2) for i, o, t in rows if o == s)
        upto = np.cumsum([x[2] for x in own])
        last = own[int((upto <= rest).sum()) - 1][0] if rest < upto[-1] else 1 << 62
        count += whole * size[s] + rest / tokens[s] * size[s]
        for i, o, t in rows:
            if o == s:
                copies += [(i, s, e, (e + turn(e, i) / 2.0**62) / goes[s]) for e in range(whole)]
                if rest and turn(whole, i) <= last:
                    copies.append((i, s, whole, (whole + turn(whole, i) / (last + 1) * (goes[s] - whole)) / goes[s]))
    blocks = round(count / 40)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    order = sorted((min(int(part * blocks), blocks - 1), signed(brute_hash(int32(mixing.SEED), "block", int32(e), int64(i), s)), i, s, e) for i, s, e, part in copies)
    place, wanted = Counter(), []
    for block, _, i, s, e in order:
        wanted.append((i, s, e, block, place[block]))
        place[block] += 1
    found = mixing.schedule(frame, target_entropy=0.97, max_epochs=3.0).collect()
    assert sorted((r["id"], r["source"], r["epoch"], r["block"], r["place"]) for r in found) == sorted(wanted)
    for r in found:
        assert r["weight"] == pytest.approx(w[r["source"]]) and r["epochs"] == pytest.approx(goes[r["source"]])
    # Each block has the sources by their weights of documents, and the written rows lie in this order.
    share = {s: goes[s] * size[s] / count for s in tokens}
    for block in range(blocks):
        own = Counter(x[1] for x in wanted if x[3] == block)
        assert all(abs(own[s] - share[s] * 40) < 25 for s in share)
    written = [(r["doc_id"], r["source"]) for r in mixing.realise(frame, target_entropy=0.97, max_epochs=3.0).collect()]
    assert written == [x[:2] for x in sorted(wanted, key=lambda x: x[3:])]


def test_exponent():
    tokens = {"a": 900, "b": 60, "c": 40, "none": 0}
    some = {k: v for k, v in tokens.items() if v}
    t = mixing.exponent(tokens, 0.9, None)
    assert mixing.entropy(mixing.weights(some, t)) == pytest.approx(0.9 * math.log(3), abs=1e-9)
    t = mixing.exponent(tokens, 1.0, 2.0)
    assert max(mixing.epochs(some, mixing.weights(some, t), None).values()) == pytest.approx(2.0, rel=1e-6)
    assert mixing.exponent({"a": 5}, 0.9, 2.0) == 1.0 and mixing.exponent({}, 0.9, 2.0) == 1.0


def test_mixing_edge_cases(edge, empty):
    found = mixing.mix(edge)
    assert found.count() == edge.count() and found.where("copies < 1").count() == 0
    assert mixing.schedule(edge).count() == found.agg(F.sum("copies")).first()[0] and mixing.schedule(empty).count() == 0
    out = mixing.realise(edge)
    assert out.columns == edge.columns and out.count() == found.agg(F.sum("copies")).first()[0]
    assert mixing.mix(empty).count() == 0 and mixing.realise(empty).count() == 0


# SentencePiece


def test_codec_against_the_library(docs):
    model = sentencepiece_codec.default_model()
    ref = sentencepiece_codec.reference(model)
    found = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, verify_every=1)).collect()
    for r in found:
        assert r["ids"] == ref.encode(r["text"] or "") and r["decoded"] == (r["text"] or "").replace("▁", " ")


def test_codec_edge_cases(edge, empty):
    ref = sentencepiece_codec.reference(sentencepiece_codec.default_model())
    out = sentencepiece_codec.decode(sentencepiece_codec.encode(edge))
    assert out.columns == [*edge.columns, "ids", "decoded"]
    for r in out.collect():
        assert (r["ids"], r["decoded"]) == ((None, None) if r["text"] is None else (ref.encode(r["text"]), ref.decode(ref.encode(r["text"]))))
    assert sentencepiece_codec.encode(empty).count() == 0


def test_decoding_of_any_ids():
    model = sentencepiece_codec.default_model()
    tok = sentencepiece_codec.build(model)
    rng = np.random.default_rng(0)
    many = [rng.integers(0, 32_000, n).tolist() for n in range(60)] + [rng.integers(0, 300, 20).tolist() for _ in range(20)]
    assert sentencepiece_codec.decode_batch(model, many) == [tok.decode(x, skip_special_tokens=False) for x in many]


def test_wrong_ids_and_texts_are_errors(monkeypatch):
    model = sentencepiece_codec.default_model()
    codec = sentencepiece_codec._loaded(model, 2)
    ids, texts = sentencepiece_codec.round_trip(model, ["one two", "x"], verify_every=1)
    assert texts == ["one two", "x"] and ids == codec.ref.encode(["one two", "x"])
    with pytest.raises(ValueError, match="otherwise"):
        codec.verify(["one two"], [ids[0][:-1]], None, 1)
    with pytest.raises(ValueError, match="otherwise"):
        codec.verify(["one two"], [ids[0]], ["one tw"], 0)


def test_unigram_model_with_normaliser():
    """A hand-made unigram model with byte fallback and without a prefix; nothing is trained."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = proto.TrainerSpec.UNIGRAM, True
    m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces = True, True
    kinds = proto.ModelProto.SentencePiece
    pieces = [("<unk>", 0.0, kinds.UNKNOWN), ("<s>", 0.0, kinds.CONTROL), ("</s>", 0.0, kinds.CONTROL), *((f"<0x{b:02X}>", 0.0, kinds.BYTE) for b in range(256))]
    pieces += [(p, s, kinds.NORMAL) for p, s in [("▁the", -1.0), ("▁", -2.0), ("the", -2.5), ("▁t", -2.7), ("he", -2.8), ("t", -5.0), ("h", -5.1), ("e", -5.2), ("cat", -3.0), ("c", -6.0), ("a", -6.1)]]
    for p, s, k in pieces:
        m.pieces.add(piece=p, score=s, type=k)
    data = m.SerializeToString()
    tok, ref = sentencepiece_codec.build(data), sentencepiece_codec.reference(data)
    for text in ("the cat", "  the   the cat ", "tea hat", "", "the ß"):
        ids = tok.encode(text, add_special_tokens=False).ids
        assert ids == ref.encode(text) and tok.decode(ids, skip_special_tokens=False) == ref.decode(ids)


def test_workspace_is_the_shared_folder(spark):
    assert workspace(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


# The word model of the quality rules (F4)


def brute_word_kn(texts, spelled, halves, order=3):
    """log10 probabilities of texts, with dictionaries; counts of the other half."""
    lines = [["<s>"] * (order - 1) + words(t) + ["</s>"] for t in texts]
    models = []
    for f in (0, 1):
        a = {order: Counter(tuple(x[t - order + 1 : t + 1]) for x, h in zip(lines, halves, strict=True) if h == f for t in range(order - 1, len(x)))}
        for k in range(order - 1, 0, -1):
            a[k] = Counter(g[1:] for g in a[k + 1] if g[1] != "<s>")
            a[k].update(tuple(x[t - k + 1 : t + 1]) for x, h in zip(lines, halves, strict=True) if h == f for t in range(order - 1, len(x)) if x[t - k + 1] == "<s>")
        cuts = {k: word_kn.discounts([sum(c == i for c in a[k].values()) for i in range(1, 5)]) for k in a}
        totals, weights = {k: Counter() for k in a}, {k: Counter() for k in a}
        for k in a:
            for g, c in a[k].items():
                totals[k][g[:-1]] += c
                weights[k][g[:-1]] += cuts[k][min(c, 3)]
        models.append((a, cuts, totals, weights))

    def p(model, g):
        if not g:
            raise AssertionError
        a, cuts, totals, weights = model
        k = len(g)
        lower = p(model, g[1:]) if k > 1 else 10.0 ** spelled(g[0])
        total = totals[k][g[:-1]]
        if not total:
            return lower
        return (max(a[k][g] - cuts[k][min(a[k][g], 3)], 0) + weights[k][g[:-1]] * lower) / total

    return [sum(math.log10(p(models[1 - h], tuple(x[t - order + 1 : t + 1]))) for t in range(order - 1, len(x))) for x, h in zip(lines, halves, strict=True)]


@pytest.mark.parametrize("pieces", [False, True])
def test_word_model(spark, docs, monkeypatch, pieces):
    """Every text's probability is that of a plain Kneser-Ney model of word three-grams, also over many blocks and ranges."""
    if pieces:
        monkeypatch.setattr(word_kn, "BLOCK_WORDS", 2_000)
        monkeypatch.setattr(word_kn, "RANGE_KEYS", 3_000)
    odd = [(9_000_001, "en", None), (9_000_002, "en", ""), (9_000_003, None, "the the the the"), (9_000_004, "en", "Ünseen 😀 \n words")]
    frame = docs.select("doc_id", "lang", "text").limit(40).union(spark.createDataFrame(odd, "doc_id long, lang string, text string"))
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    frame = spark.createDataFrame([(i, "en", t) for i, t in rows], "doc_id long, lang string, text string").repartition(3)
    w = Words(pa.array([t for _, t in rows], pa.string()))
    halves = word_kn.halves(w, w.hashes()).tolist()
    assert 0 < sum(halves) < len(halves)
    model = kn_rules.train(frame)
    spelled = lambda x: float(np.float32(kn_rules.spelled(Words(pa.array(["" if x == "</s>" else x])), model)[0]))
    wanted = dict(zip((i for i, _ in rows), brute_word_kn([t for _, t in rows], spelled, halves), strict=True))
    found = {r["id"]: (r["log10_p"], r["n_grams"]) for r in kn_rules.rules(frame).collect()}
    assert found.keys() == wanted.keys()
    for i, t in rows:
        assert found[i][1] == len(words(t)) + 1 and abs(found[i][0] - wanted[i]) < 1e-6 * max(1, abs(wanted[i]))


def test_word_order_counts(spark):
    """Words of the same letters, and words in another order, which symbols can hardly tell apart, are judged by the words."""
    rng = random.Random(3)
    common = [f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)]
    say = lambda n: " ".join(" ".join(common[k : k + 5]) for k in (rng.randrange(55) for _ in range(n // 5)))
    rows = [(k, "en", say(60)) for k in range(300)]
    text = say(60)
    mixed = text.split()
    rng.shuffle(mixed)
    rows += [(1_000, "en", text), (1_001, "en", " ".join(mixed))]
    found = {r["id"]: r["perplexity"] for r in kn_rules.rules(spark.createDataFrame(rows, "doc_id long, lang string, text string")).collect()}
    assert found[1_001] > 4 * found[1_000]


def test_halves_of_chunks():
    """A text's half does not depend on the texts beside it; copies share it."""
    texts = [t for _, t, *_ in edge_rows()]
    w = Words(pa.array(texts, pa.string()))
    alone = [int(word_kn.halves(x := Words(pa.array([t], pa.string())), x.hashes())[0]) for t in texts]
    assert word_kn.halves(w, w.hashes()).tolist() == alone and alone[0] == alone[1]


def test_blocks_of_word_kn_are_packed(spark):
    """Numbers of hashes are those of np.unique, also if hashes differ in low bits only; counts come back; a dictionary takes under 8 bytes a word."""
    rng = np.random.default_rng(2)
    for keys in (rng.integers(0, 1 << 63, 5000, dtype=np.uint64), rng.integers(0, 40, 3000, dtype=np.uint64), np.array([5 << 40, (5 << 40) + 1, 5 << 40, (5 << 40) + 1, 7], np.uint64), np.zeros(0, np.uint64)):
        for got, wanted in zip(word_kn.numbered(keys), np.unique(keys, return_inverse=True), strict=True):
            assert got.tolist() == wanted.tolist()
    counts = [np.array([0, 254, 255, 256, 10**12]), np.array([255, 1, 0, 70_000, 3])]
    assert word_kn._counts(word_kn._small(counts), 2, 5).tolist() == np.stack(counts).tolist()
    frame = spark.createDataFrame([(1, "en", " ".join(f"w{k}" for k in range(30_000)))], "id long, lang string, text string")
    row = word_kn._blocks(frame, kn_rules._COLUMNS[:5], kn_rules.measures, lambda w: kn_rules.spelled(w, None)).first()
    assert len(row["spelled"]) == 4 * 30_001 and len(row["words"]) < 7.2 * 30_000


def test_records_of_word_kn_are_small():
    """Counts of two-grams take under 0.35 bytes each, also in pieces; all bits of words' hashes vary, so that those of n-grams do."""
    rng = np.random.default_rng(5)
    kinds = np.array([[1, 1, 0, 0, 0], [0, 1, 0, 0, 0], [1, 0, 1, 0, 0], [2, 2, 0, 0, 0], [0, 0, 0, 1, 3], [300, 254, 255, 256, 10**12]])
    rows = list(kinds[rng.choice(6, 20_000, p=[0.85, 0.06, 0.04, 0.03, 0.0199, 0.0001])].T.copy())
    edges = [0, 0, 7, 9_000, 20_000]
    assert len(word_kn._small(rows)) < 0.35 * 20_000
    pieces = [word_kn._counts(x, 5, b - a) for x, a, b in zip(word_kn._smalls(rows, edges), edges, edges[1:], strict=False)]
    assert np.concatenate(pieces, axis=1).tolist() == np.stack(rows).tolist()
    keys = np.sort(rng.integers(0, 1 << 52, 9_000, dtype=np.uint64))
    assert word_kn._unpacked(word_kn._packed(keys), 9_000).tolist() == keys.tolist()
    words = np.sort(rng.integers(0, 1 << 48, 500, dtype=np.uint64))
    block = word_kn._Block(np.array([500]).tobytes(), word_kn.pack(words), word_kn.squeezed(np.arange(500, dtype=np.uint32).view(np.uint8).reshape(-1, 4).T), 64)
    assert len(np.unique(block.words & np.uint64(0xFFFF))) > 450


def test_word_model_leaves_no_tables(spark, monkeypatch):
    """Blocks lie where they are when answers come to them, hold texts of one half, and go at the end with all answers; in intervals a block asks the same as in one."""
    monkeypatch.setattr(word_kn, "BLOCK_WORDS", 2_000)
    monkeypatch.setattr(word_kn, "RANGE_KEYS", 1_000)
    rng = random.Random(8)
    rows = [(k, "en", " ".join(f"w{rng.randrange(400)}" for _ in range(60))) for k in range(200)] + [(900, "en", "long " + "zq" * 3_000)]
    frame = spark.createDataFrame(rows, "id long, lang string, text string").repartition(2)
    made, shuffled = [], []
    monkeypatch.setattr(word_kn, "workspace", lambda s, name, f=word_kn.workspace: made.append(f(s, name)) or made[-1])
    hold = word_kn._hold
    monkeypatch.setattr(word_kn, "_hold", lambda asked, k, *a: shuffled.append((k, asked._jdf.queryExecution().executedPlan().toString().count("Exchange"))) or hold(asked, k, *a))
    found = word_kn.scored(frame, kn_rules._COLUMNS[:5], kn_rules.measures, lambda w: kn_rules.spelled(w, None))
    p = {r["id"]: r["log10_p"] for r in found.collect()}
    assert len(p) == 201 and all(math.isfinite(x) for x in p.values()) and p[900] < -3_000
    assert len(made) > 5 and not any(os.path.exists(x.removeprefix("file:")) for x in made)
    assert {k for k, _ in shuffled} == {1, 2, 3} and all(n <= (k < 3) for k, n in shuffled)
    blocks = word_kn._blocks(frame, kn_rules._COLUMNS[:5], kn_rules.measures, lambda w: kn_rules.spelled(w, None)).collect()
    assert {r["half"] for r in blocks} == {0, 1}
    block = word_kn._Block(blocks[0]["counts"], blocks[0]["words"], blocks[0]["tokens"], 48)
    above = np.ones((1, len(block.asked(3, None)[0])), np.int64)
    for k, answers in ((3, None), (2, above), (1, np.ones((1, len(block.asked(2, above)[0])), np.int64))):
        keys, counts = block.asked(k, answers)
        parts = [block.asked(k, answers, a, b) for a, b in ((0, 1 << 62), (1 << 62, 3 << 61), (3 << 61, 1 << 64))]
        assert np.concatenate([x for x, _ in parts]).tolist() == keys.tolist()
        assert np.concatenate([np.stack(c) for _, c in parts], axis=1).tolist() == np.stack(counts).tolist()
