"""The indexes against comparing and scoring everything, and what they leave unopened."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.operators import retrieval
from attesta.operators.text_index import TextIndex, best_by_scan
from attesta.operators.vector_index import VectorIndex

PAPERS, CLAIMS = "ref_id long, vector array<double>, year int", "claim_id string, vector array<double>"


def gathered(seed, n, dims=16, groups=12, spread=0.08):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    return [(i, (centres[i % groups] + rng.normal(size=dims) * spread).tolist(), 2000 + i % 30 if i % 7 else None) for i in range(n)]


def brute_nearest(claims, papers, k, min_year=None):
    out = {}
    for name, q in claims:
        near = []
        for ref, v, year in papers:
            if min_year is None or (year is not None and year >= min_year):
                cos = np.dot(np.array(q) / np.linalg.norm(q), np.array(v) / np.linalg.norm(v))
                near.append((-math.floor(cos * 1e9 + 0.5) / 1e9, ref))
        out[name] = [ref for _, ref in sorted(near)[:k]]
    return out


def ranked(df):
    out = {}
    for r in df.orderBy("claim_id", "vector_rank").collect():
        out.setdefault(r.claim_id, []).append(r.ref_id)
    return out


@pytest.mark.parametrize("min_year", [None, 2022])
def test_index_finds_the_nearest_and_skips_most_blocks(spark, min_year):
    rows = gathered(1, 3000)
    claims = [(f"c{i}", v) for i, v, _ in gathered(1, 3024)[3000:]]
    index = VectorIndex.build(spark.createDataFrame(rows, PAPERS).repartition(5), block=64)
    found, opened = index.nearest(spark.createDataFrame(claims, CLAIMS), 10, min_year)
    assert ranked(found) == brute_nearest(claims, rows, 10, min_year)
    assert opened.count() == opened.distinct().count() < 0.4 * len(claims) * index.blocks.count()


def test_index_grows_and_is_read_again(spark, tmp_path):
    rows = gathered(2, 600, spread=1.0)
    claims = [(f"c{i}", v) for i, v, _ in gathered(3, 6, spread=1.0)]
    index = VectorIndex.build(spark.createDataFrame(rows[:300], PAPERS), block=50).added(spark.createDataFrame(rows[300:], PAPERS), block=50)
    assert index.blocks.select("block_id").distinct().count() == index.blocks.count()
    index.write(str(tmp_path / "index"))
    again = VectorIndex.open(spark, str(tmp_path / "index"))
    assert ranked(again.nearest(spark.createDataFrame(claims, CLAIMS), 25)[0]) == brute_nearest(claims, rows, 25)


def test_one_direction_for_a_third_of_the_papers(spark):
    rows = [(i, [1.0, 1.0, 0.0], 2020) for i in range(500)] + [(500 + i, v, 2020) for i, v, _ in gathered(5, 1000, dims=3)]
    index = VectorIndex.build(spark.createDataFrame(rows, PAPERS).repartition(4), block=32)
    assert index.blocks.agg(F.max("n")).first()[0] <= 32
    claims = [("same", [2.0, 2.0, 0.0])]
    assert ranked(index.nearest(spark.createDataFrame(claims, CLAIMS), 600)[0]) == brute_nearest(claims, rows, 600)


ODD = [(900, None, 2020), (901, [0.0, 0.0], 2020), (902, [1.0], 2020), (903, [1.0, None], 2020), (904, [float("nan"), 1.0], 2020), (905, [1.0, 2.0, 3.0, 4.0], 2020), (906, [], 2020)]


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_vectors_of_other_lengths_and_none(spark, broadcast_bytes):
    rows = [(1, [1.0, 0.0], 2020), (2, [1.0, 1.0], 2020), (3, [0.0, 3.0], 2020), (3, [0.0, 3.0], 2020)]
    claims = [("a", [1.0, 0.1]), ("b", [0.1, 1.0]), ("odd", [1.0, 2.0, 3.0]), ("none", None), ("zero", [0.0, 0.0])]
    papers, asked = spark.createDataFrame(rows + ODD, PAPERS).repartition(3), spark.createDataFrame(claims, CLAIMS)
    got = ranked(retrieval.vector_topk(asked, papers, 3, broadcast_bytes=broadcast_bytes))
    assert got == {"a": [1, 2, 3], "b": [3, 3, 2]}
    assert retrieval.vector_topk(asked.where("false"), papers, 3, broadcast_bytes=broadcast_bytes).count() == 0
    assert retrieval.vector_topk(asked, papers.where("false"), 3, broadcast_bytes=broadcast_bytes).count() == 0


def test_scan_has_no_cartesian_product(spark):
    plan = retrieval.vector_topk(spark.createDataFrame([("a", [1.0, 0.0])], CLAIMS), spark.createDataFrame([(1, [1.0, 0.0], 2020)], PAPERS), 3)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" in plan


# ---- BM25 --------------------------------------------------------------------------------------


def brute_bm25(queries, corpus, k):
    n, average = len(corpus), sum(len(w or []) for _, w in corpus) / len(corpus)
    in_docs = Counter(t for _, w in corpus for t in set(w or []))
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in in_docs.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: 0.25 * mean if r < 0 else r for t, r in raw.items()}
    out = {}
    for name, words in queries:
        scores = []
        for ref, w in corpus:
            tf = Counter(w or [])
            if shared := [t for t in words if t in tf]:
                score = sum(idf[t] * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(w) / average)) for t in shared)
                scores.append((-math.floor(score * 1e6 + 0.5) / 1e6, ref))
        out[name] = [(r, ref, round(-s, 6)) for r, (s, ref) in enumerate(sorted(scores)[:k], 1)]
    return {name: rows for name, rows in out.items() if rows}


def texts(seed, n, vocabulary=400):
    rng = np.random.default_rng(seed)
    chance = 1 / np.arange(1, vocabulary + 1)
    draw = lambda: [f"w{t}" for t in rng.choice(vocabulary, rng.integers(3, 60), p=chance / chance.sum())]
    return [(i, None if i % 97 == 5 else [] if i % 97 == 6 else draw()) for i in range(n)]


def listed(df):
    out = {}
    for r in df.orderBy("claim_id", "bm25_rank").collect():
        out.setdefault(r.claim_id, []).append((r.bm25_rank, r.ref_id, round(r.bm25, 6)))
    return out


def test_best_documents_without_the_blocks_of_common_tokens(spark):
    corpus = texts(1, 1500)
    queries = [("rare", ["w390", "w0", "w1"]), ("common", ["w0", "w0", "w2"]), ("none", ["absent"]), ("mixed", ["w120", "w250", "w0", "w3", "w5"]), ("blank", [])]
    index = TextIndex.build(spark.createDataFrame(corpus, "ref_id long, words array<string>").repartition(4), block=16)
    found, opened = index.best(spark.createDataFrame(queries, "claim_id string, words array<string>"), 8)
    assert listed(found) == brute_bm25(queries, corpus, 8)
    assert index.postings.agg(F.max("n")).first()[0] <= 16
    blocks = lambda df, *where: df.where(F.col("token").isin(*where)).count()
    assert opened.count() == opened.distinct().count()
    # Of the list of w0 only its first blocks are opened for a query with a rare word.
    assert blocks(opened.where("claim_id = 'rare'"), "w0") < blocks(index.postings, "w0") / 4


def test_added_documents_change_the_statistics(spark):
    corpus = texts(2, 300)
    frame = lambda rows: spark.createDataFrame(rows, "ref_id long, words array<string>")
    index = TextIndex.build(frame(corpus[:200]), block=8).added(frame(corpus[200:]), block=8)
    queries = [(f"q{i}", w) for i, w in texts(3, 12) if w]
    assert listed(index.best(spark.createDataFrame(queries, "claim_id string, words array<string>"), 5)[0]) == brute_bm25(queries, corpus, 5)


@pytest.mark.parametrize("most_bytes", [1 << 20, 0])
def test_scan_finds_the_same(spark, most_bytes):
    corpus = texts(4, 700)
    queries = [(f"q{i}", w) for i, w in texts(5, 25) if w] + [("absent", ["nowhere"]), ("common", ["w0"] * 3), ("none", None)]
    found = best_by_scan(spark.createDataFrame(queries, "claim_id string, words array<string>"), spark.createDataFrame(corpus, "ref_id long, words array<string>").repartition(5), 6, most_bytes)
    assert listed(found) == brute_bm25([q for q in queries if q[1]], corpus, 6)


def test_index_of_nothing(spark):
    queries = spark.createDataFrame([("q", ["a"])], "claim_id string, words array<string>")
    assert TextIndex.build(spark.createDataFrame([], "ref_id long, words array<string>")).best(queries, 5)[0].count() == 0
    assert best_by_scan(queries, spark.createDataFrame([], "ref_id long, words array<string>"), 5).count() == 0
