"""Vectors against all pairs; models against held-out labels; the pipeline against brute force, stage by stage."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from attesta.llm import components, embeddings, quality, toxicity

from .test_texts import DOCS, LONG, brute_components, brute_hits, brute_lines, prose


# ---- vectors -------------------------------------------------------------------------------


def brute_vectors(rows, threshold=0.95):
    ok = [i for i, (_, v) in enumerate(rows) if v and None not in v and all(np.isfinite(v)) and any(v)]
    links = {i: [j for j in ok if j != i and len(rows[i][1]) == len(rows[j][1]) and np.dot(rows[i][1], rows[j][1]) / np.linalg.norm(rows[i][1]) / np.linalg.norm(rows[j][1]) >= threshold] for i in ok}
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            new = set(links.get(todo.pop(), ())) - seen
            seen |= new
            todo += new
        out.append((len(links.get(i, ())), min(rows[j][0] for j in seen)))
    return out


@pytest.mark.parametrize("tile", [2048, 16])
def test_links_are_those_of_all_pairs(spark, tile):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(12, 40))
    rows = [(k, list(map(float, centers[k % 12] + rng.normal(size=40) * (0.15 + 0.05 * (k % 4))))) for k in range(240)]
    rows += [(300 + k, rows[5][1]) for k in range(30)] + [(400, [2 * x for x in rows[6][1]]), (401, [-x for x in rows[6][1]])]
    bad = [None, [], [0.0] * 40, [float("nan")] + [1.0] * 39, [float("inf")] + [1.0] * 39, [None] + [1.0] * 39]
    rows += [(500 + k, v) for k, v in enumerate(bad)] + [(600, [1.0, 2.0]), (601, [1.0, 2.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("kept", F.lit("clash"))
    out = {r.vec_id: r for r in embeddings.near_vectors(df, tile=tile).collect()}
    for (i, _), expected in zip(rows, brute_vectors(rows), strict=True):
        assert (out[i].n_links, out[i].component_id) == expected and out[i].kept == (expected[1] == i), i


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in embeddings.near_vectors(df).select("n_links", "component_id", "kept").collect()] == [(0, 1, True)]
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (500, 501), (500, 501)]
    out = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    groups = {}
    for node, root in out.items():
        groups.setdefault(root, set()).add(node)
    assert sorted(map(sorted, groups.values())) == [list(range(61)), list(range(100, 140)), [500, 501]]
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- models --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark):
    """Every fifth document has insults in it; every seventh is shouted junk."""
    docs, labels = [], []
    for i in range(900):
        w = prose(i, 60).split()
        if i % 5 == 0:
            w[10:50:7] = ["vermin", "dimwit", "numbskull", "vermin", "dimwit", "numbskull"]
        if i % 7 == 0:
            w = [x.upper() + "%%%" for x in w]
        docs.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, int(i % 7 != 0), int(i % 5 == 0)))
    docs += [(1000, None, None, None, None), (1001, "", "", "", 0), (1002, LONG * 20, "en", "s", 0), (1003, "?!", "en", "s", 2)]
    return spark.createDataFrame(docs, DOCS).repartition(4).cache(), spark.createDataFrame([*labels, (2000, 1, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def is_held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_toxic_documents_score_high(spark, labelled):
    docs, labels = labelled
    scored = {r.doc_id: r.toxicity for r in toxicity.with_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect()}
    assert all(0 <= s <= 1 for s in scored.values()) and scored[1000] == scored[1001] < 0.7 and scored[1002] < 0.7
    held = [i for i in range(900) if is_held_out(i)]
    assert np.mean([(scored[i] >= 0.7) == (i % 5 == 0) for i in held]) > 0.95
    flags = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == is_held_out(r.doc_id) for r in flags)


def test_toxicity_without_labels_or_documents(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit_toxicity(docs, labels.limit(0))
    assert {round(r.toxicity, 6) for r in toxicity.with_toxicity(docs, model).select("toxicity").distinct().collect()} == {0.5}
    empty = docs.limit(0)
    assert toxicity.with_toxicity(empty, toxicity.fit_toxicity(empty, labels)).count() == 0


def brute_shared(texts):
    """Probability of a run's last byte after the others, with the continuation counts of all texts."""
    padded = [b" " * 4 + t.lower().encode() for t in texts if t]
    kinds = {5: {t[i - 4 : i + 1] for t in padded for i in range(4, len(t))}}
    for k in (4, 3, 2, 1):
        kinds[k] = {g[1:] for g in kinds[k + 1]}
    before = {k: Counter(g[1:] for g in kinds[k + 1]) for k in (1, 2, 3, 4)}
    whole = {k: Counter() for k in before}
    after = {k: Counter(g[:-1] for g in kinds[k]) for k in before}
    for k, counts in before.items():
        for g, n in counts.items():
            whole[k][g[:-1]] += n

    def p(g):
        k = len(g)
        return 1 / 256 if not k else (before[k][g] - 0.75 + 0.75 * after[k][g[:-1]] * p(g[1:])) / whole[k][g[:-1]]

    return p


@pytest.mark.parametrize("held", [1 << 20, 50])
def test_shared_model_counts_all_documents(spark, monkeypatch, held):
    """Contexts and bytes that the labelled sample lacks count too."""
    monkeypatch.setattr(toxicity, "HELD_GRAMS", held, raising=False)
    texts = [" ".join(prose(i, 12).split() + ["vermin"] * (i % 2)) for i in range(40)]
    others = [None, "", "x", "\u017eermin \u01c6ermin Germin %ermin 5vermin", "the qvermin #vermin", "\u00e9t\u00e9 \u65e5\u672c\u8a9e vermin"]
    docs = spark.createDataFrame(list(enumerate(texts + others)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    tuned = {r.doc_id for r in docs.where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(4)) == 0).select("doc_id").collect()}
    shared, counts = brute_shared(texts + others), ({}, {})
    for i, t in enumerate(texts):
        padded = b"   " + t.lower().encode()
        for j in range(3, len(padded)) if i not in tuned and not is_held_out(i) else ():
            of = counts[i % 2].setdefault(padded[j - 3 : j], Counter())
            of[padded[j]] += 1
    assert all(counts)
    for context in set(counts[0]) | set(counts[1]):
        for byte in range(256):
            p = []
            for seen in counts:
                of = seen.get(context)
                back = shared(context + bytes([byte])) if any(byte in s.get(context, ()) for s in counts) else 1.0
                p.append(back if of is None else (max(of[byte] - 0.75, 0) + 0.75 * len(of) * back) / of.total())
            row, code = model.cells(np.frombuffer(context + bytes([byte]), np.uint8))
            assert abs(model.llr[row[3], code[3]] - np.log(p[1] / p[0])) < 1e-4, (context, byte)


def test_quality_grades_are_told_apart(spark, labelled):
    docs, labels = labelled
    ratings = labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2).alias("grade"))
    model = quality.fit_quality(docs, ratings)
    assert (np.diff(model.thresholds) > 0).all() and model.grades.tolist() == [0, 1, 2]
    out = {r.doc_id: r for r in quality.with_quality(docs.withColumn("kept", F.lit("clash")), model, 1).collect()}
    held = [i for i in range(900) if is_held_out(i)]
    assert np.mean([out[i].kept == (i % 7 != 0) for i in held]) > 0.95
    mean = lambda xs: np.mean([out[i].expected_grade for i in xs])
    assert mean(i for i in held if i % 7 == 0) < mean(i for i in held if i % 5 == 0 and i % 7) < mean(i for i in held if i % 5 and i % 7)
    none = quality.fit_quality(docs, ratings.limit(0))
    assert {r.kept for r in quality.with_quality(docs, none, 1).select("kept").distinct().collect()} == {False}


def test_ordinal_gradient_fits_a_known_model():
    rng = np.random.default_rng(0)
    n, x = 4000, None
    x = rng.integers(0, 2, (n, 3))
    latent = x @ np.array([2.0, -1.0, 0.5]) + rng.logistic(size=n)
    grade = (latent > 0).astype(int) + (latent > 1.5)
    row, feature = np.nonzero(x)
    weights, thresholds = quality.fit_ordinal(row, feature, np.ones(len(row)), grade, 3, np.ones(n), epochs=400, decay=0)
    assert np.allclose(weights[:3], [2.0, -1.0, 0.5], atol=0.25) and np.allclose(thresholds, [0, 1.5], atol=0.25)


# ---- pipeline ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    item = prose(5000, 30)
    texts = [None, "", "short"] + [prose(i, 80) for i in range(40)]
    texts += [" ".join([*prose(i, 80).split()[:-1], "edited"]) for i in range(10)]
    texts += [f"{prose(700 + i, 30)}\nA common line\n{prose(800 + i, 30)}" for i in range(12)]
    texts += [f"{prose(900 + i, 60)} {item} {prose(950 + i, 20)}" for i in range(3)] + [item]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, texts


def test_stages_do_what_brute_force_does(spark, corpus):
    path, texts = corpus
    held = dict(enumerate(texts))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        ids = sorted(held)
        if k == 1:
            kept = brute_lines([held[i] for i in ids], 10)
            held = {i: t if held[i] is not None else None for i, t in zip(ids, kept, strict=True)}
        elif k == 2:
            roots = brute_components([held[i] for i in ids], 5, 80)
            held = {i: held[i] for at, (i, (_, root)) in enumerate(zip(ids, roots, strict=True)) if root == at}
        elif k == 3:
            hits = brute_hits([held[i] for i in ids], [(1, prose(5000, 30))])
            held = {i: re.sub(re.escape(prose(5000, 30)), "", held[i] or "") if h else held[i] for i, (n, h, _) in zip(ids, hits, strict=True) if h <= n / 2}
        docs = stage(spark, docs, path)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = corpus_pipeline.staged(docs, "test")
        rows = docs.collect()
        assert {r.doc_id: r.text for r in rows} == held and len(rows) == len(held)
        assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)
    packed = corpus_pipeline.STAGES[4][1](spark, docs, path).collect()
    assert {r.doc_id: r.n_tokens for r in packed} == {i: len((t or "").split()) + 1 for i, t in held.items()}
    assert len(corpus_pipeline.run(spark, path).collect()) == len(packed)


def test_pipeline_of_nothing(spark, corpus, tmp_path):
    path, _ = corpus
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{path}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
