"""Key phrases by their definition."""

from __future__ import annotations

import math
import re
from collections import defaultdict

from pyspark.sql import functions as F

from attesta.operators.keyphrases import CUTTING, candidate_phrases, key_phrases, with_keywords

TEXTS = [
    (1, "Compatibility of systems of linear constraints over the set of natural numbers, and linear constraints."),
    (2, "Deep residual networks improve image recognition; deep networks (2016) are hard to train."),
    (3, "The of and, 12.5 ... a"),
    (4, None),
    (5, ""),
    (6, "Résumé für Übungen und Übungen — état de l'art. x yz abc"),
    (7, "image recognition image recognition, image recognition"),
    (8, " ".join(f"word{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10]}," for i in range(40))),
]


def cut(text):
    parts, run = [], []
    for t in [*re.findall(r"[^\W\d_]+|(?:[^\w\s]|[\d_])+", (text or "").lower()), "."]:
        if t[0].isalpha() and t not in CUTTING:
            run.append(t)
        elif run:
            parts.append(" ".join(run))
            run = []
    return [p for p in parts if len(p) >= 3]


def test_candidates(spark):
    rows = spark.createDataFrame(TEXTS, "id int, text string").select("id", candidate_phrases(F.col("text")).alias("p")).collect()
    assert {r.id: r.p for r in rows} == {i: cut(t) for i, t in TEXTS}
    assert {r.id: r.p for r in rows}[1] == ["compatibility", "systems", "linear constraints over", "set", "natural numbers", "linear constraints"]


def test_best_phrases_by_degree_and_frequency(spark):
    degree, times = defaultdict(int), defaultdict(int)
    for _, text in TEXTS:
        for p in cut(text):
            for w in p.split():
                degree[w] += len(p.split())
                times[w] += 1
    expected = {}
    for i, text in TEXTS:
        phrases = list(dict.fromkeys(cut(text)))
        score = lambda p: math.floor(sum(degree[w] / times[w] for w in p.split()) * 1e6 + 0.5) / 1e6
        if phrases:
            expected[i] = sorted(phrases, key=lambda p: -score(p))[:12]
    got = {r.id: r.phrases for r in key_phrases(spark.createDataFrame(TEXTS, "id int, text string").repartition(3), "id", "text").collect()}
    assert got == expected and len(got[8]) == 12 and got[7] == ["image recognition image recognition", "image recognition"]


def test_claims_without_phrases_have_no_keywords(spark):
    claims = spark.createDataFrame([(1, "Linear constraints, natural numbers."), (2, "the of"), (3, None)], "claim_id int, query string")
    assert {r.claim_id: sorted(r.keywords) for r in with_keywords(claims).collect()} == {1: ["constraints", "linear", "natural", "numbers"], 2: [], 3: []}
