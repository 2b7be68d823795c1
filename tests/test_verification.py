"""Verification: what is asked, what isn't, and what a call's failures leave."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from attesta.operators.models import AnswerError, decided
from attesta.operators.verification import NO_ABSTRACT, UNAVAILABLE, answer, checked, verified
from attesta.plans import recommend, retrieval_queries

ROWS = "claim_id long, claim_hash string, claim_text string, claim_context string, ref_id string, place int, title string, abstract string, keywords array<string>, extra int"
CACHE = "claim_hash string, ref_id string, verdict string, evidence string, limitations string, recommended_usage string"


def row(claim, ref, place, abstract="text", text="claim"):
    return (claim, f"h{claim}", f"{text} {claim}", "", ref, place, "T", abstract, None, 7)


def outcomes(out):
    return {(r.claim_id, r.ref_id): (r.verdict, r.from_cache) for r in out.outcomes.collect()}


def test_one_call_for_the_pending_ones_of_a_claim(spark):
    def ask(claim, context, candidates, fault):
        names = ",".join(c["abstract"] for c in candidates)
        return [{"idx": i, "verdict": "SUPPORTED", "evidence": f"{claim}: {names}"} for i in range(len(candidates))]

    rows = [row(1, "a", 1, "A"), row(1, "b", 2, "B"), row(1, "c", 3, " "), row(1, "d", 4, None), row(1, "e", 5, "E"), row(1, "f", 6, "F"), row(1, "g", 7, "G"), row(2, "a", 1, "A")]
    cache = spark.createDataFrame([("h1", "b", "CONTRADICTED", "known", "", ""), ("h9", "a", "SUPPORTED", "", "", "")], CACHE)
    out = verified(spark.createDataFrame(rows, ROWS).repartition(4), cache, ask)
    assert outcomes(out) == {(1, "a"): ("SUPPORTED", False), (1, "b"): ("CONTRADICTED", True), (1, "c"): ("INSUFFICIENT_EVIDENCE", False), (1, "d"): ("INSUFFICIENT_EVIDENCE", False),
        (1, "e"): ("SUPPORTED", False), (1, "f"): ("SUPPORTED", False), (1, "g"): ("SUPPORTED", False), (2, "a"): ("SUPPORTED", False)}
    told = {(r.claim_hash, r.ref_id): r.evidence for r in out.entries.collect()}
    assert told == {("h1", "a"): "claim 1: A,E,F", ("h1", "e"): "claim 1: A,E,F", ("h1", "f"): "claim 1: A,E,F", ("h1", "g"): "claim 1: G", ("h2", "a"): "claim 2: A"}
    kept = out.outcomes.where("ref_id = 'c'").first()
    assert (kept.evidence, kept.limitations, kept.recommended_usage) == NO_ABSTRACT and kept.extra == 7 and kept.support_score == 0.15


def test_failures_are_skipped_and_not_kept(spark):
    def ask(claim, context, candidates, fault):
        if claim.endswith("1"):
            raise RuntimeError("down")
        return [{"idx": 0, "verdict": "SUPPORTED"}, {"idx": 5, "verdict": "SUPPORTED"}]

    out = verified(spark.createDataFrame([row(1, "a", 1), row(2, "a", 1), row(2, "b", 2)], ROWS), spark.createDataFrame([], CACHE), ask)
    assert outcomes(out) == {(1, "a"): ("SKIPPED", False), (2, "a"): ("SUPPORTED", False), (2, "b"): ("SKIPPED", False)}
    assert [(r.claim_hash, r.ref_id) for r in out.entries.collect()] == [("h2", "a")]
    skipped = out.outcomes.where("claim_id = 1").first()
    assert (skipped.evidence, skipped.limitations, skipped.recommended_usage) == UNAVAILABLE and skipped.support_score == 0.0


def test_two_claims_of_one_text_make_one_entry(spark):
    rows = [row(1, "a", 1), (2, "h1", "claim 1", "", "a", 1, "T", "text", None, 7)]
    out = verified(spark.createDataFrame(rows, ROWS), spark.createDataFrame([], CACHE), lambda *_: [{"idx": 0, "verdict": "SUPPORTED"}])
    assert out.outcomes.count() == 2 and out.entries.count() == 1


def test_nothing_to_verify(spark):
    out = verified(spark.createDataFrame([], ROWS), spark.createDataFrame([], CACHE), lambda *_: [])
    assert out.outcomes.count() == out.entries.count() == 0


@pytest.mark.parametrize("wrong", [None, {}, [1], [{"verdict": "SUPPORTED"}], [{"idx": True, "verdict": "SUPPORTED"}], [{"idx": 0, "verdict": "YES"}], [{"idx": 0, "verdict": "SUPPORTED", "evidence": 5}]])
def test_answers_of_another_form_are_asked_again_once(wrong):
    with pytest.raises(AnswerError):
        checked(wrong)
    faults = []

    def ask(claim, context, candidates, fault):
        faults.append(fault)
        return wrong if fault is None else [{"idx": 0, "verdict": "SUPPORTED"}]

    assert answer(ask, "c", "", [{}])[0]["verdict"] == "SUPPORTED" and faults[0] is None and faults[1]
    calls = []
    assert answer(lambda *a: calls.append(a) or wrong, "c", "", [{}, {}]) == [None, None] and len(calls) == 2
    assert answer(lambda *a: wrong, "c", "", [{}], lambda *a: [{"idx": 0, "verdict": "CONTRADICTED"}])[0]["verdict"] == "CONTRADICTED"


def test_recommendations_with_calls_and_a_cache(spark):
    data = "/root/testdata/sf0.001"
    c = F.col("claim_id")
    claims = retrieval_queries.claims(spark, data).where("claim_id < 12").select(
        "claim_id", F.lit(1).alias("draft_id"), F.lit(True).alias("needs_citation"), F.lit(0.5).alias("confidence"), c.alias("char_start"), F.col("query").alias("claim_text"), F.lit(None).cast("string").alias("local_context"), "vector"
    )
    ask = lambda claim, context, candidates, fault: [{"idx": i, "verdict": "SUPPORTED"} for i in range(len(candidates))]
    papers = retrieval_queries.papers(spark, data)
    first, entries = recommend.recommend_drafts(claims, papers, verified=3, ask=ask, cache=spark.createDataFrame([], CACHE.replace("ref_id string", "ref_id long")))
    assert first.count() == entries.count() == 9 and first.where("verdict = 'SUPPORTED' and not from_cache").count() == 9
    again, more = recommend.recommend_drafts(claims, papers, verified=3, ask=lambda *_: 1 / 0, cache=entries)
    assert more.count() == 0 and again.where("from_cache").count() == 9
    told = lambda df: sorted(tuple(r) for r in df.select("claim_id", "ref_id", "rank", "percentage", "label").collect())
    assert told(first) == told(again)


def decision_form(told):
    if not isinstance(told, list) or any(type(x.get("idx")) is not int or "type" not in x for x in told):
        raise AnswerError("idx and type are needed")
    return told


def test_decisions_are_numbered_in_their_batch(spark):
    def ask(given, fault):
        if fault is None and any(g["k"] == "k03" for g in given):
            return [{"idx": "0"}]
        return [{"idx": i, "type": f"{g['k']}!"} for i, g in enumerate(given) if g["k"] != "k05"] + [{"idx": 400, "type": "stray"}, {"idx": -1, "type": "stray"}]

    rows = spark.createDataFrame([(f"k{i:02}", i) for i in range(12)] + [("k01", 1)], "k string, extra int").coalesce(1)
    cache = spark.createDataFrame([("k00", "held"), ("k99", "other")], "k string, type string")
    out = decided(rows, cache, ["k"], ask, decision_form, "type string", size=4).required()
    told = {r.k: r.type for r in out.answers.collect()}
    assert told == {"k00": "held"} | {f"k{i:02}": f"k{i:02}!" for i in range(1, 12) if i != 5}
    assert out.entries.count() == 10 and out.failures.count() == 0


def test_a_batch_that_fails_fails_the_stage_but_not_the_others(spark):
    def ask(given, fault):
        if any(g["k"] == "k1" for g in given):
            raise TimeoutError("no answer")
        return [{"idx": i, "type": "t"} for i in range(len(given))]

    rows, none = spark.createDataFrame([("k1",), ("k2",), ("k3",)], "k string").coalesce(1), spark.createDataFrame([], "k string, type string")
    out = decided(rows, none, ["k"], ask, decision_form, "type string", size=1)
    assert {r.k for r in out.entries.collect()} == {"k2", "k3"} and [tuple(r) for r in out.failures.collect()] == [("k1", "TimeoutError: no answer")]
    with pytest.raises(RuntimeError, match="1 rows have no decision: TimeoutError"):
        out.required()
    again = decided(rows, out.entries, ["k"], lambda given, fault: [{"idx": i, "type": g["k"]} for i, g in enumerate(given)], decision_form, "type string").required()
    assert [r.k for r in again.entries.collect()] == ["k1"] and again.answers.count() == 3
    backed = decided(rows, none, ["k"], ask, decision_form, "type string", size=1, fallback=lambda given, fault: [{"idx": 0, "type": "other"}]).required()
    assert {r.k: r.type for r in backed.answers.collect()} == {"k1": "other", "k2": "t", "k3": "t"}
