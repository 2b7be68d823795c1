"""Look-ups against a client that goes through the papers one after the other."""

from __future__ import annotations

import random

import pytest

from attesta.operators.lookup import looked_up_in_order, numbered, prefetched

PAPERS = "position long, eid string, doi string, extra int"
ANSWERS = "view string, kind string, id string, status int, note string, abstract string, title string"


def in_order(papers, answers, probes=3):
    """A client with a memory."""
    held = {}
    for view, kind, i, status, note, abstract, title in answers:
        held[view, kind, i] = (status, note, abstract, title)
    view, bare, off, out = "full", 0, False, {}
    for position, eid, doi, _ in sorted(papers):
        out[position] = None
        if off or (view == "default" and bare >= probes):
            continue
        for kind, i in (("eid", eid), ("doi", doi)):
            if i is None:
                continue
            status, note, abstract, title = held.get((view, kind, i), (404, None, None, None))
            if status in (401, 403) and "AUTHORIZATION_ERROR" in (note or "") and view == "full":
                view = "default"
                status, note, abstract, title = held.get((view, kind, i), (404, None, None, None))
            if status in (401, 403):
                off = True
                break
            if status == 200:
                out[position] = (abstract, title, view)
                bare += view == "default" and not (abstract or "").strip()
                break
    return out


def got(spark, papers, answers):
    rows = looked_up_in_order(spark.createDataFrame(papers, PAPERS).repartition(4), spark.createDataFrame(answers, ANSWERS), ["eid", "doi"]).collect()
    assert len(rows) == len(papers) and all(r.extra == 7 for r in rows)
    return {r.position: r.answer and (r.answer.abstract, r.answer.title, r.asked_view) for r in rows}


def papers_of(n, rng):
    return [(i, f"e{i}" if rng.random() < 0.8 else None, f"d{i}" if rng.random() < 0.8 else None, 7) for i in range(n)]


@pytest.mark.parametrize("seed", range(6))
def test_random_providers(spark, seed):
    rng = random.Random(seed)
    papers, answers = papers_of(120, rng), []
    for i in range(120):
        for kind in ("eid", "doi"):
            bad = rng.random()
            note = rng.choice([None, "AUTHORIZATION_ERROR: view"]) if seed % 2 else "AUTHORIZATION_ERROR"
            status = 403 if bad < (0.02 if i > 20 else 0) else rng.choice([200, 200, 404, 500])
            answers.append(("full", kind, f"{kind[0]}{i}", status, note, rng.choice(["text", "", None]), f"t{i}"))
            if rng.random() < 0.9:
                answers.append(("default", kind, f"{kind[0]}{i}", rng.choice([200, 200, 404]) if rng.random() > 0.01 * (seed > 3) else 401, None, rng.choice(["text", "text", "text", " "]), f"u{i}"))
    assert got(spark, papers, answers) == in_order(papers, answers)


def test_the_third_answer_without_an_abstract_is_the_last(spark):
    papers = [(i, f"e{i}", None, 7) for i in range(20)]
    answers = [("full", "eid", "e5", 403, "X-AUTHORIZATION_ERROR", None, None)] + [("full", "eid", f"e{i}", 200, None, None, "full") for i in range(5)]
    answers += [("default", "eid", f"e{i}", 200, None, None if i % 2 else "text", "plain") for i in range(20)]
    out = got(spark, papers, answers)
    assert out == in_order(papers, answers) and [i for i, a in out.items() if a and a[2] == "default"] and max(i for i, a in out.items() if a) == 9


def test_repeated_and_missing_answers(spark):
    assert got(spark, [(1, "e1", "d1", 7), (2, None, None, 7)], []) == {1: None, 2: None}
    twice = [("full", "eid", "e1", 200, None, "a", "t")] * 2
    assert got(spark, [(1, "e1", "d1", 7), (2, "e1", None, 7)], twice) == {1: ("a", "t", "full"), 2: ("a", "t", "full")}


def test_numbers_are_those_of_the_order(spark):
    rows = list(range(1000))
    random.Random(1).shuffle(rows)
    out = numbered(spark.createDataFrame([(f"{i:04}",) for i in rows], "id string").repartition(7), "id").collect()
    assert {r.id: r.position for r in out} == {f"{i:04}": i for i in rows}


@pytest.mark.parametrize("seed", range(4))
def test_batches_end_with_a_long_block(spark, seed):
    rng = random.Random(seed)
    papers = [(i, None, None if rng.random() < 0.1 else f"10.{rng.randrange(300):03}", 7) for i in range(400)]
    answers = [(f"10.{i:03}", rng.choice([60.0, 500.0]) if rng.random() < 0.01 else None, rng.random() < 0.01, f"t{i}") for i in range(0, 300, 2)]
    ids = sorted({p[2] for p in papers if p[2]})
    of, expected = {a[0]: a for a in answers}, {}
    for at in range(0, len(ids), 20):
        chunk = [of.get(i, (i, None, False, None)) for i in ids[at : at + 20]]
        waits = [w for _, w, _, _ in chunk if w is not None]
        if waits and max(waits) > 120:
            break
        if not waits and not any(f for _, _, f, _ in chunk):
            expected |= {i: t for i, _, _, t in chunk}
    out = prefetched(spark.createDataFrame(papers, PAPERS), spark.createDataFrame(answers, "doi string, retry_after double, failed boolean, title string"), group=20).collect()
    assert {r.doi: r.answer and r.answer.title for r in out} == expected
