"""Phrases with wildcards against one regular expression for each part."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from attesta.functions.phrases import PhraseMatcher, parts_of, pattern
from attesta.operators import sdg


def brute(phrases, text):
    return [i for i, p in enumerate(phrases) if all(re.search(pattern(part), text or "", re.IGNORECASE) for part in parts_of(p))]


FIXED = ["vaccin*", "fertili?er", "marine and coral bleaching", "a*b*c", "*", "?", "??x", "x?*?y", "**ab**", "A And B", "water  and  quality and x", ".+(", "a\\", "end?", "*start", "a?b*b?c", ""]
TEXTS = ["Vaccination", "FERTILIZER and fertiliser", "coral bleaching here.\nElsewhere marine", "a\nb c", "a b c", "a--b--c", "x12y", "xy", "", None, "1x", "x\nyy", ".+( a\\", "end", "ends", "a1b b2c", "a1b2c", "a1b b\nc", "A And B", "waterquality x"]


@pytest.mark.parametrize("phrases", [FIXED, ["only"], []])
def test_wildcards_and_groups(phrases):
    matcher = PhraseMatcher(tuple(phrases))
    for text in TEXTS:
        assert matcher.found(text) == brute(phrases, text), text


def test_random_phrases_and_texts():
    rng = random.Random(8)
    piece = lambda: "".join(rng.choice("aab bc?*") for _ in range(rng.randint(1, 6)))
    for _ in range(300):
        phrases = [" and ".join(piece() for _ in range(rng.choice([1, 1, 1, 2, 3]))) for _ in range(20)]
        matcher = PhraseMatcher(tuple(phrases))
        for _ in range(10):
            text = "".join(rng.choice("aabbcC \n") for _ in range(rng.randint(0, 25)))
            assert matcher.found(text) == brute(phrases, text), (phrases, text)


def test_a_json_list_with_thousands_of_phrases(spark, tmp_path):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(2, 5)))
    goals = [{"number": 18 - n, "name": f"Goal {18 - n}", "keywords": [rng.choice([f"{word()} {word()}", word() + "*", f"{word()} and {word()}", f"{word()[:1]}?{word()}"]) for _ in range(250)]} for n in range(1, 18)]
    (tmp_path / "goals.json").write_text(json.dumps(goals, indent=1))
    read = sdg.goals_from_json(spark, str(tmp_path / "goals.json"))
    assert [g for g, _, _ in read] == list(range(1, 18)) and all(len(p) == 250 for _, _, p in read)
    texts = [(i, " ".join(word() for _ in range(40)) if i else " ") for i in range(60)]
    got = {(r.text_id, r.goal): (r.hits, r.phrases) for r in sdg.matched_goals(spark.createDataFrame(texts, "text_id long, text string").repartition(3), top=17, most=1000, goals=read).collect()}
    expected = {}
    for i, text in texts:
        for g, _, phrases in read:
            if hit := [phrases[k] for k in brute(phrases, text)]:
                expected[i, g] = (len(hit), sorted(hit, key=lambda p: (-len(p), p)))
    assert got == expected and len(got) > 100


def test_a_list_that_is_too_long_is_an_error(spark, tmp_path, monkeypatch):
    (tmp_path / "goals.json").write_text('[{"number": 1, "name": "x", "keywords": ["abc"]}]')
    monkeypatch.setattr(sdg, "MOST_LIST_BYTES", 3)
    with pytest.raises(ValueError, match="characters"):
        sdg.goals_from_json(spark, str(tmp_path / "goals.json"))


def test_the_plan_does_not_grow_with_the_list(spark):
    texts = spark.createDataFrame([(1, "abc 12")], "text_id long, text string")
    plan = lambda n: len(sdg.matched_goals(texts, goals=((1, "g", tuple(f"abc {i}" for i in range(n))),))._jdf.queryExecution().toString())
    assert plan(5000) < plan(5) + 200


def test_blank_and_null_texts(spark):
    texts = spark.createDataFrame([(1, None), (2, " "), (3, "vaccination")], "text_id long, text string")
    assert [r.text_id for r in sdg.matched_goals(texts).collect()] == [3]
    assert sdg.with_candidates(texts).select("text_id", F.size("candidates").alias("n")).collect() == [(3, 17)]
