"""The map of intervals against a map with a number for each character."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from attesta.functions.offsets import WHITE, intervals, normalized_with_map, source_offset, source_span
from attesta.operators.drafts import normalized_paragraph


def by_character(raw):
    """By definition: for each character that stays, where it stood."""
    kept, blank = [], False
    for i, c in enumerate(raw):
        if c == "\r":
            continue
        is_blank = c in " \t\xa0"
        if not (is_blank and blank):
            kept.append((" " if is_blank else c, i))
        blank = is_blank
    while kept and kept[0][0].isspace():
        kept.pop(0)
    while kept and kept[-1][0].isspace():
        kept.pop()
    return "".join(c for c, _ in kept), [i for _, i in kept]


CASES = ["", " ", "\xa0", "plain text", "  both  ends  ", "a\xa0\xa0\xa0b", "\r\na\rb\r\n", "tab\tand \t \r\xa0 mixed", "\n\n", "　wide ", "é\U0001f600  \U0001f600 x", "\x1cfile\x1f", "a \r b", "x" * 5000 + "  " * 300 + "y"]


def random_texts(n):
    rng = random.Random(4)
    return ["".join(rng.choice("ab  \t\xa0\r\n é\U0001f600") for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("texts", [CASES, random_texts(500)])
def test_intervals_are_those_of_every_character(texts):
    for raw in texts:
        text, runs = intervals(raw)
        expected, source = by_character(raw)
        assert text == expected
        assert [s + k for _, s, n in runs.tolist() for k in range(n)] == source
        assert sorted(set(source)) == source and [x for r in runs.tolist() for x in r[:1]] == sorted({r[0] for r in runs.tolist()})


def test_white_space_is_pythons():
    assert all(c.isspace() for c in WHITE) and not any(chr(c).isspace() and chr(c) not in WHITE for c in range(0x110000))


def test_every_offset_and_span_back(spark):
    rows = [(i, t) for i, t in enumerate(CASES[:-1] + random_texts(40))] + [(999, None)]
    mapped = spark.createDataFrame(rows, "id int, raw string").select("*", normalized_with_map("raw").alias("m"), normalized_paragraph(F.col("raw")).alias("plain"))
    n = F.char_length("m.normalized")
    at = F.transform(F.sequence(F.lit(-1), n), lambda i: source_offset(F.col("m.runs"), i))
    third = source_span(F.col("m.runs"), F.lit(1), n - 1)
    for r in mapped.select("*", at.alias("at"), third.alias("third"), source_span(F.col("m.runs"), F.lit(2), F.lit(2)).alias("none")).collect():
        if r.raw is None:
            assert r.m.normalized is None and r.at is None
            continue
        text, source = by_character(r.raw)
        assert r.m.normalized == r.plain == text
        assert r.at == [None, *source, None]
        assert r.none is None and (r.third and tuple(r.third)) == ((source[1], source[-2] + 1) if len(source) > 2 else None)
