"""Runs of words against all periods of all stretches, and Lyndon edges against sorted suffixes."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from attesta.llm.runs import lyndon_edges, op12_periodic_runs, with_runs, word_runs


def brute_runs(words, periods=4, least=6):
    n, out = len(words), []
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            part = words[i : i + length]
            smaller = any(all(part[x] == part[x + d] for x in range(length - d)) for d in range(1, q))
            if length >= max(least, periods * q) and not smaller:
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_edges(s):
    smaller, matched = [], []
    for i in range(len(s)):
        j = next((j for j in range(i + 1, len(s)) if s[j:] < s[i:]), len(s))
        k = 0
        while j + k < len(s) and s[i + k] == s[j + k]:
            k += 1
        smaller.append(j)
        matched.append(k)
    return smaller, matched


def repeats(rng, n, letters):
    out = []
    while len(out) < n:
        out += [rng.randrange(letters) for _ in range(rng.randint(1, 6))] * rng.randint(1, 6)
        if rng.random() < 0.3:
            out += out[: rng.randint(1, len(out))]
    return out


def test_edges_and_runs_of_many_short_sequences():
    rng = random.Random(3)
    for _ in range(4000):
        n, letters = rng.randint(0, 40), rng.randint(1, 4)
        s = [rng.randrange(letters) for _ in range(n)] if rng.random() < 0.5 else repeats(rng, n, letters)
        assert lyndon_edges(s) == brute_edges(s)
        assert word_runs(s) == brute_runs(s)
        assert word_runs(s, 2, 2) == brute_runs(s, 2, 2)


class Counting(list):
    reads = 0

    def __getitem__(self, i):
        Counting.reads += 1
        return list.__getitem__(self, i)


@pytest.mark.parametrize("kind", ["one letter", "fibonacci", "squares of squares", "random"])
def test_symbols_are_read_a_fixed_number_of_times(kind):
    a, b, double = [1], [1, 2], [1, 2]
    while len(b) < 6000:
        a, b = b, b + a
    while len(double) < 6000:
        double = double + double + [3 - double[-1]]
    rng = random.Random(5)
    s = {"one letter": [1] * 6000, "fibonacci": b, "squares of squares": double, "random": [rng.randrange(2) for _ in range(6000)]}[kind]
    Counting.reads = 0
    lyndon_edges(Counting(s))
    assert Counting.reads < 10 * len(s)


def brute_collapsed(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = brute_runs(words)
    gone = {x for start, length, q in runs for x in range(start + q, start + length)}
    return runs, " ".join(w for i, w in enumerate(words) if i not in gone)


def test_texts_of_every_kind(spark):
    rng = random.Random(9)
    texts = [None, "", " \t\n", "a", "x " * 500, "a b " * 3, "a\x0bb\x0ca\rb a b a b", "a b\x1c " * 7, "é 世 " * 9 + "end", ("word " * 40_000) + "z y " * 30]
    texts += [" ".join("abcdefg"[c] for c in repeats(rng, rng.randint(0, 40), rng.randint(1, 6))) for _ in range(300)]
    rows = [Row(id=i, text=t, starts="kept", runs="clash", _p=i) for i, t in enumerate(texts * 2)]
    got = {r.id: r for r in with_runs(spark.createDataFrame(rows, "id long, text string, starts string, runs string, _p int").repartition(3)).collect()}
    assert len(got) == len(rows)
    for row in rows:
        if row.text and len(row.text) > 100_000:
            assert [tuple(r) for r in got[row.id].runs] == [(0, 40_000, 1), (40_000, 60, 2)]
            continue
        runs, collapsed = brute_collapsed(row.text)
        assert [tuple(r) for r in got[row.id].runs] == runs and got[row.id].collapsed == collapsed
        assert got[row.id].starts == "kept" and got[row.id]._p == row.id


def test_no_rows(spark):
    assert with_runs(spark.createDataFrame([], "id long, text string")).count() == 0


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(2)
    docs = [Row(doc_id=i, text=None if i == 7 else " ".join(rng.choice("abcdefghij") * 2 for _ in range(rng.randint(0, 60)))) for i in range(400)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: tuple(r)[1:] for r in op12_periodic_runs(spark, str(tmp_path)).collect()}
    repeated = 0
    for d in docs:
        words = (d.text or "").split()
        h, n = zlib.crc32(str(d.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs, collapsed = brute_collapsed(" ".join(words))
        repeated += bool(runs)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        of_best = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got[d.doc_id] == (len(runs), *of_best, digest("".join(f"{a},{b},{c}\n" for a, b, c in runs)), digest(collapsed))
    assert repeated > 5


def test_planted_periods_are_found(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        p, times = rng.randint(1, 30), rng.randint(4, 9)
        unit = [f"u{i}x{k}" for k in range(p)]
        size = max(6, p * times + rng.randrange(p))
        rows.append((i, " ".join([f"before{i}"] * (i % 2) + [unit[k % p] for k in range(size)] + ["after"]), i % 2, size, p))
    got = with_runs(spark.createDataFrame(rows, "id long, text string, s long, l long, p long")).select("*", F.get("runs", F.lit(0)).alias("r")).collect()
    assert all((r.r.start, r.r.length, r.r.period) == (r.s, r.l, r.p) and len(r.runs) == 1 for r in got)
