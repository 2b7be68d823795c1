"""Operators on texts against brute force: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.llm import decontaminate, jaccard, linededup, packing, pii, sharding, suffixdedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore".split()


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(f"{WORDS[i]}{j}" for i, j in zip(rng.integers(0, len(WORDS), n), rng.integers(0, 50, n), strict=True))


def frame(spark, texts, ids=None):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


LONG = prose(1, 5000)
TEXTS = [None, "", " \n\t ", "Same text here", "Same text here", LONG, LONG + " tail", "é" * 500, "a\nb\n\nc", prose(2, 200), prose(2, 200).upper(), "x"]


# ---- suffix dedup -----------------------------------------------------------------------


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(np.frombuffer(b, np.uint8)[~gone].tobytes())
    return out


@pytest.mark.parametrize("q", [2, 3, 5, 7, 11, 13, 17])
def test_every_difference_is_covered_once(q):
    v, cover = suffixdedup.difference_cover(q)
    assert Counter((a - b) % v for a in cover for b in cover if a != b) == Counter(range(1, v))


@pytest.mark.parametrize("length", [400, 50, 10])
def test_repeated_bytes_go(spark, length):
    rng = np.random.default_rng(length)
    passage, other = prose(7, 150), prose(8, 150)
    texts = [*TEXTS, prose(3, 90) + passage + prose(4, 20), passage + prose(5, 33), prose(6, 10) + passage[:410], other[:399] + "1", other[:399] + "2", "ab" * 700, passage[5:420]]
    texts += ["".join(rng.choice(list("ab"), 700))]
    out = {r.doc_id: r for r in suffixdedup.remove_repeats(frame(spark, texts), length).collect()}
    for i, kept in enumerate(brute_repeats(texts, length)):
        assert bytes(out[i].kept) == kept and out[i].n_removed == len((texts[i] or "").encode()) - len(kept), i


def test_repeats_beyond_the_broadcast_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "BROADCAST_IDS", 0)
    texts = [LONG, LONG[100:900], None, "short", "short"]
    df = frame(spark, texts, [1, 2, 3, None, None]).withColumn("kept", F.lit("clash"))
    out = suffixdedup.remove_repeats(df).collect()
    assert sorted(len(r.kept) for r in out) == sorted(len(x) for x in brute_repeats(texts, 400)) and len(out) == 5
    assert suffixdedup.remove_repeats(frame(spark, [])).count() == 0


def test_shorter_passages_that_repeat_have_windows_and_no_column_clashes(spark):
    passages = [prose(400 + k, 42) for k in range(8)]
    texts = [prose(500 + k, 60) + passages[k % 8] + prose(600 + k, 60) for k in range(16)] + [prose(700 + k, 300) for k in range(8)]
    assert all(250 < len(p) < 400 for p in passages)
    df = frame(spark, texts)
    for name in ("_key", "_pos", "pos", "run", "doc_key", "_told", "n_windows"):
        df = df.withColumn(name, F.lit("own"))
    out = {r.doc_id: r for r in suffixdedup.remove_repeats(df).collect()}
    assert sum(out[k].n_windows > 0 for k in range(16)) >= 14 and all(out[k].n_windows == 0 for k in range(16, 24))
    assert all(r["_key"] == r["pos"] == r["_told"] == "own" and r.n_removed == 0 for r in out.values())


# ---- benchmark decontamination -----------------------------------------------------------


def brute_hits(texts, items, k=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for n in [min(k, len(w))] if w else []:
            for a in range(len(w) - n + 1):
                windows[tuple(w[a : a + n])].add(i)
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if (g := tuple(w[a : a + n])) in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[g]
        out.append((len(w), len(hit), sorted(str(x) for x in found)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_hits_are_those_of_all_windows(spark, block_bytes):
    item = prose(11, 40)
    items = [(1, item), (2, "Tiny, item!"), (3, None), (4, "..."), (5, item), (6, "one"), (7, prose(12, 10)), (8, prose(12, 10) + " more")]
    texts = [*TEXTS, "x " + item.upper() + " y", " ".join(item.split()[3:14]), " ".join(item.split()[:9]), "a TINY item b tiny; item", "One and only one", prose(12, 10), item + " " + item]
    table = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.match_items(frame(spark, texts), table, block_bytes=block_bytes).collect()
    expected = brute_hits(texts, items)
    for r in out:
        runs = r.match.runs
        assert (r.match.n_words, sum(b - a for a, b in zip(runs[::2], runs[1::2], strict=True)), r.match.items) == expected[r.doc_id], texts[r.doc_id]


def test_spans_are_cut_and_covered_documents_go(spark):
    item, around = prose(11, 30), prose(13, 200)
    texts = [around + " " + item + " " + around, item, None, around]
    df = frame(spark, texts).withColumn("match", F.lit(1))
    out = {r.doc_id: r.text for r in decontaminate.decontaminate(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert out == {0: around + "  " + around, 2: None, 3: around}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(frame(spark, texts), none).count() == 4
    assert decontaminate.decontaminate(frame(spark, []), none).count() == 0


def test_decontamination_runs_python_once_a_document(spark, capsys):
    """Each Python operator that a task runs besides is one more worker in an executor's memory, and stays there."""
    around, items = prose(13, 200), [prose(11, 30), prose(12, 30)]
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [around + " " + items[0] + " é " + items[1] + " " + around, items[1], None, around, ""]
    for block_bytes in (1, 1 << 20):
        out = decontaminate.decontaminate(frame(spark, texts), table, block_bytes=block_bytes)
        capsys.readouterr()
        out.explain()
        plan = capsys.readouterr().out
        assert plan.count("ArrowEvalPython") == 1, plan
        assert {r.doc_id: r.text for r in out.collect()} == {0: around + "  é  " + around, 2: None, 3: around, 4: ""}


# ---- Jaccard join ------------------------------------------------------------------------


def brute_components(texts, width, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("width", "percent"), [(5, 80), (4, 85), (3, 50)])
def test_components_are_those_of_all_pairs(spark, width, percent):
    rng = np.random.default_rng(3)
    texts = [*TEXTS, "two words", "two words", "TWO words"]
    base = [prose(100 + k, 120).split() for k in range(4)]
    for k in range(60):
        w = list(base[k % 4])
        for at in rng.integers(0, len(w), int(rng.integers(0, 9))):
            w[at] = f"edit{k}_{at}"
        texts.append(" ".join(w))
    shared = prose(200, 30)
    texts += [shared + " " + prose(300 + k, 40) for k in range(20)]
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(frame(spark, texts), width, percent).collect()}
    assert [out[i] for i in range(len(texts))] == brute_components(texts, width, percent)


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80), (2, 50)])
def test_a_large_group_of_copies_is_told_by_its_differences(spark, width, percent):
    """Copies of one text with many or few edits, some of them common to several copies, and a second group half like the first."""
    rng = np.random.default_rng(width)
    base = prose(31, 80).split()
    other = base[:40] + prose(32, 40).split()
    common = [list(rng.integers(0, 80, 9)) for _ in range(4)]
    texts = []
    for k in range(90):
        words = list(base if k % 3 else other)
        for at in list(rng.integers(0, 80, int(rng.integers(0, 9)))) + (common[k % 4] if k % 5 < 2 else []):
            if rng.random() < 0.3:
                words[at] = ""
            else:
                words[at] = f"edit{at}" if rng.random() < 0.6 else f"own{k}x{at}"
        texts.append(" ".join(w for w in words if w))
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(frame(spark, texts), width, percent).collect()}
    assert [out[i] for i in range(len(texts))] == brute_components(texts, width, percent)
    assert 1 < len({c for _, c in out.values()}) < len(texts)


def test_one_of_each_group_stays(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    t = prose(1, 50)
    df = frame(spark, [t, t, t, None, "", prose(2, 50), t, prose(3, 40)], [5, 3, 3, 8, 9, None, None, 1]).withColumn("component_id", F.lit("clash"))
    kept = jaccard.one_of_each(jaccard.jaccard_groups(df))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "8", "9", "None"]
    assert jaccard.jaccard_groups(frame(spark, [])).count() == 0


# ---- personal data -----------------------------------------------------------------------

BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda d: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
}


def digits(m):
    return re.sub("[^0-9]", "", m)


def luhn(s):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(s))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def test_base_spans_are_those_of_the_patterns(spark):
    texts = [
        *TEXTS, "mail a.b@c.de and x@y, p@q.r_s@t.u @v.w a@b..c é x@y.z", "ip 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 00255.0.0.1 1.2.3",
        "card 4111 1111 1111 1111 and 4111-1111-1111-1112 9  4111111111111111", "call +1 (252) 555-8630 or +49 30 1234567-89, +1 2", "9" * 3000 + " " + "a." * 3000 + "@",
        "\U0001f600 x@y.zz \U0001f600 1.1.1.1", "12345678901234567890 1-1-1", "+1 1.1.1.1 1.1.1.1",
    ]
    out = pii.find_pii(frame(spark, texts).withColumn("base", F.lit(1)), pii.PiiModel()).collect()
    for r in out:
        t = texts[r.doc_id] or ""
        expected = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(BASE.values()) for m in re.finditer(p, t) if ok(m[0]))
        assert [(s.start, s.kind, s.end) for s in r.base] == expected, t[:80]
        assert [(s.start, s.kind, s.end) for s in r.spans] == expected


def test_trees_find_planted_forms_that_the_patterns_miss(spark):
    """Recall and precision over phones without a plus, spelled addresses and tokens without a key word, none of them labelled."""
    phone = lambda k: f"({200 + k % 700}) 555-{1000 + k:04d}"
    token = lambda k: hashlib.sha1(str(k).encode()).hexdigest()
    texts = [f"{prose(k, 9)} call +1 {phone(k)} or key: {token(k)} or me.{k}@mail{k % 9}.example.com {prose(k, 3)}" for k in range(150)]
    plain = [f"{prose(k, 9)} item 20{k:06d} and plain-hyphenated-word-{k} for 3 @ 4 each {prose(k, 3)}" for k in range(150)]
    planted = [f"{prose(k, 9)} 1 {phone(k)} then {token(9000 + k)} then you.{k} [at] mail.example.org {prose(k, 3)}" for k in range(10)]
    docs = frame(spark, texts + plain + planted)
    out = {r.doc_id: r for r in pii.find_pii(docs, pii.fit_pii(docs)).collect()}
    added = {i: {pii.KINDS[s.kind] for s in set(r.spans) - set(r.base)} for i, r in out.items()}
    for kind in ("number", "token", "contact"):
        assert sum(kind in added[i] for i in range(300, 310)) >= 9, kind
        assert sum(kind in added[i] for i in range(150, 300)) == 0, kind


def test_spans_of_repeated_rows_long_texts_and_empty_tables(spark):
    long = "word " * 200_000 + "a@b.cc"
    out = pii.find_pii(frame(spark, ["x@y.zz", "x@y.zz", long, "", None]), pii.PiiModel()).orderBy("doc_id").collect()
    assert [[(s.start, s.end) for s in r.spans] for r in out] == [[(0, 6)], [(0, 6)], [(1_000_000, 1_000_006)], [], []]
    assert pii.find_pii(frame(spark, []), pii.PiiModel()).count() == 0


def test_trees_add_what_looks_like_the_labelled_spans(spark):
    rng = np.random.default_rng(0)
    secret = lambda k: hashlib.sha1(str(k).encode()).hexdigest()
    texts = [f"{prose(k, 20)} token = {secret(k)} {prose(k + 1, 5)}" for k in range(120)]
    texts += [f"{prose(k, 20)} {'long-hyphenated-compound-word-2'} {prose(k, 3)}" for k in range(120)]
    texts += [f"we saw {secret(10**6 + k)}" for k in range(3)] + [prose(int(rng.integers(99)), 30)]
    docs = frame(spark, texts)
    model = pii.fit_pii(docs)
    out = {r.doc_id: r for r in pii.find_pii(docs, model).collect()}
    hit = lambda r: any(s.kind == pii.KINDS.index("token") for s in r.spans)
    assert all(hit(out[i]) for i in range(120)) and not any(hit(out[i]) for i in range(120, 240))
    assert pii.redact(frame(spark, ["mail a@b.cc now", None]), pii.PiiModel()).orderBy("doc_id").collect()[0].text == "mail [email] now"
    assert pii.fit_pii(frame(spark, [])).thresholds == {}


# ---- packing and sharding ----------------------------------------------------------------


def test_bins_hold_everything_once(spark):
    lengths = [None, 0, 1, 5000, 20000, *range(1, 400), *[512] * 30]
    docs = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n long").withColumn("bin_id", F.lit("clash"))
    rows = packing.pack(docs, F.col("n"), group_tokens=30000).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.n_tokens))
        bins[r.bin_id].append(r)
    for i, n in enumerate(lengths):
        at = 0
        for start, k in sorted(pieces[i]):
            assert start == at and k <= 8192
            at += k
        assert at == max(1, n or 0)
    for members in bins.values():
        at = 0
        for r in sorted(members, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.n_tokens
        assert at == members[0].bin_used and members[0].bin_capacity == min(c for c in packing.CAPACITIES if c >= at)
    filled = sum(max(1, n or 0) for n in lengths) / sum(m[0].bin_capacity for m in bins.values())
    assert filled > 0.9
    assert packing.pack(docs.limit(0), F.col("n")).count() == 0


def test_the_cheapest_bin_opens():
    bins = packing.VariableBins((10, 100), to_come=8)
    assert bins.put(8) == (0, 0) and bins.opened == [10]
    bins = packing.VariableBins((10, 100), to_come=60)
    assert bins.put(50) == (0, 0) and bins.put(7) == (0, 50) and list(bins.downsized()) == [100]


def test_shards_are_contiguous_and_even(spark):
    ids = [*range(300), 5, 5, 5, None, None]
    texts = ["t" * (i * 7 % 50) if i is not None and i % 11 else None for i in ids]
    df = frame(spark, texts, ids).withColumns({"shard": F.lit(-1), "size": F.length(F.coalesce("text", F.lit(""))) + 1})
    rows = sharding.balanced_shards(df, [F.col("doc_id")], F.col("size"), 8).collect()
    assert len(rows) == len(ids)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    sizes = [sum(r.size for r in m) for m in by.values()]
    assert max(sizes) - min(sizes) <= 102
    last = -1
    for s in sorted(by):
        got = sorted(by[s], key=lambda r: r.slot)
        assert [r.slot for r in got] == list(range(len(got)))
        keys = [-1 if r.doc_id is None else r.doc_id for r in got]
        assert keys == sorted(keys) and keys[0] >= last
        last = keys[-1]
    assert sharding.balanced_shards(df.limit(0), [F.col("doc_id")], F.col("size"), 8).count() == 0


# ---- line dedup ---------------------------------------------------------------------------


def brute_lines(texts, least):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    counts = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    return ["\n".join(x for x in (t or "").split("\n") if not key(x) or counts[key(x)] < least) for t in texts]


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_common_lines_go(spark, broadcast_bytes):
    texts = [*TEXTS, *[f"{prose(k, 5)}\n COMMON line\t\n\ncommon LINE\nrare {k % 7}" for k in range(25)], "Common line"]
    df = frame(spark, texts).withColumns({"lines": F.lit(1), "n_lines": F.lit("x")})
    out = {r.doc_id: r for r in linededup.dedup_lines(df, 4, broadcast_bytes=broadcast_bytes).collect()}
    for i, kept in enumerate(brute_lines(texts, 4)):
        assert out[i].kept_text == kept and out[i].n_lines == len((texts[i] or "").split("\n"))
    assert linededup.dedup_lines(frame(spark, [])).count() == 0


def test_counts_and_filters_can_be_undone(spark):
    first, second = frame(spark, ["a\nb", "a\nc", "a"]), frame(spark, ["b\nb", "b", "d"])
    rows = lambda df: sorted(map(tuple, df.collect()))
    before = linededup.line_counts(first).cache()
    after = linededup.changed_counts(before, added=second).cache()
    assert rows(after) == rows(linededup.line_counts(first.unionByName(second)))
    assert rows(linededup.changed_counts(after, removed=second)) == rows(before)
    filters = linededup.filters_of(before, 3, 2)
    forward = linededup.changed_filters(filters, before, after, 3, 2)

    def holds(fs, counts, least):
        shards = {r.shard: linededup.CuckooFilter(r.buckets, np.frombuffer(r.slots, np.uint16)) for r in fs.collect()}
        return {r.k1 for r in counts.collect() if (f := shards.get(r.k2 % 2)) is not None and f.contains(np.array([r.k1]))[0]} == {r.k1 for r in counts.collect() if r.docs >= least}

    assert holds(filters, before, 3) and holds(forward, after, 3)
    assert holds(linededup.changed_filters(forward, after, before, 3, 2), before, 3)


def test_cuckoo_filter_holds_inserts_and_deletes():
    keys = np.random.default_rng(1).integers(-(2**62), 2**62, 5000)
    f = linededup.CuckooFilter.of(keys)
    assert f.contains(keys).all()
    assert f.contains(keys + 1).mean() < 0.01
    assert all(f.delete(int(k)) for k in keys[:2500])
    assert f.contains(keys[2500:]).all() and f.contains(keys[:2500]).mean() < 0.01
