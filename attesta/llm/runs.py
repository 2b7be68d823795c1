"""Periodic runs of words, by Lyndon arrays with reuse of extensions that matched before."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, give_back, small_batches, table

#: A run has this many periods at least, and this many words.
PERIODS, WORDS = 4, 6
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def lyndon_edges(s: list[int]) -> tuple[list[int], list[int]]:
    """next_smaller, matched: by position the start of the next smaller suffix (the end of the longest Lyndon word that
    starts there; len(s) for none), and how many symbols the two suffixes have in common.

    One pass from the left keeps the chain of previous smaller suffixes. The suffix at i is compared along the chain; as
    the extensions of the chain's links are kept, each comparison but one is settled by two of them. That one scans, and
    only beyond the furthest position matched so far: before it, the text is a copy of text that was compared already (from
    ``copied`` on, ``shift`` before), and so are the extensions. What is scanned is never scanned again, so the pass is linear.
    """
    n = len(s)
    smaller, matched = [n] * n, [0] * n
    before, common = [-1] * n, [0] * n  # previous smaller suffix, and symbols in common with it
    copied = shift = reach = 0  # s[copied:reach] == s[copied - shift:reach - shift]
    for i in range(1, n):
        at, known = i - 1, 0
        while at >= 0:
            # ``known`` symbols from i on agree with s[at:]. Is there more to find in the copy?
            if at >= copied and i < reach:
                twin, twin_at = i - shift, at - shift
                agreed = matched[twin_at] if smaller[twin_at] == twin else common[twin]
                if agreed > known:
                    known = agreed if agreed < reach - i else reach - i
            end = i + known
            if end >= reach:
                there = at + known
                while end < n and s[end] == s[there]:
                    end += 1
                    there += 1
                known, copied, shift, reach = end - i, i, i - at, end
            if end < n and s[at + known] < s[end]:
                break
            smaller[at], matched[at] = i, known
            # The next suffix of the chain is smaller than the one at ``at``; their first difference tells of it and i.
            link = common[at]
            at = before[at]
            while at >= 0 and link != known:
                if link < known:  # smaller already where ``at`` and i agree
                    known = link
                    break
                smaller[at], matched[at] = i, known
                link = common[at]
                at = before[at]
            else:
                continue
            break
        before[i], common[i] = at, known if at >= 0 else 0
    return smaller, matched


def word_runs(words: list[int], periods: int = PERIODS, least: int = WORDS) -> list[tuple[int, int, int]]:
    """start, length, period of the maximal runs of ``words`` (numbers; equal ones mean equal words) with a length of at least
    ``least`` and ``periods`` times the smallest period, two or more.

    A run repeats a Lyndon word of one of the two orders of the alphabet, whose occurrences in it are longest Lyndon
    words of their places. From the first of them the run reaches to the right as far as the edge's extension, and to the left
    less than a period.
    """
    found = set()
    for s in (words, [-w for w in words]):
        smaller, matched = lyndon_edges(s)
        for i, (j, right) in enumerate(zip(smaller, matched)):
            p = j - i
            # To the left lies less than a period, so the rest lies to the right.
            if right <= (periods - 2) * p or j == len(s) or (i >= p and smaller[i - p] == i and matched[i - p] >= p):
                continue
            left = 0
            while left < i and s[i - left - 1] == s[j - left - 1]:
                left += 1
            length = left + p + right
            if length >= max(least, periods * p):
                found.add((i - left, length, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _stretches(codes: np.ndarray, rows: np.ndarray, periods: int, least: int) -> Iterator[tuple[int, int]]:
    """Starts and ends of the stretches of words, each within a row, that hold all runs.

    In a run of at least ``periods`` periods every word stands that often, and every three words one time less. Words of other
    places belong to no run, so runs end where such words are.
    """

    def held(keys: np.ndarray, times: int) -> np.ndarray:
        _, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
        return counts[which] >= times

    alive = np.flatnonzero(held(rows * (int(codes.max()) + 1) + codes, periods))
    if len(alive) < least:
        return
    first = np.concatenate([[True], (np.diff(alive) > 1) | (np.diff(rows[alive]) > 0)])
    group = np.cumsum(first) - 1
    inside = np.zeros(len(alive), bool)
    if len(alive) >= 3 and least >= 3:
        whole = np.flatnonzero(group[:-2] == group[2:])
        if not len(whole):
            return
        # Numbers for pairs, then for triples, so that no product leaves 64 bits.
        _, pair = np.unique(rows[alive[whole]] * (int(codes.max()) + 1) + codes[alive[whole]], return_inverse=True)
        _, second = np.unique(pair * (int(codes.max()) + 1) + codes[alive[whole + 1]], return_inverse=True)
        often = whole[held(second * (int(codes.max()) + 1) + codes[alive[whole + 2]], periods - 1)]
        for k in range(3):
            inside[often + k] = True
    else:
        inside[:] = True
    kept = alive[inside]
    if not len(kept):
        return
    cut = np.flatnonzero((np.diff(kept) > 1) | (np.diff(rows[kept]) > 0)) + 1
    for start, end in zip(kept[np.concatenate([[0], cut])], kept[np.concatenate([cut - 1, [len(kept) - 1]])] + 1):
        if end - start >= least:
            yield int(start), int(end)


def _split(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, end to end, and the row of each."""
    lists = pc.ascii_split_whitespace(pc.fill_null(text, ""))
    words, rows = lists.flatten(), pc.list_parent_indices(lists)
    real = pc.not_equal(words, "")
    return words.filter(real), rows.filter(real).to_numpy().astype(np.int64)


def runs_of(text: pa.Array, periods: int = PERIODS, least: int = WORDS) -> tuple[list[list[tuple[int, int, int]]], pa.Array]:
    """The runs of each text, and the texts without the repetitions: a word goes if some run has it after its first period."""
    words, rows = _split(text)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(len(text))]
    stays = np.ones(len(words), bool)
    first = np.searchsorted(rows, np.arange(len(text)))
    if len(words):
        # Numbers in order of appearance: any order of the alphabet will do, as both it and its opposite are looked at.
        codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
        for start, end in _stretches(codes, rows, periods, least):
            for at, length, period in word_runs(codes[start:end].tolist(), periods, least):
                runs[rows[start]].append((start + at - int(first[rows[start]]), length, period))
                stays[start + at + period : start + at + length] = False
    kept = np.add.reduceat(np.append(stays, False).astype(np.int64), first) if len(text) else np.zeros(0, np.int64)
    kept[first == np.append(first[1:], len(words))] = 0
    lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(kept)]), words.filter(pa.array(stays)))
    return runs, pc.binary_join(lists, " ")


def with_runs(docs: DataFrame, text_column: str = "text", periods: int = PERIODS, least: int = WORDS) -> DataFrame:
    """``docs`` with runs (start, length, period in words, by start, then period) and collapsed, the words that stay, joined by
    one space.

    Words are `[^\\x20\\x09-\\x0D]+`. Null and empty texts have no runs and an empty collapsed text. Repeated rows are documents of their
    own, other columns stay; columns that are named runs or collapsed are replaced. No shuffle; a
    text is looked at as a whole, and a task holds a slice of 256 KB or one longer text. Runs may overlap; none is lost.
    """
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c.lower() not in ("runs", "collapsed")]
    schema = docs.select(*(F.col(f"`{c}`") for c in rest)).schema

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, rest.index(text_column)):
                found, collapsed = runs_of(part.column(rest.index(text_column)), periods, least)
                ends = np.concatenate([[0], np.cumsum([len(r) for r in found])]).astype(np.int32)
                flat = np.array([r for of in found for r in of], np.int64).reshape(-1, 3)
                structs = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
                columns = [*part.columns, pa.ListArray.from_arrays(pa.array(ends), structs), collapsed.cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*rest, "runs", "collapsed"])
            give_back()

    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), f"runs array<{RUN}>", "collapsed string"])
    return docs.select(*(F.col(f"`{c}`") for c in rest)).mapInArrow(find, kinds)


def _parts(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``most`` bytes of text, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield batch.slice(i, j - i)
        i = j


def repeated_tails(text: Column, key: Column) -> Column:
    """The query's texts: with h the crc32 of the key, every tenth text's words repeat from word h / 10 % n on."""
    h = F.crc32(key.cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    a = lambda s: s["g"] % F.greatest(F.size(s["w"]), F.lit(1))
    held = F.struct(words.alias("w"), g.alias("g"))
    placed = F.transform(
        F.array(held),
        lambda s: F.struct(s["w"].alias("w"), a(s).cast("int").alias("a"), (1 + F.floor((F.size(s["w"]) - a(s)) / (3 + s["g"] % 8))).cast("int").alias("p")),
    )
    tail = lambda s: F.transform(s["w"], lambda w, i: F.when(i < s["a"], w).otherwise(F.get(s["w"], s["a"] + (i - s["a"]) % s["p"])))
    repeated = F.get(F.transform(placed, lambda s: F.array_join(tail(s), " ")), F.lit(0))
    return F.when(h % 10 == 0, repeated).otherwise(text)


def op12_periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", repeated_tails(F.col("text"), F.col("doc_id")).alias("text"))
    found = with_runs(docs)
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("r"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("r.shorter")
    milli = F.expr("(1000 * -r.shorter) div r.period")
    return out.select("doc_id", "n_runs", F.col("r.start").alias("start"), length.alias("length"), F.col("r.period").alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
