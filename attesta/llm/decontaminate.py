"""Benchmark decontamination with a generalised suffix automaton of the test items' words.

The automaton of a block of items goes to the executors (a block is bounded, so the
broadcast is). Documents stream through it word by word; the automaton tracks the longest
run of words, ending at each word, that stands in some item. Runs of words whose neighbours
form no pair of any item are skipped before, in numpy, as no match crosses such a pair.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_BYTES, LOWER, found_in, row_slices, small_batches, staged, table, utf8, word_hashes, word_spans

#: Bytes of item text in one automaton. More items mean more automata, one pass each.
BLOCK_BYTES = 4 << 20


class SuffixAutomaton:
    """Of sequences of words. Windows of ``window`` words, and whole shorter items, know their items."""

    def __init__(self, items: list[tuple[object, list[int]]], window: int):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.window = window
        self.owners: dict[int, set] = {}  # by the state of a window
        self.whole: dict[int, list] = {}  # by the state of an item that is shorter than a window
        for name, words in items:
            state = length = 0
            for w in words:
                state, length = self.step(state, length, w)
                if length >= window:
                    self.owners.setdefault(self.suffix(state, window), set()).add(name)
            if 0 < len(words) < window:
                self.whole.setdefault(self.suffix(state, len(words)), []).append((len(words), name))

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _state(self, length: int, after: dict[int, int], link: int) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def step(self, state: int, length: int, w: int) -> tuple[int, int]:
        """The longest match that ends with the next word w."""
        while state and w not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        to = self.next[state].get(w)
        return (0, 0) if to is None else (to, length + 1)

    def suffix(self, state: int, n: int) -> int:
        """The state of the last n words of a match in ``state``."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def ends_here(self, state: int, length: int) -> Iterator[tuple[int, object]]:
        """Windows and short items that end at a match: their lengths and items."""
        if length >= self.window:
            at = self.suffix(state, self.window)
            for name in self.owners.get(at, ()):
                yield self.window, name
        while state > 0 and self.whole:
            for n, name in self.whole.get(state, ()):
                if n <= length:
                    yield n, name
            state = self.link[state]


class _Block:
    """What a task holds of a block of items: vocabulary, pairs of neighbours, automaton."""

    _held: dict[str, _Block] = {}

    def __init__(self, items: list[tuple[object, str]], window: int):
        data, off = utf8(pa.array([t for _, t in items], pa.string()))
        data = LOWER[data]
        s, e, row = word_spans(data, off, ALNUM_BYTES)
        h = word_hashes(data, s, e)
        self.vocabulary = np.unique(h)
        ids = found_in(self.vocabulary, h)
        sequences = [(name, x.tolist()) for (name, _), x in zip(items, np.split(ids, np.searchsorted(row, np.arange(1, len(items)))), strict=True)] if items else []
        self.shortest = min([window, *(len(x) for _, x in sequences if x)])
        self.pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.array(x[:-1], np.int64) * len(self.vocabulary) + np.array(x[1:], np.int64) for _, x in sequences)]))
        self.automaton = SuffixAutomaton(sequences, window)

    @classmethod
    def of(cls, name: str, items: list[tuple[object, str]], window: int) -> _Block:
        if name not in cls._held:
            cls._held.clear()
            cls._held[name] = cls(items, window)
        return cls._held[name]

    def hits(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set], list[int]]:
        """By row: words, hit runs of words (from, to; not merged), items, longest match."""
        s, e, row = word_spans(data, off, ALNUM_BYTES)
        n = len(off) - 1
        first = np.searchsorted(row, np.arange(n + 1))
        ids = found_in(self.vocabulary, word_hashes(data, s, e))
        runs: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        items: list[set] = [set() for _ in range(n)]
        longest = [0] * n
        joined = (ids[:-1] >= 0) & (ids[1:] >= 0) & (row[:-1] == row[1:])
        at = np.flatnonzero(joined)
        joined[at] = found_in(self.pairs, ids[at] * len(self.vocabulary) + ids[at + 1]) >= 0
        # Runs of words in which each is a neighbour of the next; long enough to hold a window.
        edge = np.diff(np.concatenate([[0], joined.astype(np.int8), [0]]))
        lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
        if self.shortest == 1:
            single = np.flatnonzero((ids >= 0) & ~np.concatenate([[False], joined]) & ~np.concatenate([joined, [False]]))
            lo, hi = np.concatenate([lo, single]), np.concatenate([hi, single + 1])
        long_enough = hi - lo >= self.shortest
        step, ends_here = self.automaton.step, self.automaton.ends_here
        for a, b in zip(lo[long_enough].tolist(), hi[long_enough].tolist(), strict=True):
            r = int(row[a])
            state = length = 0
            for i, w in enumerate(ids[a:b].tolist(), a - int(first[r]) + 1):
                state, length = step(state, length, w)
                longest[r] = max(longest[r], length)
                for n_words, name in ends_here(state, length):
                    runs[r].append((i - n_words, i))
                    items[r].add(name)
        return np.diff(first), runs, items, longest


def merged(runs: list[tuple[int, int]]) -> list[int]:
    """Maximal runs as a flat list from0, to0, from1, to1, ..."""
    out: list[int] = []
    for a, b in sorted(runs):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


MATCH = "struct<n_words:long,runs:array<int>,items:array<string>,longest:int>"
CUT = "struct<n_words:long,n_hit:long,kept:string>"
KEPT = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("kept", pa.string())])
SCAN = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.int32())), ("items", pa.list_(pa.string())), ("longest", pa.int32())])


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, str]]]:
    block, size = [], 0
    for r in items.select(F.col("item_id").cast("string").alias("i"), F.coalesce("text", F.lit("")).alias("t")).toLocalIterator():
        if block and size + len(r.t) > block_bytes:
            yield block
            block, size = [], 0
        block.append((r.i, r.t))
        size += len(r.t)
    yield block


def _matches(automaton: _Block, data: np.ndarray, off: np.ndarray, before: list[dict | None]) -> list[dict]:
    """By row, its match, with what earlier blocks matched."""
    words, runs, found, longest = automaton.hits(LOWER[data], off)
    rows = []
    for r, old in enumerate(before):
        flat = (old and old["runs"]) or []
        rows.append(
            {
                "n_words": int(words[r]),
                "runs": merged(runs[r] + list(zip(flat[::2], flat[1::2], strict=True))),
                "items": sorted({x for x in found[r] if x is not None} | set((old and old["items"]) or [])),
                "longest": max(longest[r], (old and old["longest"]) or 0),
            }
        )
    return rows


def _scanner(held: Broadcast, name: str, window: int):
    @F.arrow_udf(MATCH)
    def scan(text: pa.Array, before: pa.Array) -> pa.Array:
        automaton = _Block.of(name, held.value, window)
        rows = []
        for i, j, data, off in row_slices(text):
            rows += _matches(automaton, data, off, before.slice(i, j - i).to_pylist())
        return pa.array(rows, SCAN)

    return scan


def _cutter(held: Broadcast, name: str, window: int):
    """As _scanner(), but of what is found: n_words, n_hit, and the text without the hit runs (null where nothing hits)."""

    @F.arrow_udf(CUT)
    def cut(text: pa.Array, before: pa.Array) -> pa.Array:
        automaton = _Block.of(name, held.value, window)
        rows = []
        for i, j, data, off in row_slices(text):
            matches = _matches(automaton, data, off, before.slice(i, j - i).to_pylist())
            kept = _without(data, off, [m["runs"] for m in matches])
            rows += [{"n_words": m["n_words"], "n_hit": sum(m["runs"][1::2]) - sum(m["runs"][::2]), "kept": k} for m, k in zip(matches, kept, strict=True)]
        return pa.array(rows, KEPT)

    # Else Spark would run it once for the filter and once more for what the filter keeps.
    return cut.asNondeterministic()


def _without(data: np.ndarray, off: np.ndarray, runs: list[list[int]]) -> list[str | None]:
    """By row, the text without its runs of words."""
    out: list[str | None] = []
    s, e, row = word_spans(LOWER[data], off, ALNUM_BYTES)
    first = np.searchsorted(row, np.arange(len(off)))
    for r, flat in enumerate(runs):
        at, kept = int(off[r]), []
        for a, b in zip(flat[::2], flat[1::2], strict=True):
            kept.append(data[at : s[first[r] + a]])
            at = int(e[first[r] + b - 1])
        out.append(b"".join(x.tobytes() for x in [*kept, data[at : off[r + 1]]]).decode() if flat else None)
    return out


def match_items(docs: DataFrame, items: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a struct ``match``: n_words, runs (hit words as from0, to0, ...; ends exclusive), items, longest.

    Words are lower-cased runs of 0-9, a-z and everything beyond ASCII. A document word is hit when it lies in an
    occurrence of ``window`` consecutive words of an item, or of a whole item that is shorter. ``items`` lists
    the ids (as strings, sorted, once each) of the items with such windows; an item without an id hits but isn't listed.
    ``longest`` is the longest run of words that stands in an item. Null and empty texts have no words; items without
    words match nothing. A column ``match`` of ``docs`` is replaced; others pass through.
    """
    return _matched(docs, items, window, block_bytes, _scanner)


def _matched(docs: DataFrame, items: DataFrame, window: int, block_bytes: int, last) -> DataFrame:
    """``docs`` with ``match``: what ``last`` returns for the last block, after _scanner() for those before it."""
    spark = docs.sparkSession
    small_batches(spark)
    out, todo = docs.withColumn("match", F.lit(None).cast(MATCH)), None
    for block in _blocks(items, block_bytes):
        if todo:
            out = staged(out.withColumn("match", _scanner(*todo)("text", "match")), "decontaminate")
        todo = spark.sparkContext.broadcast(block), uuid.uuid4().hex, window
    return out.withColumn("match", last(*todo)("text", "match"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, most_coverage: float = 0.5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without test items: hit spans are cut out of ``text``, and documents of which more than ``most_coverage``
    of the words are hit go altogether. Texts that nothing hits stay as they are, null ones too."""
    found = _matched(docs, items, window, block_bytes, _cutter)
    kept = found.where(F.col("match.n_hit") <= most_coverage * F.col("match.n_words"))
    return kept.withColumn("text", F.coalesce("match.kept", "text")).drop("match")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents that stand in windows of 10 words of benchmark items."""
    found = match_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.transform("match.runs", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0), lambda a, b: a + b).cast("long")
    return found.select(
        "doc_id",
        "match.n_words",
        n_hit.alias("n_hit"),
        F.size("match.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("match.items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


OP3_SQL = r"""
WITH iw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
win AS (SELECT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM iw WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
p AS (SELECT rn, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
occ AS (SELECT p.rn, p.i, p.n, win.item_id FROM (SELECT rn, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM p) p JOIN win ON win.n = p.n AND win.k = p.k),
hit AS (SELECT rn, count(DISTINCT j) AS n_hit FROM (SELECT rn, unnest(range(i, i + n)) AS j FROM occ) GROUP BY rn),
its AS (SELECT rn, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT rn, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY rn)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rn) LEFT JOIN its USING (rn)
"""
