"""Reversible line dedup: exact reference counts of lines with sharded cuckoo filters in front.

The exact table has one row a line key: in how many documents it stands. Documents are
added and removed by adding and subtracting counts. The keys at or over the threshold are
kept in cuckoo filters, one a shard, to which keys are added and from which they are
deleted as their counts cross the threshold. Lines of documents ask the filters first; what
the filters report is held against the exact counts, so the outcome is exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from .common import names_apart, staged, table

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"
#: Keys in a filter shard, on average; a shard's table is built and probed in one task.
SHARD_KEYS = 1 << 16
#: Filters and hot keys up to this size go to every executor; beyond it lines are joined.
BROADCAST_BYTES = 48 << 20

COUNTS = "k1 long, k2 long, docs long"
FILTERS = "shard int, buckets int, slots binary"


class CuckooFilter:
    """16-bit fingerprints in buckets of four; a key may lie in either of two buckets."""

    def __init__(self, buckets: int, slots: np.ndarray | None = None):
        self.buckets = buckets
        self.slots = np.zeros((buckets, 4), np.uint16) if slots is None else slots.reshape(buckets, 4)

    @classmethod
    def of(cls, keys: np.ndarray, spare: float = 0.7) -> CuckooFilter:
        """A filter with all keys, with room for as many again before it is half rebuilt."""
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, len(keys)) / (4 * spare)))))
        while True:
            out = cls(buckets)
            if all(out.insert(int(k)) for k in keys):
                return out
            buckets *= 2

    @staticmethod
    def _print(key):
        return (key >> 48 & 0xFFFF) | 1  # never 0, which marks an empty slot

    def _other(self, bucket, mark):
        return bucket ^ (mark * 0x5BD1E995 & (self.buckets - 1))

    def insert(self, key: int) -> bool:
        key &= 2**64 - 1
        mark = self._print(key)
        at = key & (self.buckets - 1)
        for b in (at, self._other(at, mark)):
            free = np.flatnonzero(self.slots[b] == 0)
            if len(free):
                self.slots[b, free[0]] = mark
                return True
        for kick in range(500):
            slot = (mark + kick) & 3
            mark, self.slots[at, slot] = int(self.slots[at, slot]), mark
            at = self._other(at, mark)
            free = np.flatnonzero(self.slots[at] == 0)
            if len(free):
                self.slots[at, free[0]] = mark
                return True
        return False

    def delete(self, key: int) -> bool:
        key &= 2**64 - 1
        mark = self._print(key)
        at = key & (self.buckets - 1)
        for b in (at, self._other(at, mark)):
            held = np.flatnonzero(self.slots[b] == mark)
            if len(held):
                self.slots[b, held[0]] = 0
                return True
        return False

    def contains(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.int64).view(np.uint64)
        mark = (keys >> np.uint64(48)) | np.uint64(1)
        low = np.uint64(self.buckets - 1)
        at = keys & low
        other = at ^ (mark * np.uint64(0x5BD1E995) & low)
        mark = mark.astype(np.uint16)[:, None]
        return (self.slots[at] == mark).any(1) | (self.slots[other] == mark).any(1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWERED)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _k1(key: Column) -> Column:
    return F.xxhash64(key)


def _k2(key: Column) -> Column:
    return F.xxhash64(F.lit(7), key)


def line_counts(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """The exact table: for each key of ``min_chars`` code points or more, in how many rows of ``docs`` it stands.

    Keys are 128-bit hashes. A null or empty text has one empty line, which has no key here.
    Repeated rows count as documents of their own.
    """
    keys = F.filter(F.transform(_lines(F.col("text")), line_key), lambda k: F.char_length(k) >= min_chars)
    each = docs.select(F.explode(F.array_distinct(F.transform(keys, lambda k: F.struct(_k1(k).alias("k1"), _k2(k).alias("k2"))))).alias("k"))
    return each.groupBy("k.k1", "k.k2").agg(F.count(F.lit(1)).alias("docs"))


def changed_counts(counts: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None, min_chars: int = 1) -> DataFrame:
    """``counts`` after documents came and went; adding documents and removing them again gives the table back."""
    out = counts
    for docs, sign in ((added, 1), (removed, -1)):
        if docs is not None:
            out = out.unionByName(line_counts(docs, min_chars).withColumn("docs", sign * F.col("docs")))
    return out.groupBy("k1", "k2").agg(F.sum("docs").alias("docs")).where("docs <> 0")


def _shard(shards: int) -> Column:
    return F.pmod(F.col("k2"), F.lit(shards)).cast("int")


def filters_of(counts: DataFrame, min_docs: int, shards: int) -> DataFrame:
    """Cuckoo filters of the keys in ``min_docs`` documents or more: shard, buckets, slots."""

    def build(key, rows):
        f = CuckooFilter.of(np.sort(rows.k1.to_numpy()))
        return pd.DataFrame({"shard": [key[0]], "buckets": [f.buckets], "slots": [f.slots.tobytes()]})

    return counts.where(F.col("docs") >= min_docs).select("k1", _shard(shards).alias("shard")).groupBy("shard").applyInPandas(build, FILTERS)


def changed_filters(filters: DataFrame, before: DataFrame, after: DataFrame, min_docs: int, shards: int) -> DataFrame:
    """``filters`` with the keys inserted and deleted whose counts crossed the threshold."""
    old = before.select("k1", "k2", F.col("docs").alias("was"))
    crossed = (
        old.join(after, ["k1", "k2"], "full")
        .select("k1", _shard(shards).alias("shard"), (F.coalesce("was", F.lit(0)) >= min_docs).alias("had"), (F.coalesce("docs", F.lit(0)) >= min_docs).alias("has"))
        .where("had <> has")
    )

    def update(key, held, moved):
        if len(held):
            f = CuckooFilter(int(held.buckets[0]), np.frombuffer(held.slots[0], np.uint16).copy())
        else:
            f = CuckooFilter(1 << max(1, int(np.ceil(np.log2(len(moved) + 1)))))
        for k in moved.k1[~moved.has]:
            f.delete(int(k))
        if not all([f.insert(int(k)) for k in moved.k1[moved.has]]):
            raise ValueError("a filter shard is full: build the filters anew with filters_of()")
        return pd.DataFrame({"shard": [key[0]], "buckets": [f.buckets], "slots": [f.slots.tobytes()]})

    return filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInPandas(update, FILTERS)


def mark_lines(docs: DataFrame, hot: DataFrame, n_hot: int, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with ``_ld_lines`` and ``_ld_drop`` (for each line, whether its key is in ``hot``).

    ``hot``: the part of the exact table at or over the threshold, written already; ``n_hot``: its rows.
    """
    shards = max(1, -(-n_hot // SHARD_KEYS))
    cut = docs.withColumn("_ld_lines", _lines(F.col("text")))
    keys = F.transform("_ld_lines", line_key)
    if 32 * n_hot <= broadcast_bytes:
        filters = filters_of(hot, 0, shards).collect()
        exact = hot.select("k1", "k2").toPandas()
        order = np.lexsort((exact.k2, exact.k1))
        state = docs.sparkSession.sparkContext.broadcast(
            ({r.shard: CuckooFilter(r.buckets, np.frombuffer(r.slots, np.uint16)) for r in filters}, exact.k1.to_numpy()[order], exact.k2.to_numpy()[order])
        )

        @pandas_udf("array<boolean>")
        def probe(k1: pd.Series, k2: pd.Series) -> pd.Series:
            shard_filters, hot1, hot2 = state.value
            sizes = k1.map(len).to_numpy()
            a, b = (np.concatenate(x.to_list()).astype(np.int64) if len(x) else np.zeros(0, np.int64) for x in (k1, k2))
            hit, of = np.zeros(len(a), bool), np.mod(b, shards)
            for s, f in shard_filters.items():
                mine = np.flatnonzero(of == s)
                hit[mine] = f.contains(a[mine])
            for i in np.flatnonzero(hit):
                lo, hi = np.searchsorted(hot1, a[i]), np.searchsorted(hot1, a[i], "right")
                hit[i] = (hot2[lo:hi] == b[i]).any()
            return pd.Series(np.split(hit, np.cumsum(sizes)[:-1])) if len(sizes) else pd.Series([], dtype=object)

        return cut.withColumn("_ld_drop", probe(F.transform(keys, _k1), F.transform(keys, _k2)))
    # More hot keys than an executor should hold: join the lines with the exact table.
    rows = staged(cut.withColumn("_ld_row", F.expr("uuid()")), "line-rows")
    lines = rows.select("_ld_row", F.posexplode(keys).alias("at", "key")).select("_ld_row", "at", _k1(F.col("key")).alias("k1"), _k2(F.col("key")).alias("k2"))
    dropped = lines.join(hot.select("k1", "k2"), ["k1", "k2"]).groupBy("_ld_row").agg(F.collect_set("at").alias("_ld_at"))
    marked = rows.join(dropped, "_ld_row", "left")
    return marked.withColumn("_ld_drop", F.transform("_ld_lines", lambda line, i: F.coalesce(F.array_contains("_ld_at", i), F.lit(False)))).drop("_ld_row", "_ld_at")


@names_apart("_ld_")
def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, counts: DataFrame | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` (any columns, with ``text``) with ``kept_text``, ``n_lines`` and ``n_dropped``.

    Every line whose key (stripped, A-Z lower-cased, ``min_chars`` code points or more) stands in ``min_docs`` rows or
    more goes, in every document. ``counts``: the exact table to use, by default that of ``docs``. Columns of these names
    are replaced. Null texts count as one empty line and give an empty ``kept_text``; lines without a key stay.
    """
    counts = line_counts(docs, min_chars) if counts is None else counts
    hot = staged(counts.where(F.col("docs") >= min_docs), "hot-lines")
    marked = mark_lines(docs, hot, hot.count(), broadcast_bytes)
    kept = F.filter("_ld_lines", lambda line, i: ~F.get("_ld_drop", i))
    return marked.withColumns({"kept_text": F.array_join(kept, "\n"), "n_lines": F.size("_ld_lines").cast("long"), "n_dropped": F.size(F.filter("_ld_drop", lambda x: x)).cast("long")}).drop("_ld_lines", "_ld_drop")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in 10 documents or more leave all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH l AS (
  SELECT rn, doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT rn, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
        FROM (SELECT row_number() OVER () AS rn, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
hot AS (SELECT k FROM (SELECT DISTINCT rn, k FROM l WHERE length(k) >= 1) GROUP BY k HAVING count(*) >= 10)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM (
  SELECT rn, any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE k IN (FROM hot)) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE k NOT IN (FROM hot)), '') AS kept
  FROM l GROUP BY rn)
"""
