"""Removal of repeated byte strings by suffixes, sorted a bucket at a time, over a difference cover.

A string of ``length`` bytes that starts at i and at j holds a pair of aligned sample positions
i + d and j + d, d < v, where samples are the positions whose place in the document, modulo v, lies in a
difference cover of v. So first the samples alone are sorted, bucket by bucket, by the
``length`` - v + 1 bytes that follow them. Only suffixes within v bytes before a sample of which there is
another can repeat. These few are sorted in turn, bucket by bucket, by their first ``length``
bytes. Sorting is by fingerprints of those bytes: equal strings are what matters, not their
order, and a suffix costs a few bytes of shuffle instead of hundreds. Each bucket is sorted in one
task; the number of buckets grows with the text, so a task's memory does not.

Equal keys inside one batch of documents are settled there: a batch sends any key once, so a string with any
number of copies makes as many rows as there are batches. Before the second sort, documents that share a repeated
passage are brought together, which settles most copies in this way.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE_VALUE, discard, give_back, prefix_hash, small_batches, span_hash, staged, table, unused, utf8

#: The cover has PRIME + 1 of PRIME^2 + PRIME + 1 residues.
PRIME = 17
SAMPLE_BATCH_BYTES, SUFFIX_BATCH_BYTES = 3 << 19, 3 << 19
#: Documents are brought together by the least hash of windows of so many bytes near their repeated samples.
ANCHOR_BYTES = 32
#: Keys in a bucket, on average, and bytes of the documents whose places are gathered in one task.
BUCKET_KEYS = 1 << 19
HOME_BYTES = 4 << 20
SAMPLE_KEY_BYTES, SUFFIX_KEY_BYTES = 5, 8
#: For passages that repeat but are shorter than the strings removed: windows of so many bytes (some
#: thirty words), of which those count whose hash is divisible by the second number.
WINDOW_BYTES, WINDOW_EVERY = 208, 32
#: Windows that are hashed at once.
WINDOW_RUN = 1 << 17


@lru_cache
def difference_cover(q: int = PRIME) -> tuple[int, tuple[int, ...]]:
    """v = q^2 + q + 1 and q + 1 residues, of whose differences each non-zero residue is exactly one (q prime).

    Singer's construction: the powers of a root of a cubic over GF(q) that lie in a plane; cubics are tried until
    the differences come out right.
    """
    v = q * q + q + 1
    for k in range(1, q**3):
        a, b, c = k // (q * q), k // q % q, k % q
        x, cover = (1, 0, 0), []
        for i in range(v):
            if x[2] == 0:
                cover.append(i)
            top = x[2]
            x = (top * c % q, (x[0] + top * b) % q, (x[1] + top * a) % q)
        if len(cover) == q + 1 and len({(m - n) % v for m in cover for n in cover}) == v:
            return v, tuple(cover)
    raise ValueError(f"no cubic over GF({q})")


def cover_for(length: int) -> tuple[int, tuple[int, ...]]:
    """The sparsest cover that leaves a sample at least a quarter of the length to be told by, up to PRIME's."""
    for q in (PRIME, 13, 11, 7, 5, 3, 2):
        if (q * q + q + 1) * 4 <= 3 * length + 400 and q * q + q + 1 <= length:
            return difference_cover(q)
    return 1, (0,)


SENT = "bucket int, keys binary, doc binary, pos binary, run binary, settled boolean"
SENT_ARROW = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("doc", pa.binary()), ("pos", pa.binary()), ("run", pa.binary()), ("settled", pa.bool_())])
TOLD = "home int, doc binary, pos binary, run binary"
PLACES = "doc_key long, pos binary, run binary"
PLACES_ARROW = pa.schema([("doc_key", pa.int64()), ("pos", pa.binary()), ("run", pa.binary())])


def _packed(keys: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(blob: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(blob) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def _runs(doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring positions (sorted by document and position): document, first, how many."""
    if not len(pos):
        return doc, pos, pos
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1)]))
    return doc[first], pos[first], np.diff(np.append(first, len(pos)))


def _send(keys: np.ndarray, doc: np.ndarray, pos: np.ndarray, buckets: int, width: int):
    """What a batch sends: keys that it has once with their places; keys that it has more often, once and without
    a place; and the places of the latter, settled already. ``doc`` are document keys; doc, pos sorted."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
    count = np.diff(np.append(np.flatnonzero(new), len(k)))
    many = np.zeros(len(keys), bool)
    many[order] = np.repeat(count > 1, count)
    places = np.flatnonzero(~many)
    shared = k[new][count > 1]
    all_keys = np.concatenate([keys[places], shared])
    bucket = (all_keys % np.uint64(buckets)).astype(np.int32)
    by = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
    rest = all_keys // np.uint64(buckets)
    rows = []
    for b in range(buckets):
        at = by[cuts[b] : cuts[b + 1]]
        if len(at):
            own = places[at[at < len(places)]]
            rows.append((b, _packed(rest[at], width), doc[own].tobytes(), pos[own].astype(np.uint32).tobytes(), b"", False))
    d, p, r = _runs(doc[many], pos[many])
    if len(d):
        rows.append((int(d[0] % buckets), b"", d.tobytes(), p.astype(np.uint32).tobytes(), r.astype(np.uint32).tobytes(), True))
    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], f.type) for i, f in enumerate(SENT_ARROW)], schema=SENT_ARROW)


def _by_home(doc: np.ndarray, pos: np.ndarray, run: np.ndarray, homes: int) -> pa.Table:
    """One row for each home group of documents: its documents' places."""
    home = np.mod(doc, homes).astype(np.int32)
    order = np.lexsort((pos, doc, home))
    first = np.flatnonzero(np.diff(home[order], prepend=-1))
    cut = lambda x: [y.tobytes() for y in np.split(x[order], first[1:])] if len(first) else []
    columns = [pa.array(home[order][first], pa.int32()), *(pa.array(cut(x), pa.binary()) for x in (doc, pos.astype(np.uint32), run.astype(np.uint32)))]
    return pa.Table.from_arrays(columns, names=["home", "doc", "pos", "run"])


def _at_home(rows: pa.Table) -> pa.Table:
    """One row for each document of a home group: its places, as runs."""
    doc, pos, run = (np.frombuffer(b"".join(rows.column(c).to_pylist()), t) for c, t in (("doc", np.int64), ("pos", np.uint32), ("run", np.uint32)))
    order = np.lexsort((pos, doc))
    doc, pos, run = doc[order], pos[order].astype(np.int64), run[order].astype(np.int64)
    # Places that follow one another become one run; those told twice stay apart, which does no harm.
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + run[:-1])])
    head = np.flatnonzero(new)
    doc, pos, run = doc[head], pos[head], np.add.reduceat(run, head)
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    cut = lambda x: [y.tobytes() for y in np.split(x.astype(np.uint32), first[1:])]
    return pa.Table.from_arrays([pa.array(doc[first]), pa.array(cut(pos), pa.binary()), pa.array(cut(run), pa.binary())], schema=PLACES_ARROW)


def _sort_bucket(width: int, homes: int):
    """Sorts one bucket; the places of keys that it has more than once."""

    def settle(rows: pa.Table) -> pa.Table:
        keys, doc, pos, placed = [], [], [], []
        done = [[], [], []]
        for row in rows.to_pylist():
            d, p = np.frombuffer(row["doc"], np.int64), np.frombuffer(row["pos"], np.uint32)
            if row["settled"]:
                for out, x in zip(done, (d, p, np.frombuffer(row["run"], np.uint32)), strict=True):
                    out.append(x)
            else:
                k = _unpacked(row["keys"], width)
                keys.append(k)
                doc.append(d)
                pos.append(p)
                placed.append(np.arange(len(k)) < len(d))
        parts = [[np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(done, (np.int64, np.uint32, np.uint32), strict=True)]]
        if keys:
            k, placed = np.concatenate(keys), np.concatenate(placed)
            order = np.argsort(k, kind="stable")
            s, alone = k[order], ~placed[order]
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            again = (np.diff(np.append(first, len(s))) > 1) | (np.add.reduceat(alone.astype(np.int64), first) > 0)
            hit = np.zeros(len(k), bool)
            hit[order] = np.repeat(again, np.diff(np.append(first, len(s))))
            hit = hit[placed]
            parts.append([np.concatenate(doc)[hit], np.concatenate(pos)[hit], np.ones(hit.sum(), np.uint32)])
        return _by_home(*(np.concatenate(x) for x in zip(*parts, strict=True)), homes)

    return settle


def _again(sent: DataFrame, width: int, homes: int) -> DataFrame:
    """By document, the places (pos, run: blobs of first places and of how many follow) of its keys that stand elsewhere."""
    return sent.groupBy("bucket").applyInArrow(_sort_bucket(width, homes), TOLD).groupBy("home").applyInArrow(_at_home, PLACES)


def _buffered(batches, columns: tuple[str, ...], most: int):
    """Batches of documents of about ``most`` bytes: bytes, offsets, and the other columns."""
    for batch in batches:
        data, off = utf8(batch.column("text"))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
            yield data[off[i] : off[j]], off[i : j + 1] - off[i], [batch.column(c).slice(i, j - i) for c in columns]
            i = j
        give_back()


def _blob(x: bytes | None) -> np.ndarray:
    return np.frombuffer(x or b"", np.uint32).astype(np.int64)


def _sample_keys(length: int, buckets: int):
    v, cover = cover_for(length)
    told_by = length - v + 1

    def send(batches):
        for data, off, (doc_keys,) in _buffered(batches, ("doc_key",), SAMPLE_BATCH_BYTES):
            n = np.diff(off)
            # Every document's samples: the cover, again and again, up to where told_by bytes are left.
            rounds = np.maximum(0, (n - told_by) // v + 1) * (n >= length)
            doc = np.repeat(np.arange(len(n)), rounds * len(cover))
            if not len(doc):
                continue
            start = np.concatenate([[0], np.cumsum(rounds * len(cover))[:-1]])
            nth = np.arange(len(doc)) - start[doc]
            pos = nth // len(cover) * v + np.array(cover)[nth % len(cover)]
            fits = pos + told_by <= n[doc]
            doc, pos = doc[fits], pos[fits]
            at = off[doc] + pos
            keys = span_hash(prefix_hash(BYTE_VALUE[data]), at, at + told_by)
            yield from _send(keys, doc_keys.to_numpy()[doc], pos, buckets, SAMPLE_KEY_BYTES)

    return send


def _window_keys(buckets: int):
    def send(batches):
        for data, off, (doc_keys,) in _buffered(batches, ("doc_key",), SAMPLE_BATCH_BYTES):
            prefix, chosen, found = prefix_hash(BYTE_VALUE[data]), [], []
            for i in range(0, len(data) - WINDOW_BYTES + 1, WINDOW_RUN):
                at = np.arange(i, min(i + WINDOW_RUN, len(data) - WINDOW_BYTES + 1))
                keys = span_hash(prefix, at, at + WINDOW_BYTES)
                mine = keys % np.uint64(WINDOW_EVERY) == 0
                chosen.append(at[mine])
                found.append(keys[mine] // np.uint64(WINDOW_EVERY))
            at = np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
            doc = np.searchsorted(off, at, "right") - 1
            inside = at + WINDOW_BYTES <= off[doc + 1]
            at, doc = at[inside], doc[inside]
            if len(at):
                keys = np.concatenate(found)[inside]
                yield from _send(keys, doc_keys.to_numpy()[doc], at - off[doc], buckets, SAMPLE_KEY_BYTES)

    return send


def _suffix_keys(length: int, buckets: int):
    v, _ = cover_for(length)

    def send(batches):
        for data, off, (doc_keys, places, runs) in _buffered(batches, ("doc_key", "pos", "run"), SUFFIX_BATCH_BYTES):
            n = np.diff(off)
            near = np.zeros(len(data) + 1, np.int64)
            for i, (p, r) in enumerate(zip(places.to_pylist(), runs.to_pylist(), strict=True)):
                p = _places(p, r)
                np.add.at(near, off[i] + np.maximum(0, p - v + 1), 1)
                np.add.at(near, off[i] + np.minimum(p + 1, n[i]), -1)
            at = np.flatnonzero(np.cumsum(near[:-1]) > 0)
            doc = np.searchsorted(off, at, "right") - 1
            fits = at + length <= off[doc + 1]
            at, doc = at[fits], doc[fits]
            if len(at):
                keys = span_hash(prefix_hash(BYTE_VALUE[data]), at, at + length)
                yield from _send(keys, doc_keys.to_numpy()[doc], at - off[doc], buckets, SUFFIX_KEY_BYTES)

    return send


def _places(pos: bytes, run: bytes) -> np.ndarray:
    p, r = _blob(pos), _blob(run)
    return np.repeat(p, r) + (np.arange(r.sum()) - np.repeat(np.cumsum(r) - r, r))


def _anchor(told_by: int):
    @F.arrow_udf("long")
    def anchor(text: pa.Array, pos: pa.Array, run: pa.Array) -> pa.Array:
        """The least hash of the windows inside the repeated samples' bytes: the same in documents that share most of them."""
        out = []
        width = min(ANCHOR_BYTES, told_by)
        for t, p, r in zip(text, pos, run, strict=True):
            data = np.frombuffer(t.as_buffer(), np.uint8)
            p = _places(p.as_py(), r.as_py())
            edge = np.zeros(len(data) + 1, np.int64)
            np.add.at(edge, p, 1)
            np.add.at(edge, p + told_by - width + 1, -1)
            at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            out.append(int(span_hash(prefix_hash(BYTE_VALUE[data]), at, at + width).min() >> np.uint64(1)))
        return pa.array(out, pa.int64())

    return anchor


def _key() -> Column:
    return F.xxhash64("doc_id", F.lit(0), "text")


def repeated_spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_key, pos, run: for each document (by the hash of doc_id and text) with a string of ``length`` bytes that also
    starts elsewhere, where such strings start (blobs of first places and of how many follow one another)."""
    small_batches(docs.sparkSession)
    v, cover = cover_for(length)
    size = _bytes_of(docs)
    keyed = docs.select(_key().alias("doc_key"), "text").where(F.octet_length("text") >= length)
    # The number of buckets follows the bytes of text.
    sent = keyed.mapInArrow(_sample_keys(length, max(1, size * len(cover) // v // BUCKET_KEYS)), SENT)
    homes = max(1, size // HOME_BYTES)
    near = staged(_again(sent, SAMPLE_KEY_BYTES, homes), "sample-ranks")
    # Only texts with a repeated sample go on; the ids travel where they are few, else the texts are joined.
    some = keyed.join(F.broadcast(near.select("doc_key")), "doc_key", "left_semi") if near.count() <= BROADCAST_IDS else keyed
    anchored = some.join(near, "doc_key").withColumn("anchor", _anchor(length - v + 1)("text", "pos", "run"))
    together = anchored.hint("rebalance", "anchor").sortWithinPartitions("anchor")
    sent = together.select("doc_key", "text", "pos", "run").mapInArrow(_suffix_keys(length, max(1, size // 5 // BUCKET_KEYS)), SENT)
    repeats = staged(_again(sent, SUFFIX_KEY_BYTES, homes), "repeats")
    discard(near)
    return repeats


def repeated_windows(docs: DataFrame) -> DataFrame:
    """doc_key, n_windows: for each document that has any, how many of its windows (WINDOW_BYTES; one of WINDOW_EVERY, chosen by their hash,
    so the same in any document) stand at another place too."""
    size = _bytes_of(docs)
    keyed = docs.select(_key().alias("doc_key"), "text").where(F.octet_length("text") >= WINDOW_BYTES)
    sent = keyed.mapInArrow(_window_keys(max(1, size // WINDOW_EVERY // BUCKET_KEYS)), SENT)
    found = _again(sent, SAMPLE_KEY_BYTES, max(1, size // HOME_BYTES))

    @F.arrow_udf("long")
    def places(run: pa.Array) -> pa.Array:
        return pa.array([int(_blob(r).sum()) for r in run.to_pylist()], pa.int64())

    return staged(found.select("doc_key", places("run").alias("n_windows")), "windows")


def _bytes_of(docs: DataFrame) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


#: Up to this many ids (8 bytes each) go to every executor.
BROADCAST_IDS = 4 << 20


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """``docs`` (doc_id, text and any others) with kept (binary), n_bytes, n_removed, spans (start0, end0, start1, ...) and n_windows.

    Texts are UTF-8 bytes (null: empty). Every byte goes that a string of ``length`` bytes covers which starts at a second place
    too, in the same or another row; strings overlap, and are told on the texts as they are. So repeated rows and equal
    texts of ``length`` bytes or more lose all. ``kept`` may cut characters in two. n_windows tells of shorter passages that repeat:
    repeated_windows() of the document, about the bytes of such passages beyond the first WINDOW_BYTES of each, divided by WINDOW_EVERY.
    An empty table gives no rows; a text of any length is told as a whole. Columns with these names are replaced.
    """
    names = ["kept", "n_bytes", "n_removed", "spans", "n_windows"]
    windows, repeats = repeated_windows(docs), repeated_spans(docs, length)
    rest = docs.drop(*names)
    key, pos, run, told = (unused(rest, c) for c in ("_key", "_pos", "_run", "_told"))
    repeats, windows = repeats.toDF(key, pos, run), windows.toDF(key, "n_windows")
    keyed = rest.withColumn(key, _key())
    whole = F.coalesce("text", F.lit("")).cast("binary")

    @F.arrow_udf("struct<kept:binary,spans:array<int>>")
    def cut(text: pa.Array, pos: pa.Array, run: pa.Array) -> pa.Array:
        kept, spans = [], []
        for t, p, r in zip(text, pos.to_pylist(), run.to_pylist(), strict=True):
            data = np.frombuffer((t.as_py() or "").encode(), np.uint8)
            p, r = _blob(p), _blob(r)
            edge = np.zeros(len(data) + 1, np.int64)
            np.add.at(edge, p, 1)
            np.add.at(edge, np.minimum(p + r - 1 + length, len(data)), -1)
            gone = np.cumsum(edge[:-1]) > 0
            turn = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
            spans.append(np.stack([np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)], 1).ravel().tolist())
            kept.append(data[~gone].tobytes())
        return pa.StructArray.from_arrays([pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.int32()))], ["kept", "spans"])

    def finished(df: DataFrame, kept: Column, spans: Column) -> DataFrame:
        out = df.withColumns({"kept": kept, "spans": spans, "n_bytes": F.octet_length(whole).cast("long")})
        return out.withColumn("n_removed", F.col("n_bytes") - F.octet_length("kept")).select(*keyed.columns, *names[:-1])

    none = F.array().cast("array<int>")
    if repeats.count() <= BROADCAST_IDS:
        ids = F.broadcast(repeats.select(key))
        hit = keyed.join(ids, key, "left_semi").join(repeats, key).withColumn(told, cut("text", pos, run))
        out = finished(keyed.join(ids, key, "left_anti"), whole, none).unionByName(finished(hit, F.col(told)["kept"], F.col(told)["spans"]))
    else:
        joined = keyed.join(repeats, key, "left").withColumn(told, cut("text", pos, run))
        out = finished(joined, F.col(told)["kept"], F.col(told)["spans"])
    few = F.broadcast(windows) if windows.count() <= BROADCAST_IDS else windows
    return out.join(few, key, "left").select(*rest.columns, *names[:-1], F.coalesce("n_windows", F.lit(0)).alias("n_windows"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes that start twice leave all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove_repeats(docs)
    return out.select("doc_id", "n_bytes", "n_removed", F.expr("size(spans) div 2").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_windows")
