"""Shared pieces of the training-data operators: tables, staging, byte-level text work.

The operators look at text as UTF-8 bytes in numpy arrays taken straight from Arrow
buffers, a few megabytes at a time, so a task needs memory for one slice (or for one
document, where a document is longer than a slice).
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: glibc's; other C libraries have none.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)

SLICE_BYTES = 1 << 18
#: Of text in one Arrow batch between Spark and Python. Spark's own limits, 10,000 rows and 64 MB, hold several copies
#: of tens of megabytes in the executor and in each Python worker.
ARROW_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches are of ARROW_BYTES, if they weren't smaller."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("bB")) > ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where the session names none, a local session gets a folder of its own; a cluster
    without one is an error, as its machines would not see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="attesta-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def names_apart(prefix: str):
    """For operators whose working columns begin with ``prefix``: the caller's columns that do so have other names meanwhile.

    Columns that are given to the operator as expressions must not be named like that.
    """

    def wrap(operator):
        @functools.wraps(operator)
        def run(rows: DataFrame, *args, **kwargs) -> DataFrame:
            clash = [c for c in rows.columns if c.lower().startswith(prefix)]
            if not clash:
                return operator(rows, *args, **kwargs)
            kept = {}
            for c in clash:
                name = "kept" + c
                while name.lower() in {x.lower() for x in rows.columns}:
                    name = "kept_" + name
                kept[c] = name
            return operator(rows.withColumnsRenamed(kept), *args, **kwargs).withColumnsRenamed({v: k for k, v in kept.items()})

        return run

    return wrap


def discard(*tables: DataFrame) -> None:
    """Delete tables that staged() wrote and that nothing reads any more."""
    for df in tables:
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


# ---- bytes and words -------------------------------------------------------------------

_RNG = np.random.default_rng(20240607)
#: A random 64-bit value for each byte; polynomial hashes run over these, modulo 2^64.
BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 2**64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing, and of `[^\x20\x09-\x0D]+`.
ALNUM_BYTES = np.zeros(256, bool)
ALNUM_BYTES[0x30:0x3A] = ALNUM_BYTES[0x61:0x7B] = ALNUM_BYTES[0x80:] = True
NON_SPACE_BYTES = np.ones(256, bool)
NON_SPACE_BYTES[0x20] = NON_SPACE_BYTES[0x09:0x0E] = False

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^0..BASE^n and the powers of its inverse, modulo 2^64."""
    if len(_powers.get("up", ())) <= n:
        size = max(n + 1, SLICE_BYTES + (1 << 17))
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p)
    return _powers["up"], _powers["down"]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of polynomial hashes (the low bits alone are weak)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] proportional to the hash of values[i:j]."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mixed((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, end to end, and where each row starts (one more at the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def give_back() -> None:
    """Hand freed memory of a Python worker back to the system: workers outlive their tasks, and an executor counts them all."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with at most ``most`` bytes of text (or one row), with their bytes and offsets."""
    data, off = utf8(batch.column(batch.schema.get_field_index(column)))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield batch.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j
    give_back()


def row_slices(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """As slices(), of a single column: first row, row after the last, bytes, offsets."""
    data, off = utf8(text)
    i = 0
    while i < len(text):
        j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE_BYTES, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j
    give_back()


def word_spans(data: np.ndarray, off: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of word bytes that lies in one row, and its row."""
    inside = word_bytes[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    cuts = off[(off > 0) & (off < len(data))]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[cuts - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_hash(BYTE_VALUE[data]), starts, ends)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k values that start at each value (none for the last k - 1)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    return span_hash(prefix_hash(words), at, at + k)


def found_in(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Index of each x in sorted_values, -1 where it is absent."""
    if not len(sorted_values):
        return np.full(len(x), -1, np.int64)
    at = np.searchsorted(sorted_values, x)
    at[at == len(sorted_values)] = 0
    return np.where(sorted_values[at] == x, at, -1)


def named_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
