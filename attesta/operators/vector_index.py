"""An exact index of vectors: lists around centres, in blocks with a range of angles each.

By the triangle inequality no vector of a block is nearer to a query than the query's angle to the centre, less the
block's range, allows. So a search opens the most promising blocks first and leaves out those that cannot hold one of the
``k`` nearest, with the same result as comparing everything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import written_once

#: Vectors in a block; centres at most; bytes of the sample that the centres are fitted on, and of the centres.
BLOCK, LISTS, SAMPLE_BYTES, CENTRE_BYTES = 1024, 4096, 16 << 20, 8 << 20
FITTING_ROUNDS = 8
#: Claims that meet a block in one row; blocks that a claim opens in the first round, and how many times more in each next one.
CLAIMS_AT_ONCE, FIRST_BLOCKS, GROWTH = 512, 8, 16
#: Similarities have 9 decimals; bounds get as much slack.
SLACK = 2e-9


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: neither null nor empty nor zero, without null or non-finite components."""
    finite = F.forall(vector, lambda x: F.coalesce((x == x) & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def usual_length(vectors: DataFrame) -> tuple[int, int]:
    """The length that most usable vectors have, the shortest of equally frequent ones, and how many have it; (0, 0) where there are none."""
    counts = vectors.where(usable(F.col("vector"))).groupBy(F.size("vector").alias("size")).count()
    first = counts.orderBy(F.desc("count"), "size").first()
    return (first["size"], first["count"]) if first else (0, 0)


def directions(values: np.ndarray, dimensions: int) -> np.ndarray:
    x = values.reshape(-1, dimensions)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def best_of(names: pa.Array, refs: pa.Array, similar: np.ndarray, k: int) -> pa.RecordBatch:
    """Each row's ``k`` most similar columns, and all that are as similar as the last of them."""
    at = min(k, similar.shape[1]) - 1
    least = -np.partition(-similar, at, axis=1)[:, at]
    row, col = np.nonzero((similar >= least[:, None]) & (similar > -np.inf))
    return pa.RecordBatch.from_arrays([names.take(pa.array(row)), refs.take(pa.array(col)), pa.array(similar[row, col])], ["claim_id", "ref_id", "semantic"])


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.floor(q @ x.T * 1e9 + 0.5) / 1e9


def nearest_first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("claim_id").orderBy(F.desc("semantic"), "ref_id")
    return found.withColumn("vector_rank", F.row_number().over(order)).where(F.col("vector_rank") <= k)


def fitted_centres(sample: np.ndarray, lists: int) -> np.ndarray:
    """``lists`` unit vectors that the directions of ``sample`` gather around (Lloyd's rounds on cosines)."""
    if not len(sample):
        return np.eye(1, sample.shape[1])
    centres = sample[np.linspace(0, len(sample) - 1, min(lists, len(sample))).astype(int)]
    for _ in range(FITTING_ROUNDS):
        owner = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    return centres


@dataclass
class VectorIndex:
    """``blocks``: block_id, list, low, high (angles to the list's centre), n, newest, ref_ids, vectors, years; ``centres`` by list."""

    blocks: DataFrame
    centres: np.ndarray

    @property
    def dimensions(self) -> int:
        return self.centres.shape[1]

    @staticmethod
    def build(papers: DataFrame, dimensions: int | None = None, block: int = BLOCK) -> VectorIndex:
        """The index of ``papers`` (ref_id, vector and, where they have it, year).

        Centres, about the root of the number of vectors, are fitted on a sample of at most SAMPLE_BYTES (those with the
        smallest hashes of ref_id); every vector is indexed. Only usable() vectors of length ``dimensions`` (by default the
        usual one) are. A list is cut at equal ranges of angles, so that no task or block grows with it.
        """
        spark = papers.sparkSession
        usual, n = usual_length(papers if dimensions is None else papers.where(F.size("vector") == dimensions))
        dims = dimensions or usual
        year = F.col("year").cast("int") if "year" in papers.columns else F.lit(None).cast("int")
        rows = papers.where(usable(F.col("vector")) & (F.size("vector") == dims)).select("ref_id", F.col("vector").cast("array<double>").alias("vector"), year.alias("year"))
        lists = int(max(1, min(LISTS, CENTRE_BYTES // (8 * max(dims, 1)), np.ceil(np.sqrt(n)))))
        taken = rows.select("vector", F.xxhash64("ref_id").alias("h")).orderBy("h", "vector").limit(max(lists, SAMPLE_BYTES // (8 * max(dims, 1)))).collect()
        sample = directions(np.array([r.vector for r in taken], np.float64).reshape(-1, max(dims, 1)), max(dims, 1))
        index = VectorIndex(spark.createDataFrame([], _block_schema(papers)), fitted_centres(sample, lists))
        return VectorIndex(written_once(index._blocks_of(rows, block, 0), "vector-index"), index.centres)

    def added(self, papers: DataFrame, block: int = BLOCK) -> VectorIndex:
        """The index with more papers, in blocks of their own around the same centres."""
        year = F.col("year").cast("int") if "year" in papers.columns else F.lit(None).cast("int")
        rows = papers.where(usable(F.col("vector")) & (F.size("vector") == self.dimensions)).select("ref_id", F.col("vector").cast("array<double>").alias("vector"), year.alias("year"))
        generation = ((self.blocks.agg(F.max("block_id")).first()[0] or 0) >> 46) + 1
        return VectorIndex(self.blocks.unionByName(written_once(self._blocks_of(rows, block, generation), "vector-index")), self.centres)

    def write(self, path: str) -> None:
        self.blocks.write.parquet(f"{path}/blocks")
        rows = [(i, c) for i, c in enumerate(self.centres.tolist())]
        self.blocks.sparkSession.createDataFrame(rows, "list int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")

    @staticmethod
    def open(spark: SparkSession, path: str) -> VectorIndex:
        centres = spark.read.parquet(f"{path}/centres").orderBy("list").collect()
        return VectorIndex(spark.read.parquet(f"{path}/blocks"), np.array([r.centre for r in centres], np.float64))

    def _blocks_of(self, rows: DataFrame, size: int, generation: int) -> DataFrame:
        spark, kind = rows.sparkSession, rows.schema["ref_id"].dataType.simpleString()
        held = spark.sparkContext.broadcast(self.centres)
        dims = self.dimensions

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cos = directions(batch.column("vector").flatten().to_numpy(), dims) @ held.value.T
                    owner = cos.argmax(axis=1)
                    angle = np.arccos(np.clip(cos[np.arange(len(owner)), owner], -1, 1))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(owner, pa.int32()), pa.array(angle)], [*batch.schema.names, "list", "angle"])

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # Rows come in order of list and angle; a block ends with its list, its size or its batch.
            made = 0
            for batch in batches:
                owner = batch.column("list").to_numpy()
                starts = [0, *(np.flatnonzero(np.diff(owner)) + 1).tolist(), len(owner)] if len(owner) else []
                for a, b in zip(starts, starts[1:]):
                    for first in range(a, b, size):
                        part = batch.slice(first, min(size, b - first))
                        angle, years = part.column("angle").to_numpy(), part.column("year")
                        newest = max((y for y in years.to_pylist() if y is not None), default=None)
                        whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                        block_id = (generation << 46) + (TaskContext.get().partitionId() << 24) + made
                        made += 1
                        flat = [[block_id], [int(owner[first])], [angle[0]], [angle[-1]], [len(angle)], [newest]]
                        kinds = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.int32()]
                        lists = [whole(part.column("ref_id")), whole(part.column("vector").flatten()), whole(years)]
                        yield pa.RecordBatch.from_arrays([*(pa.array(v, k) for v, k in zip(flat, kinds)), *lists], [f.name for f in _BLOCK] + ["ref_ids", "vectors", "years"])

        placed = rows.mapInArrow(place, f"ref_id {kind}, vector array<double>, year int, list int, angle double")
        return placed.repartitionByRange("list", "angle", "ref_id").sortWithinPartitions("list", "angle", "ref_id").mapInArrow(cut, _block_schema(rows))

    def bounds(self, claims: DataFrame, min_year: int | None = None) -> DataFrame:
        """claim_id, block_id, bound: the most that the claim's similarity to a vector of the block can be."""
        held = claims.sparkSession.sparkContext.broadcast(self.centres)
        dims, kind = self.dimensions, claims.schema["claim_id"].dataType.simpleString()

        def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first in range(0, batch.num_rows, CLAIMS_AT_ONCE):
                    part = batch.slice(first, CLAIMS_AT_ONCE)
                    theta = np.arccos(np.clip(directions(part.column("vector").flatten().to_numpy(), dims) @ held.value.T, -1, 1))
                    row, col = np.indices(theta.shape)
                    yield pa.RecordBatch.from_arrays([part.column("claim_id").take(pa.array(row.ravel())), pa.array(col.ravel(), pa.int32()), pa.array(theta.ravel())], ["claim_id", "list", "theta"])

        directory = self.blocks.select("block_id", "list", "low", "high", "newest")
        if min_year is not None:
            directory = directory.where(F.col("newest") >= min_year)
        apart = F.greatest(F.lit(0.0), F.col("theta") - F.col("high"), F.col("low") - F.col("theta"))
        return claims.mapInArrow(angles, f"claim_id {kind}, list int, theta double").join(directory, "list").select("claim_id", "block_id", F.cos(apart).alias("bound"))

    def nearest(self, claims: DataFrame, k: int, min_year: int | None = None) -> tuple[DataFrame, DataFrame]:
        """claim_id, ref_id, semantic, vector_rank of each claim's ``k`` nearest papers, and claim_id, block_id of the blocks opened.

        In rounds: every claim opens its most promising blocks, more each time, until no unopened block could hold
        a paper as near as its ``k``-th. Papers older than ``min_year``, or without a year, are left out where it is given.
        """
        asked = written_once(claims.where(usable(F.col("vector")) & (F.size("vector") == self.dimensions)).select("claim_id", F.col("vector").cast("array<double>").alias("vector")), "claims")
        left = written_once(self.bounds(asked, min_year), "bounds")
        found = opened = None
        first = FIRST_BLOCKS
        while not left.isEmpty():
            order = Window.partitionBy("claim_id").orderBy(F.desc("bound"), "block_id")
            now = written_once(left.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= first).drop("_n", "bound"), "opened")
            new = self._compared(asked, now, k, min_year)
            found = written_once(nearest_first(new if found is None else found.drop("vector_rank").unionByName(new), k), "found")
            opened = now if opened is None else opened.unionByName(now)
            last = found.where(F.col("vector_rank") == k).select("claim_id", F.col("semantic").alias("_last"))
            rest = left.join(now, ["claim_id", "block_id"], "left_anti").join(last, "claim_id", "left")
            left = written_once(rest.where(F.col("_last").isNull() | (F.col("bound") >= F.col("_last") - SLACK)).drop("_last"), "bounds")
            first *= GROWTH
        if found is None:
            kinds = {n: df.schema[c].dataType.simpleString() for n, df, c in (("claim_id", claims, "claim_id"), ("block_id", self.blocks, "block_id"))}
            refs = self.blocks.schema["ref_ids"].dataType.elementType.simpleString()
            empty = lambda s: claims.sparkSession.createDataFrame([], s)
            return empty(f"claim_id {kinds['claim_id']}, ref_id {refs}, semantic double, vector_rank int"), empty(f"claim_id {kinds['claim_id']}, block_id long")
        return found, opened

    def _compared(self, claims: DataFrame, pairs: DataFrame, k: int, min_year: int | None) -> DataFrame:
        """claim_id, ref_id, semantic of the pairs (claim_id, block_id): each claim's ``k`` best of a block.

        Claims are packed by block, so many at a time that a block that all want is split over tasks.
        """
        kind, refs = claims.schema["claim_id"].dataType.simpleString(), self.blocks.schema["ref_ids"].dataType.elementType.simpleString()
        dims = self.dimensions

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for names, asked, ids, held, years in zip(*(batch.column(c) for c in ("claim_ids", "claim_vectors", "ref_ids", "vectors", "years"))):
                    names, ids = names.values, ids.values
                    similar = cosines(directions(asked.values.flatten().to_numpy(), dims), directions(held.values.to_numpy(), dims))
                    if min_year is not None:
                        similar[:, ~(years.values.fill_null(-1).to_numpy() >= min_year)] = -np.inf
                    yield best_of(names, ids, similar, k)

        salted = pairs.join(claims, "claim_id").join(pairs.groupBy("block_id").count(), "block_id")
        share = F.pmod(F.xxhash64("claim_id"), F.ceil(F.col("count") / CLAIMS_AT_ONCE)).alias("share")
        packed = salted.groupBy("block_id", share).agg(F.collect_list(F.struct("claim_id", "vector")).alias("c"))
        packed = packed.select("block_id", F.col("c.claim_id").alias("claim_ids"), F.col("c.vector").alias("claim_vectors"))
        return packed.join(self.blocks.select("block_id", "ref_ids", "vectors", "years"), "block_id").mapInArrow(compare, f"claim_id {kind}, ref_id {refs}, semantic double")


_BLOCK = [pa.field(n, k) for n, k in (("block_id", pa.int64()), ("list", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("n", pa.int64()), ("newest", pa.int32()))]


def _block_schema(papers: DataFrame) -> str:
    kind = papers.schema["ref_id"].dataType.simpleString()
    return f"block_id long, list int, low double, high double, n long, newest int, ref_ids array<{kind}>, vectors array<double>, years array<int>"
