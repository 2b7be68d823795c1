"""Connected components of a graph of links, by contraction with DataFrame joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By node 0 to n - 1, the smallest node that the links a-b reach."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while not np.array_equal(deeper := label[label], label):
            label = deeper
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def _forests(batches):
    """The links of each batch as stars: as many rows as nodes at most, the same components."""
    for batch in batches:
        nodes, ends = np.unique(np.concatenate([batch.column(c).to_numpy() for c in ("a", "b")]), return_inverse=True)
        label = local_labels(len(nodes), *np.split(ends, 2))
        far = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[label[far]]), pa.array(nodes[far])], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """node, root: for each node of ``edges`` (a, b, longs) a node that stands for its component.

    In each round every node joins the one with the least random rank among itself, its neighbours and theirs, and the
    graph shrinks to the nodes joined to: a star goes in one round, any graph in about the logarithm of its
    nodes. No task has the neighbours of a node in memory. Rows with a null or with a = b are no links. Each round is written to the
    shared folder.
    """
    edges = staged(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInArrow(_forests, "a long, b long"), "links")
    roots, rnd = None, 0
    while not edges.isEmpty():
        rank = lambda x, r=rnd: F.xxhash64(F.lit(r), x)
        either = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("u")))
        ranked = lambda x: F.struct(rank(F.col(x)).alias("rank"), F.col(x).alias("node"))
        near = staged(either.groupBy("v").agg(F.min(ranked("u")).alias("u")).select("v", F.least(ranked("v"), "u").alias("least")), "nearest")
        joined = staged(either.join(near.select(F.col("v").alias("u"), "least"), "u").groupBy("v").agg(F.min("least").alias("to")).select("v", F.col("to.node").alias("to")), "joined")
        if roots is None:
            roots = joined.select(F.col("v").alias("node"), F.col("to").alias("root"))
        else:
            roots = staged(roots.join(joined, F.col("root") == F.col("v"), "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        to_a, to_b = joined.toDF("a", "to_a"), joined.toDF("b", "to_b")
        moved = edges.join(to_a, "a").join(to_b, "b").where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        edges = staged(moved.mapInArrow(_forests, "a long, b long").distinct(), "links")
        rnd += 1
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
