"""Near-duplicate vectors by cosine: tiles in the order of the first principal axis.

Equal vectors become one class with a multiplicity. The classes, ordered along the first
principal axis, are cut into tiles of equal size; two tiles meet when their ranges on that
axis are near enough for any pair to reach the threshold. Where they meet, the products of
the leading axes are summed first and the rest is bounded by the norms of what is left of
each vector; pairs whose bound misses the threshold go, and a block without pairs stops.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import names_apart, staged, table
from .components import components, local_labels
from .sharding import balanced_shards

TILE = 2048
BLOCK = 256
STEPS = (8, 16, 32)
EPS = 1e-9

TILES = "tile int, cids binary, weights binary, vectors binary, low double, high double"
FOUND = "cid long, links long, to_cid long"


def _moments(dim: int):
    def add(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            x = _unit(_matrix(batch.column("embedding"), dim))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["moments"])

    return add


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    x = x / np.where(scale > 0, scale, 1)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def principal_axes(classes: DataFrame, dim: int) -> np.ndarray:
    """Columns: the axes of the unit vectors' second moments, largest first. One dim x dim matrix a task comes back."""
    parts = classes.select("embedding").mapInArrow(_moments(dim), "moments binary").toLocalIterator()
    total = np.zeros((dim, dim))
    for r in parts:
        total += np.frombuffer(r.moments).reshape(dim, dim)
    return np.linalg.eigh(total)[1][:, ::-1].copy()


def _blocks(za: np.ndarray, zb: np.ndarray, threshold: float):
    """Row, column of the pairs of two tiles whose cosine may reach the threshold, by blocks of rows of the first."""
    left = [(np.sqrt((za[:, k:] ** 2).sum(1)), np.sqrt((zb[:, k:] ** 2).sum(1))) for k in STEPS]
    for at in range(0, len(za), BLOCK):
        a = za[at : at + BLOCK]
        partial, done = np.zeros((len(a), len(zb))), 0
        for k, (ra, rb) in zip(STEPS, left, strict=True):
            partial += a[:, done:k] @ zb[:, done:k].T
            done = k
            alive = partial + ra[at : at + BLOCK, None] * rb >= threshold - EPS
            if not alive.any():
                break
            if alive.mean() < 0.02:  # few: the rest pair by pair
                break
        r, c = np.nonzero(alive)
        if len(r):
            whole = partial[r, c] + np.einsum("ij,ij->i", a[r, done:], zb[c, done:])
            near = whole >= threshold - EPS
            yield r[near] + at, c[near]


def _compare(dim: int, axes: np.ndarray, threshold: float):
    def links(x, y, r, c):
        """The cosine itself, of the vectors as they are given; pieces bound the memory."""
        keep = []
        for i in range(0, len(r), 1 << 16):
            a, b = x[r[i : i + (1 << 16)]], y[c[i : i + (1 << 16)]]
            keep.append(np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b)) >= threshold)
        return np.concatenate(keep) if keep else np.zeros(0, bool)

    def scaled(blob):
        x = np.frombuffer(blob).reshape(-1, dim)
        return x / np.abs(x).max(1, keepdims=True)

    def compare(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x, y = scaled(row["vectors"]), scaled(row["other_vectors"])
                same = row["tile"] == row["other_tile"]
                ia, ib = np.frombuffer(row["cids"], np.int64), np.frombuffer(row["other_cids"], np.int64)
                wa, wb = np.frombuffer(row["weights"], np.int64), np.frombuffer(row["other_weights"], np.int64)
                n_a, n_b = np.zeros(len(ia), np.int64), np.zeros(len(ib), np.int64)
                label = np.arange(len(ia) + (0 if same else len(ib)))
                shift = 0 if same else len(ia)
                for r, c in _blocks(_unit(x) @ axes, _unit(y) @ axes, threshold):
                    if same:
                        r, c = r[c > r], c[c > r]
                    ok = links(x, y, r, c)
                    r, c = r[ok], c[ok]
                    np.add.at(n_a, r, wb[c])
                    np.add.at(n_a if same else n_b, c, wa[r])
                    # A forest of the links so far stands for all of them.
                    label = local_labels(len(label), np.concatenate([np.arange(len(label)), r]), np.concatenate([label, c + shift]))
                nodes = ia if same else np.concatenate([ia, ib])
                counts = n_a if same else np.concatenate([n_a, n_b])
                hit = np.flatnonzero((counts > 0) | (label != np.arange(len(label))))
                yield pa.RecordBatch.from_arrays([pa.array(nodes[hit]), pa.array(counts[hit]), pa.array(nodes[label[hit]])], ["cid", "links", "to_cid"])

    return compare


def _found_links(classes: DataFrame, dim: int, threshold: float, tile: int) -> DataFrame:
    """cid, links (weighted by the other class), to_cid: for each class, once for each pair of tiles."""
    spark = classes.sparkSession
    axes = principal_axes(classes, dim)

    @F.arrow_udf("double")
    def first_axis(v: pa.Array) -> pa.Array:
        return pa.array(_unit(_matrix(v, dim)) @ axes[:, 0] if len(v) else np.zeros(0), pa.float64())

    n = classes.count()
    placed = balanced_shards(classes.withColumn("z", first_axis("embedding")), [F.col("z")], F.lit(1), max(1, -(-n // tile)))

    def gather(key, rows):
        x = np.array(rows.embedding.to_list(), np.float64).reshape(-1, dim)
        return pd.DataFrame({"tile": [key[0]], "cids": [rows.cid.to_numpy(np.int64).tobytes()], "weights": [rows.weight.to_numpy(np.int64).tobytes()], "vectors": [x.tobytes()], "low": [rows.z.min()], "high": [rows.z.max()]})

    tiles = staged(placed.select("shard", "cid", "weight", "embedding", "z").groupBy("shard").applyInPandas(gather, TILES), "tiles")
    # Three numbers a tile of 2048 classes: the driver finds for each tile the last one in reach.
    ranges = tiles.select("tile", "low", "high").orderBy("low", "tile").toPandas()
    reach = np.sqrt(max(0.0, 2 - 2 * threshold)) + EPS
    rank = np.arange(len(ranges))
    last = np.maximum(np.searchsorted(ranges.low.to_numpy(), ranges.high.to_numpy() + reach, "right") - 1, rank)
    ranked = F.broadcast(spark.createDataFrame(pd.DataFrame({"tile": ranges.tile.astype("int32"), "rank": rank.astype("int64"), "last": last.astype("int64")}), "tile int, rank long, last long"))
    left = tiles.join(ranked, "tile").withColumn("with", F.explode(F.sequence("rank", "last"))).select("tile", "cids", "weights", "vectors", "with")
    right = tiles.join(ranked, "tile").select(F.col("rank").alias("with"), F.col("tile").alias("other_tile"), *[F.col(c).alias(f"other_{c}") for c in ("cids", "weights", "vectors")])
    return left.join(right, "with").drop("with").mapInArrow(_compare(dim, axes, threshold), FOUND)


@names_apart("_nv_")
def near_vectors(vectors: DataFrame, threshold: float = 0.95, tile: int = TILE) -> DataFrame:
    """``vectors`` (with vec_id and embedding) with n_links, component_id and kept; columns of these names are replaced.

    n_links: other rows with a cosine of ``threshold`` or more; component_id: the smallest vec_id that links reach;
    kept: whether that is the row's own. Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing and stay. Vectors of unequal lengths don't link; each length is a job of its own. Repeated rows link
    with each other. A row without a vec_id counts and links, but names no component.
    """
    usable = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    vectors = vectors.drop("n_links", "component_id", "kept")
    rows = vectors.withColumn("_nv_key", F.when(usable, F.col("embedding")))
    classes = rows.where("_nv_key is not null").groupBy(F.col("_nv_key").alias("embedding")).agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"))
    classes = staged(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    found = None
    for r in classes.select(F.size("embedding").alias("dim")).distinct().collect():
        some = _found_links(classes.where(F.size("embedding") == r.dim), r.dim, threshold, tile)
        found = some if found is None else found.unionByName(some)
    if found is None:
        return rows.drop("_nv_key").withColumns({"n_links": F.lit(0).cast("long"), "component_id": F.col("vec_id"), "kept": F.lit(True)})
    found = staged(found, "vector-links")
    roots = components(found.select(F.col("cid").alias("a"), F.col("to_cid").alias("b")))
    rooted = classes.join(roots, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    told = rooted.join(least, "root").join(links, "cid", "left").select(F.col("embedding").alias("_nv_key"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = rows.join(told, "_nv_key", "left").drop("_nv_key")
    own = F.coalesce("component_id", "vec_id")
    return out.withColumns({"n_links": F.coalesce("n_links", F.lit(0).cast("long")), "component_id": own, "kept": F.coalesce(own == F.col("vec_id"), F.lit(True))})


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors, linked at a cosine of 0.95."""
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select("vec_id", "n_links", "component_id", "kept")


#: Links by all pairs, components by repeated relaxation.
OP8_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS x, vec_id AS c FROM v UNION SELECT p.x, r.c FROM r JOIN p ON p.y = r.x WHERE r.c < p.x),
c AS (SELECT x, min(c) AS c FROM r GROUP BY x)
SELECT v.vec_id, (SELECT count(*) FROM p WHERE p.x = v.vec_id) AS n_links, c.c AS component_id, c.c = v.vec_id AS kept
FROM v JOIN c ON c.x = v.vec_id
"""
