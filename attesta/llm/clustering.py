"""Centroid clustering by delta Lloyd: assignments and sums persist, rounds handle what changed.

Components are integers, so sums, centroids and distances are exact, whatever the order in which tasks finish.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged, table

#: Components of at most this size have squared distances of 64 components, and sums of 2^36 vectors, in 64 bits.
MOST_COMPONENT = 1 << 27
CLUSTERS, ROUNDS, DIMENSIONS, SCALE = 8, 10, 64, 1024
NOBODY = -1


@dataclass
class Clusters:
    """``assigned``: id, cluster, distance, a row for each kept vector; ``centroids``: one row of integers for each cluster."""

    assigned: DataFrame
    centroids: np.ndarray


def grid_vectors(vectors: DataFrame, id_column: str, vector_column: str, dimensions: int, scale: int) -> DataFrame:
    """id, x: the vectors with ``dimensions`` components, none null or non-finite, each as floor(scale * component).

    A component beyond MOST_COMPONENT is an error, as its distances would not fit.
    """
    v = F.col(vector_column).cast("array<double>")
    finite = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    kept = vectors.where(F.coalesce((F.size(v) == dimensions) & finite, F.lit(False)))
    fits = F.forall(F.col("x"), lambda c: F.abs(c) <= MOST_COMPONENT)
    checked = F.when(fits, F.col("x").cast("array<int>")).otherwise(F.raise_error(F.lit(f"a component is over {MOST_COMPONENT} in size")).cast("array<int>"))
    return kept.select(F.col(id_column).alias("id"), F.transform(v, lambda c: F.floor(c * scale)).alias("x")).select("id", checked.alias("x"))


def first_centroids(grid: DataFrame, k: int, salt: str, dimensions: int) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``salt``:id, in this order (equal ids: by components; null ids last)."""
    order = F.sha2(F.concat(F.lit(salt + ":"), F.col("id").cast("string")), 256).asc_nulls_last()
    rows = grid.orderBy(order, "x").limit(k).select("x").collect()
    return np.array([r.x for r in rows], np.int64).reshape(len(rows), dimensions)


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.int64)


def _distances(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    return np.square(x - centroid).sum(axis=1)


def reassigned(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each vector and its squared distance; ties go to the smaller number.

    Where the owner stands still, only changed centroids can come nearer; where it moved, all are compared.
    """
    owner, distance = owner.copy(), distance.copy()
    loose = (owner == NOBODY) | changed[owner]
    owner[loose], distance[loose] = len(centroids), np.iinfo(np.int64).max
    for c, centroid in enumerate(centroids):
        asked = np.arange(len(x)) if changed[c] else np.flatnonzero(loose)
        if not len(asked):
            continue
        d = _distances(x[asked], centroid)
        nearer = (d < distance[asked]) | ((d == distance[asked]) & (c < owner[asked]))
        owner[asked[nearer]], distance[asked[nearer]] = c, d[nearer]
    return owner, distance


def _round(state: DataFrame, centroids: np.ndarray, changed: np.ndarray) -> DataFrame:
    """The state after one comparison; was: the owner before it."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            was = batch.column("owner").to_numpy()
            owner, distance = reassigned(_vectors(batch), was, batch.column("distance").to_numpy(), centroids, changed)
            columns = [batch.column("id"), batch.column("x"), pa.array(owner, pa.int32()), pa.array(distance), pa.array(was, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "x", "owner", "distance", "was"])

    kind = state.schema["id"].dataType.simpleString()
    return state.mapInArrow(assign, f"id {kind}, x array<int>, owner int, distance long, was int")


def transfers(state: DataFrame, k: int, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """What each cluster gains and loses (vectors, and sums of components) by the vectors whose owner changed.

    Each task sends at most 2 ``k`` rows a batch, so the shuffle doesn't grow with a large cluster; ``k`` rows come back.
    """

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, owner, was = _vectors(batch), batch.column("owner").to_numpy(), batch.column("was").to_numpy()
            for sign, who in ((1, owner), (-1, was)):
                for c in np.unique(who[who != NOBODY]):
                    rows = x[who == c]
                    values = pa.array((sign * rows.sum(axis=0)).tolist(), pa.int64())
                    whole = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([sign * len(rows)], pa.int64()), whole], ["cluster", "n", "sums"])

    parts = state.where("owner <> was").select("x", "owner", "was").mapInArrow(moved, "cluster int, n long, sums array<long>")
    counts, sums = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)
    whole = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(dimensions))).alias("sums"))
    for row in whole.collect():
        counts[row.cluster], sums[row.cluster] = row.n, row.sums
    return counts, sums


def delta_lloyd(
    vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, id_column: str = "vec_id", vector_column: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE, salt: str = "3"
) -> Clusters:
    """``rounds`` rounds of k-means on integers, and a last assignment.

    Each vector keeps its owner and its distance in a table of the shared folder, the driver keeps ``k`` centroids and
    sums. A round compares vectors whose owner moved with all centroids and the others with moved centroids only; the
    vectors that change hands are summed, with signs, into the sums. A round costs one pass over the table and no shuffle
    but of the transfers; once no centroid moves, the remaining rounds would change nothing and are left out.
    The table before is deleted when the next one is written.

    Vectors that are null, of another length, or hold null or non-finite components have no row. Repeated rows are
    vectors of their own; of equal distances the smaller cluster wins; an empty cluster keeps its centroid. Fewer than ``k``
    vectors make fewer clusters, none an empty result. Other columns are not read, so their names can't clash.
    """
    grid = grid_vectors(vectors, id_column, vector_column, dimensions, scale)
    state = staged(grid.select("id", "x", F.lit(NOBODY).alias("owner"), F.lit(0).cast("long").alias("distance"), F.lit(NOBODY).alias("was")), "clusters")
    centroids = first_centroids(state, k, salt, dimensions)
    counts, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dimensions), np.int64)
    changed = np.ones(len(centroids), bool)
    for n in range(rounds + 1):
        if not changed.any():
            break
        after = staged(_round(state, centroids, changed), "clusters")
        discard(state)
        state = after
        if n < rounds:
            gained, added = transfers(state, len(centroids), dimensions)
            counts, sums = counts + gained, sums + added
            means = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)
            changed, centroids = (means != centroids).any(axis=1), means
    return Clusters(state.select("id", F.col("owner").alias("cluster"), "distance"), centroids)


def with_inertia(found: Clusters) -> DataFrame:
    """id, cluster, distance with cluster_inertia, inertia and the sha256 of the centroid's components, joined by commas.

    Sums and centroids are one row a cluster, so they are broadcast.
    """
    spark = found.assigned.sparkSession
    names = spark.createDataFrame([(i, ",".join(map(str, c))) for i, c in enumerate(found.centroids.tolist())], "cluster int, components string")
    totals = found.assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = totals.agg(F.sum("cluster_inertia").alias("inertia"))
    per_cluster = totals.join(F.broadcast(whole), F.lit(True)).join(F.broadcast(names), "cluster")
    return found.assigned.join(F.broadcast(per_cluster.withColumn("centroid_sha256", F.sha2("components", 256)).drop("components")), "cluster")


def op13_centroid_clusters(spark, sf_dir):
    rows = with_inertia(delta_lloyd(table(spark, sf_dir, "embeddings")))
    return rows.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql_round(n: int) -> str:
    """The assignment to the centroids after n rounds, and the centroids after one more."""
    apart = "list_sum(list_transform(range(1, 65), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT"
    return f"""a{n} AS MATERIALIZED (SELECT row_no, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM (SELECT row_no, cluster, {apart} AS d FROM kept, c{n}) GROUP BY row_no),
m{n} AS (SELECT cluster, i, floor_div(sum(v)::BIGINT, count(*)) AS v FROM (SELECT cluster, unnest(x)::BIGINT AS v, generate_subscripts(x, 1) AS i FROM a{n} JOIN kept USING (row_no)) GROUP BY cluster, i),
c{n + 1} AS MATERIALIZED (SELECT cluster, coalesce(new, c) AS c FROM c{n} LEFT JOIN (SELECT cluster, list(v ORDER BY i) AS new FROM m{n} GROUP BY cluster) USING (cluster))"""


def _op13_sql() -> str:
    floor_div = lambda s: s.replace("floor_div(sum(v)::BIGINT, count(*))", "((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT")
    steps = ",\n".join(floor_div(_sql_round(n)) for n in range(ROUNDS + 1))
    return f"""WITH kept AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY vec_id, x) AS row_no, x FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda c: floor(1024 * c)::BIGINT) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = 64)),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, x) - 1)::INTEGER AS cluster, x AS c FROM (SELECT sha256('3:' || vec_id) AS h, x FROM kept ORDER BY h, x LIMIT {CLUSTERS})),
{steps}
SELECT vec_id, cluster, d AS distance, (sum(d) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN kept USING (row_no) JOIN c{ROUNDS} USING (cluster)"""


OP13_SQL = _op13_sql()
