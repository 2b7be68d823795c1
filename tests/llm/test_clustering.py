"""Delta Lloyd against whole rounds over all vectors, in Python's integers."""

from __future__ import annotations

import hashlib
import math

import duckdb
import numpy as np
import pytest

from attesta.llm import clustering
from attesta.llm.clustering import OP13_SQL, delta_lloyd, op13_centroid_clusters, reassigned

DATA = "/root/testdata/sf0.001"


def brute(rows, k, rounds, scale=1024, size=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((apart(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        owners = [nearest(v)[1] for _, v in kept]
        for c in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, owners) if o == c]
            if mine:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted((i, nearest(v)[1], nearest(v)[0]) for i, v in kept), centroids


@pytest.mark.parametrize("rounds", [0, 1, 10])
@pytest.mark.parametrize("n", [0, 3, 150])
def test_same_as_whole_rounds(spark, n, rounds):
    rng = np.random.default_rng(n + rounds)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(n)]
    if n > 3:
        rows += [(900, None), (901, [1.0] * 5), (902, [1.0] * 5 + [None]), (903, [float("nan")] * 6), (904, [float("inf")] + [0.0] * 5), (905, []), rows[0], rows[0], (906, [0.0] * 6), (907, [50_000.0] * 6)]
    vectors = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, owner int, distance string").repartition(3)
    found = delta_lloyd(vectors, k=5, rounds=rounds, dimensions=6)
    expected, centroids = brute(rows, 5, rounds, size=6)
    assert sorted(tuple(r) for r in found.assigned.collect()) == expected
    assert found.centroids.tolist() == centroids


def test_equal_distances_go_to_the_smaller_cluster():
    x = np.array([[0, 0], [2, 0]])
    centroids = np.array([[1, 0], [1, 0], [-1, 0]])
    owner, distance = reassigned(x, np.full(2, -1), np.zeros(2, np.int64), centroids, np.ones(3, bool))
    assert owner.tolist() == [0, 0] and distance.tolist() == [1, 1]


def test_standing_owners_are_compared_with_changed_centroids_only(monkeypatch):
    asked = []
    monkeypatch.setattr(clustering, "_distances", lambda x, c, f=clustering._distances: asked.append(len(x)) or f(x, c))
    x = np.arange(20).reshape(10, 2)
    centroids = np.array([[0, 0], [10, 10], [19, 19]])
    owner, distance = reassigned(x, np.full(10, -1), np.zeros(10, np.int64), centroids, np.ones(3, bool))
    asked.clear()
    centroids[2] = [16, 17]
    after, _ = reassigned(x, owner, distance, centroids, np.array([False, False, True]))
    moved = int((owner == 2).sum())
    assert asked == [moved, moved, 10] and after.tolist() == np.square(x[:, None] - centroids).sum(2).argmin(1).tolist()


def test_components_that_do_not_fit_are_an_error(spark):
    with pytest.raises(Exception, match="in size"):
        delta_lloyd(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>"), dimensions=2)


def test_query_gives_what_sql_gives(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as from read_parquet('{DATA}/embeddings.parquet')")
    ours, theirs = op13_centroid_clusters(spark, DATA).toPandas(), con.sql(OP13_SQL).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    key = sorted(ours.columns)
    assert sorted(map(str, ours[key].values.tolist())) == sorted(map(str, theirs[key].values.tolist()))
