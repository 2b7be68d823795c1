"""Commits of replaced buckets, and what readers see when one fails."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from attesta.operators import importing
from attesta.operators.tables import BucketedTable, CommitConflict

SCHEMA = "claim_id long, ref_id long, score double"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def table(spark, tmp_path):
    return BucketedTable(spark, str(tmp_path / "recommendations"), buckets=8)


def first(spark, n=100):
    return spark.range(n).select(F.col("id").alias("claim_id"), (F.col("id") % 7).alias("ref_id"), F.lit(0.5).alias("score"))


def test_replaced_rows_are_those_of_frames(spark, table):
    old = first(spark)
    assert table.replace(old.select("claim_id"), old) == 1
    prepared = spark.createDataFrame([(1,), (2,), (3,), (500,), (1,)], "claim_id long")
    new = spark.createDataFrame([(1, 9, 1.0), (1, 8, 0.9), (500, 1, 0.1)], SCHEMA)
    assert table.replace(prepared, new) == 2
    assert rows_of(table.read()) == rows_of(importing.replaced(old, prepared, new))
    assert rows_of(table.read(1)) == rows_of(old)


def test_only_the_buckets_of_prepared_claims_are_written(spark, table):
    table.replace(first(spark).select("claim_id"), first(spark))
    before = table._manifest()["buckets"]
    table.replace(spark.createDataFrame([(5,)], "claim_id long"), spark.createDataFrame([], SCHEMA))
    after = table._manifest()["buckets"]
    assert sum(before[b] != after.get(b) for b in before) == 1 and table.read().where("claim_id = 5").count() == 0 and table.read().count() == 99


def test_inserted_rows_ignore_what_is_there(spark, table):
    table.insert(first(spark, 10), ["claim_id", "ref_id"])
    more = spark.createDataFrame([(1, 1, 9.0), (1, 2, 9.0), (77, 1, 9.0), (77, 1, 9.0)], SCHEMA)
    table.insert(more, ["claim_id", "ref_id"])
    assert rows_of(table.read()) == rows_of(importing.upsert_ignore(first(spark, 10), more, ["claim_id", "ref_id"]))
    with pytest.raises(ValueError, match="claim_id"):
        table.insert(more, ["ref_id"])


def test_a_task_that_dies_after_writing_leaves_the_old_rows(spark, table):
    old = first(spark)
    table.replace(old.select("claim_id"), old)

    def dying(batches):
        for batch in batches:
            yield batch.assign(score=9.0)
        if (batch.claim_id == 42).any():
            raise RuntimeError("lost after its rows were written")

    new = old.repartition(4).mapInPandas(dying, SCHEMA)
    with pytest.raises(Exception, match="lost after"):
        table.replace(old.select("claim_id"), new)
    assert rows_of(table.read()) == rows_of(old) and table.versions() == [1]
    assert len(os.listdir(f"{table.path}/data")) == 1


def test_a_driver_that_dies_before_the_commit_leaves_the_old_rows(spark, table, monkeypatch):
    old = first(spark)
    table.replace(old.select("claim_id"), old)
    monkeypatch.setattr(table, "_publish", lambda manifest: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        table.replace(old.select("claim_id"), old.withColumn("score", F.lit(9.0)))
    again = BucketedTable(spark, table.path, buckets=8)
    assert rows_of(again.read()) == rows_of(old)
    assert again.replace(old.select("claim_id"), old.withColumn("score", F.lit(7.0))) == 2 and again.read().where("score <> 7").count() == 0


def test_of_two_writers_the_later_one_fails(spark, table):
    old = first(spark)
    table.replace(old.select("claim_id"), old)
    stale = table._manifest()
    table.replace(old.select("claim_id"), old.withColumn("score", F.lit(1.0)))
    with pytest.raises(CommitConflict):
        table._committed(stale, old, list(range(8)), append=False)
    assert table.read().where("score <> 1").count() == 0 and len(os.listdir(f"{table.path}/data")) == 2


def test_nothing_committed(spark, table):
    with pytest.raises(ValueError, match="nothing was committed"):
        table.read()
    table.insert(spark.createDataFrame([], SCHEMA), ["claim_id"])
    assert table.read().count() == 0
