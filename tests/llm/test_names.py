"""Columns of the caller that are named like an operator's working columns come through."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from attesta.llm import embeddings, linededup, packing, pii, quality, sharding
from attesta.llm.clustering import delta_lloyd
from attesta.llm.runs import with_runs


def docs(spark):
    rows = [(i, f"line {i % 3}\nother {i} words", [float(i), 1.0, 2.0]) for i in range(30)]
    return spark.createDataFrame(rows, "doc_id long, text string, embedding array<double>").withColumn("vec_id", F.col("doc_id"))


OPERATORS = {
    "_bs_": lambda d: sharding.balanced_shards(d, [F.col("doc_id")], F.length("text"), 3),
    "_ld_": lambda d: linededup.dedup_lines(d, min_docs=5),
    "_bp_": lambda d: packing.pack(d, F.length("text")),
    "_pii_": lambda d: pii.find_pii(d, pii.fit_pii(d)),
    "_nv_": lambda d: embeddings.near_vectors(d, 0.99),
    "_p": lambda d: with_runs(d),
}
WORKING = ("key", "key0", "key1", "size", "part", "row", "tie", "lines", "drop", "at", "length", "group", "base", "found", "sum", "n", "from", "total", "first")


@pytest.mark.parametrize("prefix", OPERATORS)
def test_they_stay_as_they_are(spark, prefix):
    mine = {prefix + w: F.concat(F.lit(w), "doc_id") for w in WORKING} | {f"kept{prefix}key": F.lit("mine too"), prefix.upper() + "UP": F.lit("upper")}
    plain = OPERATORS[prefix](docs(spark))
    told = OPERATORS[prefix](docs(spark).withColumns(mine))
    assert set(told.columns) == set(plain.columns) | set(mine)
    for r in told.select("doc_id", *mine).collect():
        assert all(r[prefix + w] == f"{w}{r.doc_id}" for w in WORKING) and r[f"kept{prefix}key"] == "mine too"
    results = [c for c in plain.columns if c not in ("text", "bin_id", "bin_offset", "bin_used", "bin_capacity")]
    rows = lambda df: sorted(map(str, df.select(*results).collect()))
    assert rows(plain) == rows(told)


def test_quality_keeps_them(spark):
    ratings = docs(spark).select("doc_id", (F.col("doc_id") % 3).cast("int").alias("grade"))
    model = quality.fit_quality(docs(spark).select("doc_id", "text"), ratings)
    told = quality.with_quality(docs(spark).withColumns({"_qc": F.lit("mine"), "_qcx": F.lit(1)}), model, 1)
    assert {(r._qc, r._qcx) for r in told.collect()} == {("mine", 1)} and told.where("expected_grade is null").count() == 0


def test_clusters_read_no_other_columns(spark):
    odd = docs(spark).withColumns({"owner": F.lit("x"), "x": F.lit(1), "id": F.lit(None), "cluster": F.lit(9)})
    assert delta_lloyd(odd, k=2, rounds=2, dimensions=3).assigned.count() == 30
