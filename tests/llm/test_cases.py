"""Expected shards and slots, and the handling of repeated rows, empty tables and clashing names where other tests leave it out."""

from __future__ import annotations

import random
import zlib

from pyspark.sql import functions as F

from attesta.llm import decontaminate, quality, sharding


def brute_shards(texts, shards):
    """By definition: in order of doc_id, a row goes where the middle of its bytes falls."""
    sizes = {i: len((t or "").encode()) + 1 for i, t in texts}
    total, upto, out, slots = sum(sizes.values()), 0, {}, [0] * shards
    for i in sorted(sizes):
        upto += sizes[i]
        shard = min(shards - 1, (2 * upto - sizes[i]) * shards // (2 * total))
        out[i] = (sizes[i], shard, slots[shard])
        slots[shard] += 1
    return out


def test_every_document_is_in_its_shard_and_slot(spark, tmp_path):
    rng = random.Random(6)
    texts = [(i * 3, rng.choice([None, "", "é" * rng.randint(1, 400), "x" * rng.randint(1, 900)])) for i in range(500)] + [(9999, "y" * 60_000)]
    spark.createDataFrame(rng.sample(texts, len(texts)), "doc_id long, text string").repartition(7).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in sharding.op7_sharding(spark, str(tmp_path)).collect()}
    assert {i: (r.size, r.shard, r.slot) for i, r in rows.items()} == brute_shards(texts, 8)
    assert all(rows[i].text_crc32 == zlib.crc32((t or "").encode()) and rows[i].law == "bytes" and rows[i].grown_shard is None for i, t in texts)


ITEM = "one two three four five six seven eight nine ten eleven"


def test_decontamination_of_repeated_rows_and_clashing_names(spark):
    rows = [(1, f"before {ITEM} after " + "w " * 40), (1, f"before {ITEM} after " + "w " * 40), (2, ITEM), (2, ITEM), (3, None), (4, "clean text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"runs": F.lit("mine"), "items": F.lit(1), "item_id": F.lit("clash")})
    items = spark.createDataFrame([("a", ITEM), ("a", ITEM), ("b", None), ("c", "")], "item_id string, text string")
    kept = decontaminate.decontaminate(docs, items)
    assert set(kept.columns) == set(docs.columns) and kept.where("runs = 'mine' and items = 1 and item_id = 'clash'").count() == kept.count()
    assert sorted((r.doc_id, (r.text or "").split()[:2]) for r in kept.collect()) == [(1, ["before", "after"]), (1, ["before", "after"]), (3, []), (4, ["clean", "text"])]


def test_decontamination_of_nothing_and_by_nothing(spark):
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    items = spark.createDataFrame([("a", ITEM)], "item_id string, text string")
    assert decontaminate.decontaminate(docs.where("false"), items).count() == 0
    assert [r.text for r in decontaminate.decontaminate(docs, items.where("false")).collect()] == [ITEM]


def test_quality_of_repeated_long_and_no_rows(spark):
    docs = spark.createDataFrame([(i, f"good words {i} in a row" if i % 2 else f"junk junk {i} 111 222") for i in range(60)], "doc_id long, text string")
    model = quality.fit_quality(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("grade")))
    told = quality.with_quality(docs.unionByName(docs).unionByName(spark.createDataFrame([(100, "good words " * 50_000), (101, None), (102, "")], docs.schema)), model, 1)
    rows = told.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("expected_grade").alias("grades")).collect()
    assert all(r.n == (2 if r.doc_id < 100 else 1) and r.grades == 1 for r in rows)
    assert quality.with_quality(docs.where("false"), model, 1).count() == 0
