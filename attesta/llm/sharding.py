"""Contiguous shards of nearly equal bytes from global prefix sums.

Rows are range-partitioned by their key, the partitions' totals (one row each) are summed
up to give every partition its global offset, a window inside each partition completes the
prefix sums, and equal targets of the total cut the line of rows into shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import names_apart, staged, table


@names_apart("_bs_")
def balanced_shards(rows: DataFrame, order_by: list[Column], size: Column, shards: int) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards - 1) and ``slot`` (its place in the shard, from 0).

    Shards are contiguous in ``order_by`` (nulls first); a row goes where the middle of its
    bytes falls, so a shard is off the equal target by less than the largest row. Rows with equal
    keys, repeated rows included, lie side by side in no fixed order. Sizes must be positive;
    null counts as 1. An empty table gives an empty result. ``shard`` and
    ``slot`` in ``rows`` are replaced; other columns pass through.
    """
    rows = rows.drop("shard", "slot")
    keys = [f"_bs_key{i}" for i in range(len(order_by))]
    keyed = rows.select(
        "*",
        F.coalesce(size, F.lit(1)).cast("long").alias("_bs_size"),
        *[c.alias(k) for c, k in zip(order_by, keys, strict=True)],
        F.monotonically_increasing_id().alias("_bs_tie"),
    )
    by = [F.col(k).asc_nulls_first() for k in keys] + [F.col("_bs_tie")]
    # Written once, so that the totals and the prefix sums see the same partitions.
    parts = staged(keyed.repartitionByRange(*by).withColumn("_bs_part", F.spark_partition_id()), "shards")
    totals = parts.groupBy("_bs_part").agg(F.sum("_bs_size").alias("_bs_sum"), F.count(F.lit(1)).alias("_bs_n"))
    # One row a partition: small enough for one task and for a broadcast at any input size.
    line, whole = Window.orderBy("_bs_part"), Window.partitionBy(F.lit(0))
    offsets = totals.select(
        "_bs_part",
        (F.sum("_bs_sum").over(line) - F.col("_bs_sum")).alias("_bs_from"),
        (F.sum("_bs_n").over(line) - F.col("_bs_n")).alias("_bs_row0"),
        F.sum("_bs_sum").over(whole).alias("_bs_total"),
    )
    inner = Window.partitionBy("_bs_part").orderBy(*by)
    placed = (
        parts.withColumns({"_bs_upto": F.sum("_bs_size").over(inner.rowsBetween(Window.unboundedPreceding, 0)), "_bs_nth": F.row_number().over(inner)})
        .join(F.broadcast(offsets), "_bs_part")
        .withColumn("_bs_row", F.col("_bs_row0") + F.col("_bs_nth") - 1)
        .withColumn("shard", F.expr(f"cast(least({shards - 1}, ((2 * (_bs_from + _bs_upto) - _bs_size) * {shards}) div (2 * _bs_total)) as int)"))
    )
    placed = staged(placed.select(*rows.columns, "shard", "_bs_row"), "shard-rows")
    firsts = placed.groupBy("shard").agg(F.min("_bs_row").alias("_bs_first"))
    return placed.join(F.broadcast(firsts), "shard").select(*[placed[c] for c in rows.columns], placed["shard"], (F.col("_bs_row") - F.col("_bs_first")).alias("slot"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards, contiguous in doc_id, of nearly equal bytes. Equal texts are not kept together: a
    group may be larger than a shard."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
    )
    out = balanced_shards(docs, [F.col("doc_id"), F.col("text_crc32")], F.col("size"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
