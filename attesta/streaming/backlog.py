"""The library's backlog as a stream: papers that arrive are embedded once, in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import content_text


def drain(spark: SparkSession, arriving: str, embedded: str, checkpoint: str, embed: Callable[[DataFrame], DataFrame], files_per_batch: int = 25) -> StreamingQuery:
    """Embeds what is new under ``arriving`` (Parquet: ref_id, title, abstract, author_keywords, index_keywords) and appends it to
    ``embedded`` with its content_hash; ends when nothing is left. ``embed`` adds the vectors to a batch.

    A batch that is run again after a failure replaces what it wrote, as each writes to a folder of its own.
    """
    schema = "ref_id long, title string, abstract string, author_keywords array<string>, index_keywords array<string>"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(arriving)
    text = content_text(F.col("title"), F.col("abstract"), F.col("author_keywords"), F.col("index_keywords"))
    ready = rows.where("abstract is not null").withColumn("content", text).withColumn("content_hash", F.sha2("content", 256))

    def write(batch: DataFrame, batch_id: int) -> None:
        embed(batch.dropDuplicates(["ref_id", "content_hash"])).write.mode("overwrite").parquet(f"{embedded}/batch={batch_id}")

    return ready.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
