"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, clustering, decontaminate, embeddings, jaccard, linededup, packing, pii, quality, runs, sharding, suffixdedup, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": suffixdedup.op1_suffix_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_jaccard": jaccard.op4_jaccard,
    "op5_pii": pii.op5_pii,
    "op6_packing": packing.op6_packing,
    "op7_sharding": sharding.op7_sharding,
    "op8_near_vectors": embeddings.op8_near_vectors,
    "op9_line_dedup": linededup.op9_line_dedup,
    "op10_quality": quality.op10_quality,
    "op11_chat_format": chat.op11_chat_format,
    "op12_periodic_runs": runs.op12_periodic_runs,
    "op13_centroid_clusters": clustering.op13_centroid_clusters,
}

SQL: dict[str, str] = {
    "op3_decontaminate": decontaminate.OP3_SQL,
    "op4_jaccard": jaccard.OP4_SQL,
    "op8_near_vectors": embeddings.OP8_SQL,
    "op9_line_dedup": linededup.OP9_SQL,
    "op11_chat_format": chat.OP11_SQL,
    "op13_centroid_clusters": clustering.OP13_SQL,
}
