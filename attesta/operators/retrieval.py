"""Retrieval of candidates for claims: exact vector search, BM25, keyword overlap, pre-ranking."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import prerank_score
from ..functions.text import jaccard, rounded
from .staging import computed_once
from .text_index import inverse_frequencies, scored_pairs
from .vector_index import CLAIMS_AT_ONCE, VectorIndex, best_of, cosines, directions, nearest_first, usable, usual_length

RETRIEVED, PRERANKED = 20, 10
#: Claims' vectors go to every task up to this size.
BROADCAST_BYTES = 32 << 20


def _packed(rows: DataFrame, name: str, dimensions: int) -> DataFrame:
    """The usable vectors of ``rows`` (name_id, vector) of this length, a row for each Arrow batch: name_ids and name_vectors, these end to end."""
    kind = rows.schema[f"{name}_id"].dataType.simpleString()

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                values = batch.column("vector").flatten()
                ends = lambda n: pa.array([0, n], pa.int32())
                columns = [pa.ListArray.from_arrays(ends(batch.num_rows), batch.column(f"{name}_id")), pa.ListArray.from_arrays(ends(len(values)), values)]
                yield pa.RecordBatch.from_arrays(columns, [f"{name}_ids", f"{name}_vectors"])

    plain = rows.where(usable(F.col("vector")) & (F.size("vector") == dimensions)).select(f"{name}_id", F.col("vector").cast("array<double>").alias("vector"))
    return plain.mapInArrow(pack, f"{name}_ids array<{kind}>, {name}_vectors array<double>")


def vector_topk(claims: DataFrame, library: DataFrame, k: int = RETRIEVED, min_year: int | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """claim_id, ref_id, semantic (cosine, 9 decimals) and vector_rank of each claim's ``k`` nearest papers.

    ``claims``: claim_id, vector; ``library``: ref_id, vector and, with ``min_year``, year (null years are left
    out). Exact. Claims of up to ``broadcast_bytes`` go to every task, in blocks, and the papers pass by once, wherever they
    are; more of them search an index, which is built for it (VectorIndex, to be kept where there are many searches).
    Ties go to the smaller ref_id. Claims and papers without a usable() vector have no row, nor have vectors
    of another length than most claims have.
    """
    papers = library
    if min_year is not None:
        papers = papers.where(F.col("year") >= min_year)
    kind, id_type = (df.schema[c].dataType.simpleString() for df, c in ((claims, "claim_id"), (papers, "ref_id")))
    dimensions, n = usual_length(claims)
    asked = claims.select("claim_id", "vector").where(usable(F.col("vector")) & (F.size("vector") == dimensions))
    if n * dimensions * 8 > broadcast_bytes:
        return VectorIndex.build(papers, dimensions).nearest(asked, k)[0]

    def nearest(batches):
        for batch in batches:
            for names, vectors, refs, held in zip(*(batch.column(c) for c in ("claim_ids", "claim_vectors", "ref_ids", "ref_vectors"))):
                q, x = directions(vectors.values.to_numpy(), dimensions), directions(held.values.to_numpy(), dimensions)
                for first in range(0, len(q), CLAIMS_AT_ONCE):
                    yield best_of(names.values.slice(first, CLAIMS_AT_ONCE), refs.values, cosines(q[first : first + CLAIMS_AT_ONCE], x), k)

    blocks = _packed(papers, "ref", dimensions).crossJoin(F.broadcast(_packed(asked, "claim", dimensions)))
    return nearest_first(blocks.mapInArrow(nearest, f"claim_id {kind}, ref_id {id_type}, semantic double"), k)


def corpus_statistics(corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """token, idf (with the floor for tokens in more than half of the documents) and n_docs, average (length) of ``corpus`` (ref_id, words)."""
    totals = corpus.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("words")).alias("average"))
    in_docs = corpus.select(F.explode(F.array_distinct("words")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return inverse_frequencies(in_docs, totals), totals


def bm25(queries: DataFrame, corpus: DataFrame, pairs: DataFrame) -> DataFrame:
    """claim_id, ref_id, bm25 for those of the ``pairs`` that share a token. For the best of all documents see TextIndex.

    ``queries``: claim_id, words (repeats count); ``corpus``: ref_id, words. Statistics are those of the whole
    corpus; only papers that some pair has are cut into postings.
    """
    # Read for lengths, frequencies and postings: without a stop every text would be cut into tokens three times.
    corpus = computed_once(corpus.select("ref_id", "words"))
    idf, totals = corpus_statistics(corpus)
    asked = queries.select("claim_id", F.explode("words").alias("token")).groupBy("claim_id", "token").agg(F.count(F.lit(1)).alias("times"))
    weights = asked.join(idf, "token").select("claim_id", "token", (F.col("times") * F.col("idf")).alias("weight"))
    papers = corpus.join(pairs.select("ref_id").distinct(), "ref_id", "left_semi")
    postings = papers.select("ref_id", F.size("words").alias("length"), F.explode("words").alias("token")).groupBy("ref_id", "length", "token").agg(F.count(F.lit(1)).alias("tf"))
    return scored_pairs(pairs.select("claim_id", "ref_id"), postings, weights, totals)


def min_max(value: Column, *by: str) -> Column:
    """Over each group, from 0 to 1; where all are equal, 1 if positive, else 0."""
    w = Window.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.when(high > 0, 1.0).otherwise(0.0))


def prerank(candidates: DataFrame, claims: DataFrame, papers: DataFrame, corpus: DataFrame, k: int = PRERANKED) -> DataFrame:
    """The ``k`` best of each claim's candidates by similarity, BM25 and keywords, with lexical, keyword and prerank.

    ``claims``: claim_id, query_words, keywords; ``papers``: ref_id, keyword_words; ``corpus``: ref_id, words.
    """
    lexical = bm25(claims.select("claim_id", F.col("query_words").alias("words")), corpus, candidates)
    scored = (
        candidates.join(lexical, ["claim_id", "ref_id"], "left")
        .withColumn("bm25", rounded(F.coalesce("bm25", F.lit(0.0)), 6))
        .withColumn("lexical", min_max(F.col("bm25"), "claim_id"))
        .join(claims.select("claim_id", "keywords"), "claim_id")
        .join(papers.select("ref_id", "keyword_words"), "ref_id")
        .withColumn("keyword", jaccard(F.col("keywords"), F.col("keyword_words")))
        .withColumn("prerank", rounded(prerank_score(F.col("semantic"), F.col("lexical"), F.col("keyword")), 6))
    )
    order = Window.partitionBy("claim_id").orderBy(F.desc("prerank"), "vector_rank")
    return scored.withColumn("prerank_rank", F.row_number().over(order)).where(F.col("prerank_rank") <= k).drop("keywords", "keyword_words")
