"""The recommendation plan: from claims and a library to ranked, scored and labelled papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.text import rounded, sentence_hash, share_of, tokens
from ..operators.drafts import gated
from ..operators.keyphrases import with_keywords
from ..operators.retrieval import prerank, vector_topk
from ..operators.staging import computed_once
from ..operators.verification import Ask
from ..operators.verification import verified as verify

VERIFIED_CLAIMS, VERIFIED_PAPERS = 20, 3


def reranked(candidates: DataFrame, claims: DataFrame, papers: DataFrame) -> DataFrame:
    """``candidates`` with rerank: the share of the claim's tokens that the paper's title and the start of its abstract have."""
    doc = F.concat_ws(". ", "title", F.substring("abstract", 1, 1500))
    return (
        candidates.join(claims.select("claim_id", F.col("query").alias("_q")), "claim_id")
        .join(papers.select("ref_id", doc.alias("_d"), "abstract"), "ref_id")
        .withColumn("rerank", rounded(share_of(tokens(F.col("_q")), tokens(F.col("_d"))), 6))
        .drop("_d")
    )


def gate(candidates: DataFrame, claims_kept: int = VERIFIED_CLAIMS, papers_kept: int = VERIFIED_PAPERS) -> DataFrame:
    """Of each draft's claims (draft_id; without this column all are of one) those with the best reranked papers, so many, and of each
    of these so many papers."""
    by = [c for c in candidates.columns if c == "draft_id"]
    best = candidates.groupBy(*by, "claim_id").agg(F.max("rerank").alias("best"))
    first = (F.desc("best"), "claim_id")
    if by:
        kept = best.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*first))).where(F.col("_n") <= claims_kept)
    else:
        kept = best.orderBy(*first).limit(claims_kept)
    order = Window.partitionBy("claim_id").orderBy(F.desc("rerank"), "prerank_rank")
    placed = candidates.withColumn("rerank_rank", F.row_number().over(order)).where(F.col("rerank_rank") <= papers_kept)
    return placed.join(kept.select("claim_id"), "claim_id", "left_semi")


def scored(candidates: DataFrame) -> DataFrame:
    """verdict (by rule, where ``candidates`` have none), final_score, percentage, label and rank of candidates with their components."""
    has_abstract = F.trim(F.coalesce("abstract", F.lit(""))) != ""
    out = candidates if "verdict" in candidates.columns else candidates.withColumn("verdict", scoring.rule_verdict(F.col("_q"), F.col("abstract")))
    out = out.withColumn("final_score", scoring.final_score(*(F.col(c) for c in ("semantic", "lexical", "keyword", "rerank")), scoring.verdict_score(F.col("verdict"))))
    out = out.withColumn("percentage", scoring.percentage(F.col("final_score"), F.col("verdict"), has_abstract))
    out = out.withColumn("label", scoring.label(F.col("percentage"), F.col("verdict"), has_abstract))
    order = Window.partitionBy("claim_id").orderBy(F.desc("percentage"), "rerank_rank")
    return out.withColumn("rank", F.row_number().over(order))


def recommend_drafts(
    claims: DataFrame, papers: DataFrame, min_year: int | None = None, most: int = 40, verified: int = VERIFIED_CLAIMS, ask: Ask | None = None, cache: DataFrame | None = None
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """recommend() for drafts: the ``most`` claims of each (gated) go to retrieval, ``verified`` of each get verdicts.

    ``claims``: draft_id, claim_id, needs_citation, confidence, char_start, claim_text, local_context, vector. A claim asks with its
    context, or with its text where it has none. With ``ask`` verdicts come from ``cache`` and from calls (verification.verified), and
    the entries that the cache doesn't have yet are returned beside the recommendations; claims are hashed by their text.
    """
    query = F.coalesce(F.nullif(F.trim("local_context"), F.lit("")), F.col("claim_text"))
    asked = gated(claims, most).select("draft_id", "claim_id", query.alias("query"), "vector")
    if ask is None:
        return recommend(asked, papers, min_year, verified)
    told = claims.select("claim_id", "claim_text", F.coalesce("local_context", F.lit("")).alias("claim_context"), sentence_hash(F.col("claim_text")).alias("claim_hash"))
    keywords = F.array().cast("array<string>") if "keywords" not in papers.columns else F.col("keywords")
    chosen = candidates_of(asked, papers, min_year, verified).join(told, "claim_id").join(papers.select("ref_id", "title", keywords.alias("keywords")), "ref_id")
    out = verify(chosen.withColumn("place", F.col("rerank_rank")), cache, ask)
    return scored(out.outcomes), out.entries


def recommend(claims: DataFrame, papers: DataFrame, min_year: int | None = None, verified: int = VERIFIED_CLAIMS) -> DataFrame:
    """``claims``: claim_id, query, vector and, where they are of several drafts, draft_id; ``papers``: ref_id, title, abstract, year, vector."""
    return scored(candidates_of(claims, papers, min_year, verified))


def candidates_of(claims: DataFrame, papers: DataFrame, min_year: int | None, verified: int) -> DataFrame:
    """The candidates of recommend() that get a verdict, with their components."""
    words = papers.where("vector is not null").select("ref_id", tokens(F.concat_ws(" ", "title", "abstract")).alias("words"))
    asked = computed_once(with_keywords(claims.select("claim_id", "query", tokens(F.col("query")).alias("query_words"))))
    # The pairs filter the postings and are scored by them: without a stop the search would run for each of these branches.
    near = computed_once(vector_topk(claims, papers, min_year=min_year))
    ranked = prerank(near, asked, papers.select("ref_id", tokens(F.col("title")).alias("keyword_words")), words)
    candidates = reranked(ranked, asked, papers)
    if "draft_id" in claims.columns:
        candidates = candidates.join(claims.select("claim_id", "draft_id"), "claim_id")
    return gate(computed_once(candidates), verified)
