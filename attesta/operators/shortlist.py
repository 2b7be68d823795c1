"""What is read from recommendations: shortlists, decisions, coverage, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.citations import joined_in_text
from ..functions.text import rounded

USABLE_FROM, RECOMMENDED_FROM = 65.0, 75.0
VERDICTS = ("SUPPORTED", "PARTIALLY_SUPPORTED", "TOPICALLY_RELATED_BUT_NOT_EVIDENCE", "INSUFFICIENT_EVIDENCE", "CONTRADICTED", "SKIPPED")


def top_per_claim(recommendations: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` of each claim by rank."""
    order = Window.partitionBy("claim_id").orderBy("rank", "ref_id")
    return recommendations.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def _flags(df: DataFrame) -> DataFrame:
    return df.withColumns({"usable": F.col("score") >= USABLE_FROM, "recommended": F.col("score") >= RECOMMENDED_FROM})


def best_references(recommendations: DataFrame, n: int) -> DataFrame:
    """The ``n`` best papers among the first places, each with its best claim; where there is a draft_id, of each draft."""
    first = recommendations.where("rank = 1")
    by = [c for c in recommendations.columns if c == "draft_id"]
    if by:
        each = first.groupBy("draft_id", "ref_id").agg(F.max(F.struct("score", (-F.col("claim_id")).alias("c"))).alias("b"))
        listed = each.select("draft_id", "ref_id", F.col("b.score").alias("score"), (-F.col("b.c")).alias("claim_id"))
        order = Window.partitionBy("draft_id").orderBy(F.desc("score"), "claim_id", "ref_id")
        return _flags(listed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n))
    by_paper = first.groupBy("ref_id").agg(F.max(F.struct("score", (-F.col("claim_id")).alias("c"))).alias("b"))
    return _flags(by_paper.select("ref_id", F.col("b.score").alias("score"), (-F.col("b.c")).alias("claim_id")).orderBy(F.desc("score"), "claim_id", "ref_id").limit(n))


def best_reference(recommendations: DataFrame) -> DataFrame:
    return best_references(recommendations, 1)


def verdict_histogram(recommendations: DataFrame) -> DataFrame:
    """verdict, n for every verdict, 0 where there is none."""
    spark = recommendations.sparkSession
    all_verdicts = spark.createDataFrame([(v,) for v in VERDICTS], "verdict string")
    counts = recommendations.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
    return all_verdicts.join(counts, "verdict", "left").select("verdict", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def coverage(claims: DataFrame, accepted: DataFrame) -> DataFrame:
    """needs, accepted, covered and percent of claims that need a citation and have one."""
    needs = claims.where("needs_citation")
    taken = needs.join(accepted, "claim_id").agg(F.count(F.lit(1)).alias("accepted"), F.countDistinct("claim_id").alias("covered"))
    both = needs.agg(F.count(F.lit(1)).alias("needs")).join(taken, F.lit(True))
    return both.withColumn("percent", F.when(F.col("needs") == 0, 0.0).otherwise(rounded(100 * F.col("covered") / F.col("needs"), 1)))


def decided(log: DataFrame) -> DataFrame:
    """The pairs that are accepted: those whose last decision (claim_id, ref_id, at, decision) says so."""
    last = log.groupBy("claim_id", "ref_id").agg(F.max(F.struct("at", "decision")).alias("last"))
    return last.where("last.decision = 'ACCEPTED'").select("claim_id", "ref_id", F.col("last.at").alias("at"))


def accepted_texts(accepted: DataFrame) -> DataFrame:
    """claim_id, citation_text: the in-text citations of a claim's accepted papers (claim_id, at, ref_id, in_text) in order of acceptance."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "ref_id", "in_text"))), lambda x: x["in_text"])
    return accepted.groupBy("claim_id").agg(listed.alias("l")).select("claim_id", joined_in_text(F.col("l")).alias("citation_text"))


def audit(claims: DataFrame, drafts: DataFrame, texts: DataFrame) -> DataFrame:
    """Every claim that needs a citation with its outcome: NOT_ACCEPTED, INSERTED, or POSITION_MISMATCH when the draft
    does not have the sentence where the claim says."""
    rows = claims.where("needs_citation").join(drafts, "draft_id").join(texts, "claim_id", "left")
    there = F.substr(F.col("raw_text"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start")) == F.col("sentence")
    outcome = F.when(F.col("citation_text").isNull(), "NOT_ACCEPTED").when(there, "INSERTED").otherwise("POSITION_MISMATCH")
    return rows.withColumn("outcome", outcome).drop("raw_text")


def audit_counts(rows: DataFrame) -> DataFrame:
    """draft_id, inserted, mismatched, not_accepted of audit rows."""
    count = lambda o: F.count_if(F.col("outcome") == o)
    return rows.groupBy("draft_id").agg(count("INSERTED").alias("inserted"), count("POSITION_MISMATCH").alias("mismatched"), count("NOT_ACCEPTED").alias("not_accepted"))


def audit_columns(rows: DataFrame, accepted: DataFrame) -> DataFrame:
    """The report's 15 columns after draft_id and claim_id, of audit rows (with section_title, paragraph_index, claim_text, claim_type,
    existing_citation_status) and the accepted papers (claim_id, ref_id, at, title, year, link and, null without a
    recommendation, score_percentage, verdict, recommendation_label, user_decision, user_note) in order of acceptance."""
    fields = ("at", "ref_id", "title", "year", "link", "score_percentage", "verdict", "recommendation_label", "user_decision", "user_note")
    papers = accepted.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_p"))
    said = lambda f: F.array_join(F.transform("_p", f), "; ")
    first = F.get(F.filter("_p", lambda p: p["verdict"].isNotNull()), F.lit(0))
    got = F.col("_p").isNotNull()
    out = rows.join(papers, "claim_id", "left").withColumn("_r", first)
    return out.select(
        "draft_id", "claim_id", "section_title", "paragraph_index", F.coalesce(F.nullif("claim_text", F.lit("")), "sentence").alias("claim_text"),
        "claim_type", "existing_citation_status", "citation_text",
        F.when(got, said(lambda p: p["title"])).alias("reference_titles"),
        F.when(got, said(lambda p: F.coalesce(p["year"].cast("string"), F.lit("n.d.")))).alias("reference_years"),
        F.when(got, said(lambda p: F.nullif(p["link"], F.lit("")))).alias("reference_links"),
        *[F.col(f"_r.{c}").alias(c) for c in ("score_percentage", "verdict", "recommendation_label")],
        F.when(~got, "PENDING").otherwise(F.coalesce(F.when(F.col("_r").isNotNull(), F.col("_r.user_decision")), F.lit("ACCEPTED"))).alias("user_decision"),
        F.col("_r.user_note").alias("user_note"), F.col("outcome").alias("insertion_status"),
    )


def bibliography_order(accepted: DataFrame) -> DataFrame:
    """draft_id, ref_id, number: a draft's papers in the order in which they were first accepted."""
    first = accepted.groupBy("draft_id", "ref_id").agg(F.min(F.struct("at", "claim_id")).alias("first"))
    return first.select("draft_id", "ref_id", F.row_number().over(Window.partitionBy("draft_id").orderBy("first", "ref_id")).alias("number"))
