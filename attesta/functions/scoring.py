"""Scores of candidates: blends, caps, labels, verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import rounded, share_of, verifier_tokens

# Weights, caps, bands and what a verdict is worth.
PRERANK_WEIGHTS = {"semantic": 0.55, "lexical": 0.20, "keyword": 0.15}
WEIGHTS = {"semantic": 0.30, "lexical": 0.15, "keyword": 0.10, "rerank": 0.30}
VERDICT_WEIGHT = 0.15
CONTRADICTED_CAP, NO_ABSTRACT_CAP = 20.0, 45.0
VERDICT_SCORES = {"SUPPORTED": 1.0, "PARTIALLY_SUPPORTED": 0.65, "TOPICALLY_RELATED_BUT_NOT_EVIDENCE": 0.35, "INSUFFICIENT_EVIDENCE": 0.15, "CONTRADICTED": 0.0}
CONTRADICTION_CUES = ("no significant", "contradicts", "fails to replicate", "we find no ", "does not improve")
OVERLAP_LADDER = ((0.45, "SUPPORTED"), (0.30, "PARTIALLY_SUPPORTED"), (0.15, "TOPICALLY_RELATED_BUT_NOT_EVIDENCE"))
BANDS = ((85, "Strong recommendation"), (70, "Recommended"), (50, "Possible reference"), (30, "Weak match"))


def prerank_score(semantic: Column, lexical: Column, keyword: Column) -> Column:
    return PRERANK_WEIGHTS["semantic"] * semantic + PRERANK_WEIGHTS["lexical"] * lexical + PRERANK_WEIGHTS["keyword"] * keyword


def verdict_score(verdict: Column) -> Column:
    """Null for SKIPPED and unknown verdicts."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in VERDICT_SCORES.items() for x in kv]), verdict)


def final_score(semantic: Column, lexical: Column, keyword: Column, rerank: Column, verdict_value: Column) -> Column:
    """From 0 to 1; without a verdict its weight goes to the other parts."""
    parts = zip(WEIGHTS.values(), (semantic, lexical, keyword, rerank), strict=True)
    weighted = sum((w * x for w, x in parts), F.lit(0.0))
    blend = F.when(verdict_value.isNull(), weighted / sum(WEIGHTS.values())).otherwise(weighted + VERDICT_WEIGHT * verdict_value)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), blend))


def percentage(final: Column, verdict: Column, has_abstract: Column) -> Column:
    shown = rounded(final * 100, 1)
    shown = F.when(verdict == "CONTRADICTED", F.least(shown, F.lit(CONTRADICTED_CAP))).otherwise(shown)
    return F.when(has_abstract, shown).otherwise(F.least(shown, F.lit(NO_ABSTRACT_CAP)))


def label(shown: Column, verdict: Column, has_abstract: Column) -> Column:
    band = F.lit("Do not recommend")
    for least, name in reversed(BANDS):
        band = F.when(shown >= least, name).otherwise(band)
    topical = (verdict == "TOPICALLY_RELATED_BUT_NOT_EVIDENCE") & (shown >= 85)
    unproven = verdict.isin("INSUFFICIENT_EVIDENCE", "SKIPPED") & (shown >= 70)
    return F.when(~has_abstract, "Cannot verify").when(topical, "Recommended").when(unproven, "Possible reference").otherwise(band)


def rule_verdict(claim: Column, abstract: Column) -> Column:
    """The deterministic verifier: shared words decide, unless the abstract says the opposite."""
    ratio = share_of(verifier_tokens(claim), verifier_tokens(abstract))
    out = F.lit("INSUFFICIENT_EVIDENCE")
    for least, verdict in reversed(OVERLAP_LADDER):
        out = F.when(ratio >= least, verdict).otherwise(out)
    cue = F.lower(abstract).rlike("|".join(CONTRADICTION_CUES))
    blank = F.trim(F.coalesce(abstract, F.lit(""))) == ""
    return F.when(blank, "INSUFFICIENT_EVIDENCE").when(cue & (ratio >= 0.2), "CONTRADICTED").otherwise(out)
