"""Rules over sentences: citations that stand there, whether a sentence makes a claim, its type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import rounded

# Citation syntax, broadest first, and cross-references that only look like it.
BRACKET = r"\[\s*\d+(?:\s*[,;]\s*\d+)*(?:\s*[–—-]\s*\d+)?\s*\]"
PARENTHESIS = r"\(\s*[A-Z][A-Za-z\-']+(?:\s+(?:et\s+al\.?|and|&)\s*[A-Z]?[A-Za-z\-']*)*\s*,\s*\d{4}[a-z]?(?:\s*;\s*[^()]{0,80}?,\s*\d{4}[a-z]?)*\s*\)"
NARRATIVE_MANY = r"\b[A-Z][A-Za-z\-']+\s+(?:et\s+al\.?|and\s+[A-Z][A-Za-z\-']+)\s*\(\s*\d{4}[a-z]?\s*\)"
NARRATIVE_ONE = r"\b[A-Z][A-Za-z\-']+\s*\(\s*\d{4}[a-z]?\s*\)"
CROSS_REFERENCE = r"(?i)\((?:see|cf\.?|in|from|as in)\s+(?:Section|Sec\.|Chapter|Fig\.|Figure|Table|Appendix|Eq\.)"

# The signals of a claim with their weights, in the order in which they are reported.
SIGNALS = {
    "consensus_phrase": (0.45, r"(?i)\b(?:previous (?:research|studies|work)|prior (?:studies|work|research)|several studies|many studies|has been shown|have been shown|it is (?:well )?known|widely used|widely adopted|according to|the literature|state of the art|commonly used|studies (?:show|report|indicate)|research (?:shows|indicates))\b"),
    "reporting_verb": (0.25, r"(?i)\b(?:show[ns]?|showed|demonstrat\w+|suggest\w*|indicat\w+|report\w*|reveal\w*|find[s]?|found|observ\w+|conclude[ds]?|argue[ds]?|establish\w*|confirm\w*)\b"),
    "effect_verb": (0.25, r"(?i)\b(?:improve[sd]?|increase[sd]?|decrease[sd]?|reduce[sd]?|enhance[sd]?|outperform\w*|degrade[sd]?|affect[sd]?|cause[sd]?|lead[s]? to|contribute[sd]? to|result[s]? in|lose[s]?)\b"),
    "comparative": (0.20, r"(?i)\b(?:more|less|higher|lower|better|worse|faster|slower|greater|fewer)\b\s+\w+\s+than\b|\b(?:compared (?:to|with)|relative to|in contrast to)\b"),
    "statistic": (0.15, r"(?i)\b\d+(?:\.\d+)?\s*(?:%|percent)|p\s*[<>=]\s*0?\.\d+|\bn\s*=\s*\d+"),
}
# A paper on its own work, labels of structure, sections without claims, thresholds, types.
OWN_WORK = r"(?i)\b(?:in this (?:paper|study|section|work|article)|this (?:paper|study|section|article) (?:presents|describes|proposes|uses|investigates|examines)|we (?:propose|present|introduce|describe|evaluate|use|apply|adopt|report|conduct|do not)|the (?:next|following|remainder) (?:section|of))\b"
STRUCTURAL = r"(?i)^(?:table|figure|fig\.|equation|eq\.|algorithm|appendix|section)\s+\d+"
NON_CLAIM_SECTIONS = ("references", "acknowledgments", "acknowledgements", "bibliography")
INTRODUCTION = r"(?i)^\s*(?:\d+[.)]?\s*|[ivxlcdm]+[.)]\s*)?introduction\b"
MIN_TOKENS, STRONG_FROM, CLAIM_FROM = 8, 0.6, 0.20
CLAIM_TYPES = (
    ("statistic", "STATISTICAL_CLAIM"),
    ("comparative", "COMPARATIVE_CLAIM"),
    ("consensus_phrase", "PREVIOUS_RESEARCH"),
    ("effect_verb", "CAUSAL_CLAIM"),
)
ALL_CLAIM_TYPES = (
    "EMPIRICAL_RESULT", "FACTUAL_STATEMENT", "PREVIOUS_RESEARCH", "COMPARATIVE_CLAIM", "CAUSAL_CLAIM", "DEFINITIONAL_CLAIM",
    "THEORETICAL_CLAIM", "METHOD_VALIDATION", "STATISTICAL_CLAIM", "GENERAL_BACKGROUND", "AUTHOR_CONTRIBUTION", "NO_CITATION_NEEDED",
)


def normalized_claim_type(answer: Column, needs_citation: Column) -> Column:
    """A classifier's type in the known spelling; unknown and missing ones are told by whether a citation is needed."""
    spelled = F.replace(F.upper(F.trim(answer)), F.lit(" "), F.lit("_"))
    return F.when(spelled.isin(*ALL_CLAIM_TYPES), spelled).when(needs_citation, "GENERAL_BACKGROUND").otherwise("NO_CITATION_NEEDED")


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def citations(text: Column) -> Column:
    """The citations of a sentence by kind and place. A narrative one of a single author can only lie inside one of two;
    these are blanked before the last search."""
    text = F.regexp_replace(text, CROSS_REFERENCE, "(")
    masked = F.regexp_replace(text, NARRATIVE_MANY, " ")
    return F.concat(_all(text, BRACKET), _all(text, PARENTHESIS), _all(text, NARRATIVE_MANY), _all(masked, NARRATIVE_ONE))


def prefilter(text: Column, section: Column) -> dict[str, Column]:
    """verdict (SKIP, STRONG or SEND_TO_LLM), score and signals (comma-joined) of a sentence."""
    excluded = (
        F.when(F.lower(F.trim(section)).isin(*NON_CLAIM_SECTIONS), "non_claim_section")
        .when(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) < MIN_TOKENS, "too_short")
        .when(F.rtrim(text).endswith("?"), "question")
        .when(F.trim(text).rlike(STRUCTURAL), "structural_reference")
    )
    own = text.rlike(OWN_WORK)
    score = sum((F.when(text.rlike(p), w).otherwise(0.0) for w, p in SIGNALS.values()), F.lit(0.0))
    seen = F.concat_ws(",", *[F.when(text.rlike(p), name) for name, (_, p) in SIGNALS.items()], F.when(own, "author_contribution"))
    skip = excluded.isNotNull() | own
    score = F.when(skip, 0.0).otherwise(F.least(F.lit(1.0), rounded(score, 2)))
    return {
        "verdict": F.when(skip, "SKIP").when(score >= STRONG_FROM, "STRONG").otherwise("SEND_TO_LLM"),
        "score": score,
        "signals": F.coalesce(excluded, seen),
    }


def rule_decision(verdict: Column, score: Column, signals: Column) -> dict[str, Column]:
    """The deterministic classifier: needs_citation, claim_type and confidence."""
    needs = (verdict != "SKIP") & (score >= CLAIM_FROM)
    kind = F.lit("EMPIRICAL_RESULT")
    for signal, name in reversed(CLAIM_TYPES):
        kind = F.when(F.array_contains(F.split(signals, ","), signal), name).otherwise(kind)
    return {
        "needs_citation": needs,
        "claim_type": F.when(needs, kind).otherwise("NO_CITATION_NEEDED"),
        "confidence": rounded(F.least(F.lit(0.95), 0.5 + score / 2), 2),
    }


def resolved(decision_needs: Column, decision_type: Column, decision_text: Column, verdict: Column, sentence: Column) -> dict[str, Column]:
    """A classifier's answer where there is one, else the rules': a strong sentence needs a citation."""
    known = decision_needs.isNotNull()
    strong = verdict == "STRONG"
    return {
        "needs_citation": F.coalesce(decision_needs, strong),
        "claim_type": F.when(known, normalized_claim_type(decision_type, decision_needs)).when(strong, "GENERAL_BACKGROUND").otherwise("NO_CITATION_NEEDED"),
        "claim_text": F.when(known, F.coalesce(F.nullif(F.trim(decision_text), F.lit("")), sentence)).otherwise(sentence),
        "detection_method": F.when(known, "LLM").otherwise("RULE"),
    }
