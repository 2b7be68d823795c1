"""Identifiers of papers in links and columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shapes of identifiers.
DOI = r"(?i)10\.\d{4,9}/[^\s\"'<>&]+"
EID = r"(?i)2-s2\.0-\d+"
SEMANTIC_SCHOLAR = r"(?i)semanticscholar\.org/paper/(?:[^/\s]+/)?([0-9a-f]{40})"
SCOPUS_ID = r"(?i)[?&]scp=(\d+)"
DOI_END = r"[.,;:)\]}>\"']+$"


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def unquoted(x: Column) -> Column:
    """Percent-decoded; a plus sign, and a percent sign that starts no code, are as they are."""
    coded = F.replace(F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(coded), x)


def normalized_doi(x: Column) -> Column:
    return F.nullif(F.lower(F.regexp_replace(_found(unquoted(x), DOI), DOI_END, "")), F.lit(""))


def openalex_doi(x: Column) -> Column:
    return F.nullif(F.lower(F.regexp_replace(x, r"^https?://doi\.org/", "")), F.lit(""))


def identifiers(link: Column, doi: Column | None = None, eid: Column | None = None) -> dict[str, Column]:
    """doi, scopus_eid, scopus_id, semantic_scholar_id and link_kind; columns of their own beat the link."""
    none = F.lit(None).cast("string")
    text = F.coalesce(unquoted(link), F.lit(""))
    out = {
        "doi": F.coalesce(normalized_doi(doi if doi is not None else none), normalized_doi(text)),
        "scopus_eid": F.lower(F.coalesce(_found(eid if eid is not None else none, EID), _found(text, EID))),
        "scopus_id": _found(text, SCOPUS_ID, 1),
        "semantic_scholar_id": F.lower(_found(text, SEMANTIC_SCHOLAR, 1)),
    }
    web = text.startswith("http")
    out["link_kind"] = (
        F.when(out["scopus_eid"].isNotNull() | F.contains(F.lower(text), F.lit("scopus.com")), "SCOPUS")
        .when(out["semantic_scholar_id"].isNotNull(), "SEMANTIC_SCHOLAR")
        .when(F.contains(F.lower(text), F.lit("doi.org")), "DOI")
        .when(out["doi"].isNotNull() & web, "PUBLISHER")
        .when(out["doi"].isNotNull(), "DOI")
        .when(web, "PUBLISHER")
        .otherwise("UNKNOWN")
    )
    return out


def has_any(ids: dict[str, Column]) -> Column:
    return F.coalesce(*(ids[k] for k in ("doi", "scopus_eid", "scopus_id", "semantic_scholar_id"))).isNotNull()
