"""Exports: drafts with citations as Markdown, accepted citations as JSON, audit tables as CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.citations import insertion_offset


#: The audit table's columns, in order, and what it says of drafts without a row.
AUDIT_HEADS = ("Section", "Claim", "Type", "Existing citation", "Score", "Verdict", "Decision", "Status")
NO_CLAIMS = "## Citation Audit Report\n\n_No claims required a citation._"
CLAIM_CHARACTERS = 120


def markdown(blocks: DataFrame, splices: DataFrame, references: DataFrame | None = None, audit: DataFrame | None = None) -> DataFrame:
    """draft_id, markdown: the blocks (draft_id, paragraph_index, text, is_heading) with their citations.

    ``splices``: draft_id, paragraph_index, start, end, sentence, citation. A citation goes before the end of its sentence if the block
    has the sentence at start to end; else it is left out. Splices of a block apply from its end to its start. A heading in a draft's first
    block is of the first level, others are of the second. ``references``: draft_id, number, text, a list under a heading of its own, for
    drafts that have any. ``audit``: the rows of audit_table(); drafts without rows say that no claim needed a citation.
    """
    by_block = splices.groupBy("draft_id", "paragraph_index").agg(F.sort_array(F.collect_list(F.struct("start", "end", "sentence", "citation")), asc=False).alias("_s"))

    def put(text: Column, x: Column) -> Column:
        there = F.substr(text, x["start"] + 1, x["end"] - x["start"]) == x["sentence"]
        at = x["start"] + insertion_offset(x["sentence"])
        return F.when(there, F.concat(F.substr(text, F.lit(1), at), F.lit(" "), x["citation"], F.substr(text, at + 1))).otherwise(text)

    spliced = blocks.join(by_block, ["draft_id", "paragraph_index"], "left").withColumn("text", F.aggregate(F.coalesce("_s", F.array()), F.col("text"), put))
    first = blocks.groupBy("draft_id").agg(F.min("paragraph_index").alias("_first"))
    level = F.when(F.col("paragraph_index") == F.col("_first"), "# ").otherwise("## ")
    lines = spliced.join(first, "draft_id").withColumn("text", F.when(F.col("is_heading"), F.concat(level, "text")).otherwise(F.col("text")))
    ordered = F.array_sort(F.collect_list(F.struct("paragraph_index", "text")))
    out = lines.groupBy("draft_id").agg(F.array_join(F.transform(ordered, lambda b: b["text"]), "\n\n").alias("markdown"))
    if references is not None:
        entries = F.transform(F.array_sort(F.collect_list(F.struct("number", "text"))), lambda r: F.concat(F.lit("- "), r["text"]))
        listed = references.groupBy("draft_id").agg(F.concat(F.lit("\n\n## References\n\n"), F.array_join(entries, "\n")).alias("_r"))
        out = out.join(listed, "draft_id", "left").select("draft_id", F.concat("markdown", F.coalesce("_r", F.lit(""))).alias("markdown"))
    if audit is not None:
        told = F.concat("markdown", F.lit("\n\n"), F.coalesce("audit", F.lit(NO_CLAIMS)))
        out = out.join(audit_table(audit), "draft_id", "left").select("draft_id", told.alias("markdown"))
    return out


def accepted_json(accepted: DataFrame) -> DataFrame:
    """draft_id, json: the accepted papers (draft_id, claim_id, ref_id, at) of each claim, in order of acceptance."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "ref_id"))), lambda x: x["ref_id"])
    by_claim = accepted.groupBy("draft_id", "claim_id").agg(listed.alias("references"))
    whole = F.array_sort(F.collect_list(F.struct("claim_id", "references")))
    return by_claim.groupBy("draft_id").agg(F.to_json(F.struct(whole.alias("accepted"))).alias("json"))


def json_bundle(drafts: DataFrame, accepted: DataFrame, audit: DataFrame, bibliography: DataFrame, style: str = "APA", mode: str = "n/a", at: str | None = None) -> DataFrame:
    """draft_id, json: each of ``drafts`` (draft_id, filename) with its accepted claims, audit and bibliography; ``at``: when.

    ``accepted``: draft_id, claim_id, sentence, ref_id, at, in_text; a claim has its citation_text only with a single paper.
    ``audit``: draft_id, claim_id and the report's columns. ``bibliography``: draft_id, number, ref_id, text.
    """
    listed = lambda c, *by: F.transform(F.array_sort(F.collect_list(F.struct(*by, c.alias("_v")))), lambda x: x["_v"])
    cited = accepted.groupBy("draft_id", "claim_id").agg(F.min("sentence").alias("sentence_text"), F.when(F.count(F.lit(1)) == 1, F.min("in_text")).alias("citation_text"), listed(F.col("ref_id").cast("string"), "at", "ref_id").alias("reference_ids"))
    one = F.struct(F.col("claim_id").cast("string").alias("claim_id"), "sentence_text", "citation_text", "reference_ids")
    columns = [c for c in audit.columns if c not in ("draft_id", "claim_id")]
    parts = {
        "accepted": cited.groupBy("draft_id").agg(listed(one, "claim_id").alias("accepted")),
        "audit": audit.groupBy("draft_id").agg(listed(F.struct(*columns), "claim_id").alias("audit")),
        "bibliography": bibliography.groupBy("draft_id").agg(listed(F.struct(F.col("ref_id").cast("string").alias("reference_id"), "text"), "number").alias("bibliography")),
    }
    out = drafts
    for part in parts.values():
        out = out.join(part, "draft_id", "left")
    head = [F.struct(F.col("draft_id").cast("string").alias("id"), "filename").alias("draft"), F.lit(at).cast("string").alias("generated_at"), F.lit(style).alias("citation_style"), F.lit(mode).alias("insertion_mode")]
    whole = F.struct(*head, *[F.coalesce(F.col(p), F.array().cast(out.schema[p].dataType)).alias(p) for p in parts])
    return out.select("draft_id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("json"))


# The columns of a template, which an import recognises.
TEMPLATE = ("NO.", "YEAR", "FIELD OF STUDY", "AUTHORS", "DOCUMENT TITLE", "SOURCE TITLE", "LINK", "ABSTRACT")


def abstract_template(papers: DataFrame) -> DataFrame:
    """The rows of ``papers`` (original_row_number, year, field_of_study, authors, title, source_title, source_link; authors: structs with a name)
    to fill in abstracts: the columns of TEMPLATE, the last one empty."""
    names = F.filter(F.transform(F.coalesce("authors", F.array().cast("array<struct<name:string>>")), lambda a: a["name"]), lambda n: F.coalesce(n, F.lit("")) != "")
    values = ["original_row_number", "year", "field_of_study", F.array_join(names, "; "), "title", "source_title", "source_link", F.lit("")]
    return papers.select(*((F.col(v) if isinstance(v, str) else v).alias(c) for v, c in zip(values, TEMPLATE)))


# Fixed value: what file names begin with.
NAME_TAG = "[INTI] "


def download_name(stem: Column, extension: str, tag: str = NAME_TAG) -> Column:
    """A file name without the characters that file systems refuse; blank stems are called paper."""
    clean = F.trim(F.regexp_replace(stem, r'[\\/:*?"<>|\x00-\x1f]', "_"))
    return F.concat(F.lit(tag), F.when(F.coalesce(clean, F.lit("")) == "", "paper").otherwise(clean), F.lit(f".{extension}"))


def write_audit(rows: DataFrame, path: str) -> None:
    """An audit table as CSV with a header."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def audit_table(rows: DataFrame) -> DataFrame:
    """draft_id, audit: a Markdown table of each draft's rows (draft_id, place, section_title, claim_text, claim_type, existing_citation_status,
    score_percentage, verdict, user_decision, insertion_status), in order of place. Bars in claims are escaped, then claims are cut."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    claim = F.substring(F.replace(said("claim_text"), F.lit("|"), F.lit("\\|")), 1, CLAIM_CHARACTERS)
    score = F.when(F.col("score_percentage").isNotNull(), F.format_string("%.1f%%", F.col("score_percentage").cast("double"))).otherwise("")
    cells = [said("section_title"), claim, said("claim_type"), said("existing_citation_status"), score, said("verdict"), said("user_decision"), said("insertion_status")]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = "## Citation Audit Report\n\n| " + " | ".join(AUDIT_HEADS) + " |\n|" + "---|" * len(AUDIT_HEADS) + "\n"
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda r: r["line"])
    return rows.groupBy("draft_id").agg(F.concat(F.lit(head), F.array_join(lines, "\n")).alias("audit"))
