"""Drafts from files: Markdown, plain text and DOCX as paragraphs."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARAGRAPHS = "draft_id string, paragraph_index int, text string, is_heading boolean"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def text_paragraphs(spark: SparkSession, path: str, markdown: bool) -> DataFrame:
    """Paragraphs between blank lines; in Markdown, # marks a heading and line ends inside become spaces."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("draft_id"), F.col("value"))
    parts = files.select("draft_id", F.posexplode(F.split(F.btrim("value", F.lit("\n")), r"\n\s*\n")).alias("paragraph_index", "text"))
    heading = F.trim("text").rlike(r"^#{1,6}\s+") if markdown else F.lit(False)
    text = F.regexp_replace(F.trim("text"), r"^#{1,6}\s+", "") if markdown else F.trim("text")
    return parts.select("draft_id", "paragraph_index", F.regexp_replace(text, r"\s*\n\s*", " ").alias("text"), heading.alias("is_heading"))


def _docx(content: bytes) -> list[tuple[str, bool]]:
    """Text and whether it is a heading of a document's paragraphs: those of the body, then those of table cells.

    Only the parts with text and styles are read, so a broken picture does no harm.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                names[s.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else ""

    def paragraph(p) -> tuple[str, bool]:
        style = p.find(f"{_W}pPr/{_W}pStyle")
        style = names.get(style.get(f"{_W}val"), style.get(f"{_W}val")) if style is not None else ""
        pieces = [t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" for t in p.iter() if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}br")]
        return "".join(pieces), style.lower().startswith("heading") or style.lower() == "title"

    out = [paragraph(p) for p in body.findall(f"{_W}p")]
    for table in body.findall(f"{_W}tbl"):
        out += [paragraph(p) for row in table.findall(f"{_W}tr") for cell in row.findall(f"{_W}tc") for p in cell.findall(f"{_W}p")]
    return out


def docx_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs of DOCX files; a file is read by one task."""

    def parse(batches):
        for batch in batches:
            for path, content in zip(batch.path, batch.content, strict=True):
                yield pd.DataFrame([(path, i, t, h) for i, (t, h) in enumerate(_docx(content))], columns=["draft_id", "paragraph_index", "text", "is_heading"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, PARAGRAPHS)


def paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """draft_id (the file), paragraph_index, text, is_heading of the files at ``path``, by its suffix."""
    suffix = path.lower().rsplit(".", 1)[-1]
    if suffix == "docx":
        return docx_paragraphs(spark, path)
    if suffix in ("md", "markdown", "txt"):
        return text_paragraphs(spark, path, suffix != "txt")
    raise ValueError(f"unknown kind of draft: {path}")
