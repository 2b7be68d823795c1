"""Spreadsheets of candidate papers: CSV, TSV and XLSX files as one table of canonical columns."""

from __future__ import annotations

import io
import re
import zipfile
from functools import reduce
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Canonical columns and the headers they go by.
COLUMN_ALIASES = {
    "title": ("DOCUMENT TITLE", "TITLE", "ARTICLE TITLE", "PAPER TITLE"),
    "source_link": ("LINK", "URL", "DOI LINK", "SCOPUS LINK", "SOURCE LINK"),
    "original_row_number": ("NO", "#", "INDEX", "ROW"),
    "year": ("YEAR", "PUBLICATION YEAR", "PUB YEAR", "COVER DATE"),
    "field_of_study": ("FIELD OF STUDY", "FIELD", "SUBJECT AREA", "DISCIPLINE"),
    "authors_raw": ("AUTHORS", "AUTHOR", "AUTHOR(S)", "AUTHOR NAMES"),
    "source_title": ("SOURCE TITLE", "JOURNAL", "SOURCE", "VENUE", "PUBLICATION NAME"),
    "doi": ("DOI",),
    "scopus_eid": ("EID", "SCOPUS EID"),
    "scopus_id": ("SCOPUS ID", "SCOPUS_ID", "SCP"),
    "abstract": ("ABSTRACT",),
    "author_keywords": ("AUTHOR KEYWORDS", "AUTHOR_KEYWORDS", "KEYWORDS"),
    "index_keywords": ("INDEX KEYWORDS", "INDEX_KEYWORDS"),
    "citation_count": ("CITATION COUNT", "CITED BY", "CITATIONS"),
    "document_type": ("DOCUMENT TYPE", "TYPE"),
}
REQUIRED = ("title", "source_link")
HEADER_ROWS = 12
ROWS = "path string, sheet string, row_no long, cells array<string>"


def normalize_header(value) -> str:
    return re.sub(r"\s+", " ", str(value or "")).strip().upper().rstrip(".:").strip()


def map_columns(headers: list) -> dict[str, int]:
    """Canonical column to its place; the first alias wins, of equal headers the last. Without title or link an error."""
    at = {normalize_header(h): i for i, h in enumerate(headers)}
    out = {field: next(at[a] for a in aliases if a in at) for field, aliases in COLUMN_ALIASES.items() if any(a in at for a in aliases)}
    if missing := [f for f in REQUIRED if f not in out]:
        raise ValueError(f"missing columns {', '.join(missing)} among {headers}")
    return out


def header_row(rows: list[list]) -> int:
    """Of the first rows the one whose headers name the most canonical columns, the earliest on ties."""
    column = {a: name for name, aliases in COLUMN_ALIASES.items() for a in aliases}
    fields = [len({column[h] for h in map(normalize_header, row) if h in column}) for row in rows[:HEADER_ROWS]]
    return fields.index(max(fields)) if fields else 0


def text_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV, TSV or TXT files as they stand: path, sheet (null), row_no (from 0 in each file), cells. By UTF-8, or latin-1 where a file
    isn't that. Spark's reader parses them, a file in one task as quoted cells may span lines; blank lines don't count."""
    tabs = F.lower("path").endswith(".tsv")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    commas = F.size(F.split("value", F.when(tabs, F.lit("\t")).otherwise(F.lit(","))))
    files = lines.groupBy("path").agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.first(tabs).alias("tabs"), F.max(commas).alias("most")).collect()
    out = []
    for utf8, tab in sorted({(f.utf8, f.tabs) for f in files}):
        mine = [f for f in files if (f.utf8, f.tabs) == (utf8, tab)]
        # Cells hold separators, so this is a bound of the columns.
        schema = ", ".join(f"c{i} string" for i in range(max(f.most for f in mine)))
        reader = spark.read.schema(schema).options(header=False, multiLine=True, escape='"', sep="\t" if tab else ",", encoding="UTF-8" if utf8 else "ISO-8859-1")
        read = reader.csv(path if len(mine) == len(files) else [unquote(f.path) for f in mine])
        cells = F.array(F.ltrim(F.col("c0"), F.lit("\ufeff")), *read.columns[1:])
        out.append(read.select(F.col("_metadata.file_path").alias("path"), F.lit(None).cast("string").alias("sheet"), F.monotonically_increasing_id().alias("row_no"), cells.alias("cells")))
    if not out:
        return spark.createDataFrame([], ROWS)
    rows = reduce(DataFrame.unionByName, [_from_0(r) for r in out])
    return rows.select("path", "sheet", "row_no", "cells")


def _from_0(rows: DataFrame) -> DataFrame:
    """row_no from 0 in each file: a file's rows are numbered without gaps."""
    starts = rows.groupBy("path").agg(F.min("row_no").alias("_from"))
    return rows.join(F.broadcast(starts), "path").withColumn("row_no", F.col("row_no") - F.col("_from")).drop("_from")


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _sheets(content: bytes):
    """Name and rows of each sheet of a workbook, or name and what keeps it from being read."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{{{_NS['m']}}}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", _NS):
            target = rels[sheet.get(f"{{{_NS['r']}}}id")].lstrip("/")
            try:
                root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            except (KeyError, ElementTree.ParseError) as fault:
                yield sheet.get("name"), f"cannot be read: {fault}"
                continue
            rows = []
            for row in root.iter(f"{{{_NS['m']}}}row"):
                cells: list = []
                for c in row.findall("m:c", _NS):
                    i = _column(c.get("r", "")) if c.get("r") else len(cells)
                    cells += [None] * (i + 1 - len(cells))
                    value = c.find("m:v", _NS)
                    if c.get("t") == "inlineStr":
                        cells[i] = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                    elif value is not None:
                        cells[i] = shared[int(value.text)] if c.get("t") == "s" else value.text
                rows.append(cells)
            yield sheet.get("name"), rows


#: The row_no of a sheet that is left out; its only cell says why.
REJECTED = -1


def xlsx_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all sheets of XLSX files, from each sheet's header row on. A sheet that can't be read or lacks a required column has one row,
    numbered REJECTED; empty sheets have none."""

    def parse(batches):
        for batch in batches:
            for path, content in zip(batch.path, batch.content, strict=True):
                for name, rows in _sheets(content):
                    told = [] if isinstance(rows, str) else rows
                    from_row = header_row(told)
                    fault = rows if isinstance(rows, str) else None
                    if told:
                        try:
                            map_columns(told[from_row])
                        except ValueError as missing:
                            fault = str(missing)
                    kept = [(path, name, REJECTED, [fault])] if fault else [(path, name, i, r) for i, r in enumerate(told[from_row:], from_row)]
                    yield pd.DataFrame(kept, columns=["path", "sheet", "row_no", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, ROWS)


def rejected_sheets(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, reason of the sheets of XLSX files that library_table() leaves out."""
    return xlsx_rows(spark, path).where(F.col("row_no") == REJECTED).select("path", "sheet", F.get("cells", F.lit(0)).alias("reason"))


def library_table(spark: SparkSession, path: str) -> DataFrame:
    """Canonical columns (strings) of the spreadsheets at ``path``, with row_no and valid: has a title and a link.

    Each file's and sheet's header is looked for among its first rows; only those rows come to the driver. The
    columns are mapped over the headers of all of them. Sheets that can't be used are left out (rejected_sheets); when none can, that
    is an error.
    """
    suffix = path.lower().rsplit(".", 1)[-1]
    if suffix not in ("csv", "tsv", "txt", "xlsx"):
        raise ValueError(f"unknown kind of table: {path}")
    rows = xlsx_rows(spark, path) if suffix == "xlsx" else text_rows(spark, path)
    heads = rows.groupBy("path", "sheet").agg(F.sort_array(F.collect_list(F.when(F.col("row_no") < HEADER_ROWS, F.struct("row_no", "cells")))).alias("first")).collect()
    headers, faults = {}, []
    for h in heads:
        first = [r.cells for r in h["first"]]
        if h["first"][0].row_no == REJECTED:
            faults.append(f"sheet '{h['sheet']}': {first[0][0]}")
            continue
        at = header_row(first)
        headers[h["path"], h["sheet"]] = (h["first"][at].row_no, first[at])
    if faults and not headers:
        raise ValueError("No sheet contained the required columns. " + " | ".join(sorted(faults)))
    every = [c for _, (_, cells) in sorted(headers.items(), key=str) for c in cells]
    canonical = {normalize_header(every[i]): field for field, i in map_columns(every).items()}
    places = [(p, s, n, {canonical[k]: i for i, c in enumerate(cells) if (k := normalize_header(c)) in canonical}) for (p, s), (n, cells) in headers.items()]
    placed = F.broadcast(spark.createDataFrame(places, "path string, sheet string, header_no long, at map<string,int>"))
    body = rows.join(placed, (rows["path"] == placed["path"]) & rows["sheet"].eqNullSafe(placed["sheet"])).where(F.col("row_no") > F.col("header_no"))
    cells = {f: F.get("cells", F.element_at("at", f)) for f in COLUMN_ALIASES}
    out = body.select(rows["path"], rows["sheet"], "row_no", *[c.alias(f) for f, c in cells.items()])
    present = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    return out.withColumn("valid", present("title") & present("source_link"))
