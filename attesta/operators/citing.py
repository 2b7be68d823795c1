"""Formatting of reference lists: year letters, numbers, order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import citations as cite


def formatted(references: DataFrame, style: str) -> DataFrame:
    """``references`` (list_id, ref_id, position, authors, title, year, source_title, doi, scopus_url, source_link) with in_text,
    entry and list_rank.

    Papers of a list with the same first author (or short title) and year get letters by title, ties by ref_id; IEEE numbers
    them by position instead.
    """
    style = cite.style_of(style)
    named = references.withColumn("_p", cite.authors(F.col("authors"))).withColumn("_k", cite.author_key(F.col("_p"), F.col("title")))
    group = Window.partitionBy("list_id", "_k", "year")
    letter = F.char(F.row_number().over(group.orderBy(F.lower(F.coalesce("title", F.lit(""))), "ref_id")) + 96)
    lettered = named.withColumn("_s", F.when(F.count(F.lit(1)).over(group) > 1, letter).otherwise(F.lit("")))
    rows = lettered.withColumn("_n", F.row_number().over(Window.partitionBy("list_id").orderBy("position", "ref_id")))
    listed = rows.withColumn("list_rank", F.row_number().over(Window.partitionBy("list_id").orderBy("_k", F.coalesce("year", F.lit(0)), "_s", "ref_id")) if style != "IEEE" else F.col("_n"))
    link = cite.reference_link(F.col("doi"), F.col("scopus_url"), F.col("source_link"))
    people, title, year, suffix, number = (F.col(c) for c in ("_p", "title", "year", "_s", "_n"))
    return listed.withColumns(
        {"in_text": cite.in_text(style, people, title, year, suffix, number), "entry": cite.entry(style, people, title, year, suffix, number, F.col("source_title"), link)}
    ).drop("_p", "_k", "_s", "_n")
