"""The corpus pipeline: toxic documents go, then common lines, then near copies but one, then benchmark passages; the
rest is packed into training sequences. Every stage works on the table that the stage before it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import discard, staged, table
from attesta.llm.decontaminate import decontaminate
from attesta.llm.jaccard import jaccard_groups, one_of_each
from attesta.llm.linededup import dedup_lines
from attesta.llm.packing import pack, word_count
from attesta.llm.toxicity import fit_toxicity, with_toxicity

TOXIC_FROM = 0.7


def _in_place(docs: DataFrame, work: Callable[[DataFrame], DataFrame], text: str | None = None) -> DataFrame:
    """The rows that ``work`` keeps of ``docs``, with the columns of ``docs``.

    ``work`` gets doc_id and text alone, the others as one struct, so that no column an operator adds meets one of
    the caller's. ``text`` names the column of its result that becomes the text; n_chars follows the text where there is one.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = work(docs.select("doc_id", "text", F.struct(F.lit(0).alias("__none"), *others).alias("_others")))
    if text:
        out = out.withColumn("text", F.when(F.col("text").isNotNull(), F.col(text)))
    named = {c: F.col("_others")[c] for c in others} | {c: F.col(c) for c in ("doc_id", "text")}
    if text and "n_chars" in others:
        named["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*(named[c].alias(c) for c in docs.columns))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of the labels finds toxic with a probability of 0.7 or more go. Null and empty texts stay, and so do
    repeated rows; an empty table stays empty. Columns of any name come out as they were, here and in the stages that follow."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return _in_place(docs, lambda d: with_toxicity(d, model).where((F.col("toxicity") < TOXIC_FROM) | (F.coalesce(F.length("text"), F.lit(0)) == 0)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in 10 documents or more go; a document of such lines alone stays, with an empty text. A null text stays null."""
    return _in_place(docs, dedup_lines, "kept_text")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at a Jaccard similarity of 0.8 on five words, the one with the smallest id stays. Texts
    without words all stay; of repeated rows one does."""
    return _in_place(docs, lambda d: one_of_each(jaccard_groups(d)))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents of which they are more than half go. Null and empty texts stay."""
    return _in_place(docs, lambda d: decontaminate(d, table(spark, sf_dir, "benchmark")), "text")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its sequence and its place there. A null or empty text has one token, its end; no
    other column of the documents is asked or returned."""
    return pack(docs.select("doc_id", word_count(F.col("text")).alias("doc_tokens")), F.col("doc_tokens"))


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", benchmark), ("best-fit packing", packing)]

#: The toxicity model is fitted; SQL does not express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            before, docs = docs, staged(docs, f"stage{k}")
            if k:
                discard(before)
    return docs
