"""Drafts: blocks with offsets and sections, sentences, context, citable claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.claims import INTRODUCTION
from ..functions.offsets import WHITE

#: Between blocks in a draft's text.
SEPARATOR = 2
# Abbreviations after which no sentence ends.
ABBREVIATIONS = ("al.", "e.g.", "i.e.", "etc.", "vs.", "cf.", "Fig.", "Figs.", "Eq.", "Eqs.", "Sec.", "Ref.", "Refs.", "Tab.", "No.", "Vol.", "pp.", "Dr.", "Mr.", "Mrs.", "Ms.", "Prof.", "St.", "approx.", "resp.")


def normalized_paragraph(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit(" "), F.lit(" ")), F.lit("\r"), F.lit(""))
    return F.btrim(F.regexp_replace(text, "[ \t]+", " "), F.lit(WHITE))


def assembled(raw: DataFrame) -> DataFrame:
    """Blocks of ``raw`` (draft_id, paragraph_index, text, is_heading): char_start, char_end, section_title.

    Blank blocks go but keep their index. Offsets are those in the blocks joined by two line ends; the section is the last
    heading up to and with the block.
    """
    kept = raw.withColumn("text", normalized_paragraph(F.col("text"))).where("text <> ''")
    order = Window.partitionBy("draft_id").orderBy("paragraph_index")
    size = F.char_length("text")
    start = F.coalesce(F.sum(size + SEPARATOR).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    section = F.last(F.when(F.col("is_heading"), F.col("text")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return kept.withColumns({"char_start": start, "char_end": start + size, "section_title": section})


def sentences(blocks: DataFrame) -> DataFrame:
    """Sentences of the blocks that aren't headings: sentence_index, text, char_start, char_end.

    A sentence ends at . ! or ? before white space and a capital, digit, quote or bracket, unless an abbreviation or a lone
    initial stands there. The text between two offsets is the sentence itself.
    """
    shielded = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    boundary = rf"(?<=[.!?])(?<!\b(?:{shielded}))(?<!\b[A-Z]\.)\s+(?=[A-Z0-9\"(\[])"
    cut = F.split("text", boundary)
    gaps = F.regexp_extract_all(F.col("text"), F.lit(boundary), F.lit(0))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<sentence_index:int,sentence:string,at:int>>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        one = F.struct(F.size(acc["out"]).alias("sentence_index"), x["s"].alias("sentence"), acc["at"].alias("at"))
        after = acc["at"] + F.char_length(x["s"]) + F.coalesce(F.char_length(x["gap"]), F.lit(0))
        return F.struct(after.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    placed = F.aggregate(F.arrays_zip(cut.alias("s"), gaps.alias("gap")), none, add, lambda acc: acc["out"])
    out = blocks.where("not is_heading").withColumn("s", F.explode(placed))
    start = F.col("char_start") + F.col("s.at")
    return out.select("draft_id", "paragraph_index", "s.sentence_index", F.col("s.sentence").alias("text"), start.alias("char_start"), (start + F.char_length("s.sentence")).alias("char_end"), "section_title")


def with_context(sentence_rows: DataFrame) -> DataFrame:
    """local_context: the sentence with the one before and the one after it in the draft."""
    order = Window.partitionBy("draft_id").orderBy("paragraph_index", "sentence_index")
    return sentence_rows.withColumn("local_context", F.concat_ws(" ", F.lag("text").over(order), F.col("text"), F.lead("text").over(order)))


def body_start(blocks: DataFrame) -> DataFrame:
    """draft_id, body_start: where the first heading called introduction starts, 0 without one."""
    intro = F.min(F.when(F.col("is_heading") & F.col("text").rlike(INTRODUCTION), F.col("char_start")))
    return blocks.groupBy("draft_id").agg(F.coalesce(intro, F.lit(0)).alias("body_start"))


def in_body(sentence_rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """The sentences from the introduction on; all where it leaves none, but those of an abstract or of keywords without one."""
    starts = sentence_rows.join(body_start(blocks), "draft_id", "left")
    last = F.max("char_start").over(Window.partitionBy("draft_id"))
    started = starts.withColumn("_from", F.when(last < F.col("body_start"), 0).otherwise(F.coalesce("body_start", F.lit(0))))
    front = F.coalesce(F.lower(F.trim("section_title")).isin("abstract", "keywords", "key words"), F.lit(False))
    return started.where((F.col("char_start") >= F.col("_from")) & ~((F.col("_from") == 0) & front)).drop("_from", "body_start")


def gated(claims: DataFrame, most: int = 40) -> DataFrame:
    """The claims of each draft that go to retrieval: the most confident ones (null: 0), ties by place; all with 0."""
    order = Window.partitionBy("draft_id").orderBy(F.coalesce("confidence", F.lit(0.0)).desc(), "char_start")
    cited = claims.where("needs_citation")
    return cited if most == 0 else cited.withColumn("gate_rank", F.row_number().over(order)).where(F.col("gate_rank") <= most)
