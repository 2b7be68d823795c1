"""Key phrases of texts: runs of words between stopwords and punctuation, scored by their words' company in all texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import RETRIEVAL_STOPWORDS, VERIFIER_STOPWORDS, rounded, tokens
from .staging import written_once

MOST, LEAST_CHARACTERS = 12, 3
#: Where phrases are cut, besides at everything that is no letter.
CUTTING = tuple(sorted({*RETRIEVAL_STOPWORDS, *VERIFIER_STOPWORDS}))


def candidate_phrases(text: Column) -> Column:
    """The longest runs of words without a stopword, number or punctuation, in lower case, in order, with repeats."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+|[^\p{L}\s]+"), F.lit(0))
    cut = F.transform(found, lambda t: F.when(t.isin(*CUTTING) | ~t.rlike(r"^\p{L}"), "|").otherwise(t))
    return F.filter(F.transform(F.split(F.array_join(cut, " "), r"\|"), lambda p: F.trim(p)), lambda p: F.char_length(p) >= LEAST_CHARACTERS)


def key_phrases(texts: DataFrame, key: str, text_column: str, most: int = MOST) -> DataFrame:
    """``key`` and phrases: the ``most`` best phrases of each text, best first; texts without any have no row.

    A word's score is its degree by its frequency: how many words stand in its phrases, itself included, for each time it
    stands in one, over all ``texts``. A phrase's score is the sum of its words'; ties go to the one that stands earlier.
    Scores are of all texts, so a phrase's worth doesn't depend on the text that it is found in.
    """
    found = texts.select(F.col(key), F.posexplode(candidate_phrases(F.col(text_column))).alias("at", "phrase"))
    found = written_once(found.groupBy(key, "phrase").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("times")), "phrases")
    words = found.select(key, "phrase", "times", F.explode(F.split("phrase", " ")).alias("word"), (F.size(F.split("phrase", " "))).alias("size"))
    company = words.groupBy("word").agg((F.sum(F.col("times") * F.col("size")) / F.sum("times")).alias("score"))
    scored = words.join(company, "word").groupBy(key, "phrase").agg(rounded(F.sum("score"), 6).alias("score"))
    order = Window.partitionBy(key).orderBy(F.desc("score"), "at")
    best = scored.join(found, [key, "phrase"]).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return best.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "phrase"))).alias("p")).select(key, F.col("p.phrase").alias("phrases"))


def with_keywords(claims: DataFrame) -> DataFrame:
    """``claims`` (claim_id, query and more) with keywords: the distinct tokens of their key phrases, none where they have no phrase."""
    words = F.array_distinct(tokens(F.array_join("phrases", " ")))
    told = key_phrases(claims, "claim_id", "query").select("claim_id", words.alias("keywords"))
    return claims.join(told, "claim_id", "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))
