"""Text expressions: tokens, normal forms, hashes, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that retrieval leaves out.
RETRIEVAL_STOPWORDS = (
    "the", "and", "for", "with", "that", "this", "from", "are", "was", "were", "has",
    "have", "their", "which", "than", "these", "those", "our", "not", "but", "can",
    "its", "into", "such", "when", "they", "them", "been", "also", "more", "most",
)
# The words that the rule-based verifier leaves out.
VERIFIER_STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "of", "to", "in", "for", "on", "with", "that",
    "this", "these", "those", "is", "are", "was", "were", "be", "been", "by", "as", "at",
    "from", "it", "its", "their", "have", "has", "had", "we", "our", "which", "than",
)

EMBEDDING_DIM = 768


def _words(text: Column, pattern: str, stopwords: tuple[str, ...]) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*stopwords))


def tokens(text: Column) -> Column:
    """Retrieval tokens in order, with repeats; null has none."""
    return _words(text, r"[a-z][a-z0-9\-]{2,}", RETRIEVAL_STOPWORDS)


def verifier_tokens(text: Column) -> Column:
    """The verifier's distinct tokens."""
    return F.array_distinct(_words(text, r"[a-z]{3,}", VERIFIER_STOPWORDS))


def jaccard(left: Column, right: Column) -> Column:
    """Of two arrays as sets; 0 when either is empty."""
    left, right = F.array_distinct(left), F.array_distinct(right)
    return F.when((F.size(left) == 0) | (F.size(right) == 0), 0.0).otherwise(F.size(F.array_intersect(left, right)) / F.size(F.array_union(left, right)))


def share_of(left: Column, right: Column) -> Column:
    """The share of the distinct elements of ``left`` that ``right`` has; 0 when there are none."""
    left = F.array_distinct(left)
    return F.when(F.size(left) == 0, 0.0).otherwise(F.size(F.array_intersect(left, right)) / F.size(left))


def rounded(x: Column, digits: int) -> Column:
    """Half up; the same in any SQL engine that has floor."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def clean_value(x: Column) -> Column:
    """Trimmed; null for blanks and the usual stand-ins for nothing."""
    trimmed = F.trim(x)
    return F.when(F.lower(trimmed).isin("", "nan", "none", "n/a", "-"), None).otherwise(trimmed)


def first_int(x: Column) -> Column:
    """The first run of one to four digits."""
    return F.regexp_extract(clean_value(x), r"\d{1,4}", 0).try_cast("int")


def _split_clean(x: Column, pattern: str) -> Column:
    parts = F.filter(F.transform(F.split(x, pattern), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.size(parts) > 0, parts)


def split_keywords(x: Column) -> Column:
    return _split_clean(clean_value(x), r"[;|]")


def split_authors(x: Column) -> Column:
    """At semicolons, and at commas before a word that starts with a capital and a small letter."""
    return _split_clean(clean_value(x), r";|,\s(?=[A-Z][a-z])")


def normalized_title(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def sentence_hash(x: Column) -> Column:
    """By which claims and cached answers are known: of the sentence in small letters, with single spaces."""
    return F.sha2(F.regexp_replace(F.lower(F.trim(x)), r"\s+", " "), 256)


def content_text(title: Column, abstract: Column, keywords: Column, index_keywords: Column) -> Column:
    """What of a paper is embedded."""
    listed = lambda name, words: F.when(F.size(words) > 0, F.concat(F.lit(name), F.array_join(words, "; ")))
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" [SEP] "), F.concat_ws(" ", abstract, listed("Keywords: ", keywords), listed("Index terms: ", index_keywords)))


def hash_dimension(token: Column, dim: int = EMBEDDING_DIM) -> Column:
    """The md5 of a token as a number, modulo ``dim``: by its four 32-bit parts, as the whole exceeds a long."""
    digest, acc = F.md5(token), F.lit(0).cast("long")
    for i in range(4):
        part = F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
        acc = (acc * (2**32 % dim) + part) % dim
    return acc
