"""Names, years and paragraphs as providers and editors give them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def indexed_author(indexed: Column, preferred: Column, surname: Column, given: Column) -> Column:
    """An author's name: as indexed, as preferred, 'surname, given', or whichever part there is."""
    blank = lambda x: F.nullif(F.trim(x), F.lit(""))
    both = F.when(blank(surname).isNotNull() & blank(given).isNotNull(), F.concat_ws(", ", blank(surname), blank(given)))
    return F.coalesce(blank(indexed), blank(preferred), both, blank(surname), blank(given))


def family_given(family: Column, given: Column, name: Column) -> Column:
    """'family, given' with both, else the family, else the name."""
    both = F.when((F.coalesce(family, F.lit("")) != "") & (F.coalesce(given, F.lit("")) != ""), F.concat_ws(", ", family, given))
    return F.coalesce(both, F.nullif(family, F.lit("")), F.nullif(name, F.lit("")))


def rewritten(paragraph: Column, sentence: Column, citation: Column) -> Column:
    """The paragraph with the citation behind the sentence's first occurrence, or at its end without one."""
    at = F.instr(paragraph, sentence)
    upto = at + F.char_length(sentence) - 1
    inside = F.concat(F.substr(paragraph, F.lit(1), upto), F.lit(" "), citation, F.substr(paragraph, upto + 1))
    return F.when((at > 0) & (sentence != ""), inside).otherwise(F.trim(F.concat_ws(" ", paragraph, citation)))


def emphasized(text: Column, part: Column) -> Column:
    """before, match and after of the first occurrence of ``part``; all before without one."""
    at = F.instr(text, part)
    found = (at > 0) & (part != "")
    end = at + F.char_length(part)
    return F.when(
        found, F.struct(F.substr(text, F.lit(1), at - 1).alias("before"), part.alias("match"), F.substr(text, end).alias("after"))
    ).otherwise(F.struct(text.alias("before"), F.lit("").alias("match"), F.lit("").alias("after")))


def issued_year(date_parts: Column) -> Column:
    """The year of an issue date as lists of year, month and day; null without one."""
    return F.get(F.get(date_parts, F.lit(0)), F.lit(0)).cast("int")
