"""Citation formatting as column expressions: author names, in-text forms, reference-list entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STYLES = ("APA", "CHICAGO", "IEEE")
# Where the styles cut long author lists.
APA_MOST, APA_KEPT = 20, 19
CHICAGO_MOST, CHICAGO_KEPT = 10, 7
IEEE_MOST, IEEE_KEPT = 6, 3
TRAILING_PUNCTUATION = "[.?!…\"'”’]+$"


def style_of(name: str) -> str:
    style = (name or "").strip().upper()
    if style not in STYLES:
        raise ValueError(f"unknown citation style {name!r}; known: {', '.join(STYLES)}")
    return style


def _initials(given: Column) -> Column:
    runs = F.regexp_extract_all(given, F.lit("[A-Za-z]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.lit("."))), " ")


def author(raw: Column) -> Column:
    """family and initials of a name written 'Family, Given', 'J. A. Family', 'Given Family', 'Two Names F.' or 'Family';
    null for blanks."""
    text = F.trim(F.regexp_replace(raw, r"\s+", " "))
    # The shapes of names.
    comma, leading = text.rlike(r"^[^,]+,\s*.+$"), text.rlike(r"^(?:[A-Z]\.\s*)+[A-Za-z\-']+$")
    last = F.regexp_extract(text, r"(\S+)$", 1)
    before = F.trim(F.regexp_replace(text, r"\S+$", ""))
    trailing = last.rlike(r"^(?:[A-Za-z]\.){1,4}$") & (before != "")
    pair = lambda family, given: F.struct(F.trim(family).alias("family"), _initials(given).alias("initials"))
    return (
        F.when(F.coalesce(text, F.lit("")) == "", None)
        .when(comma, pair(F.regexp_extract(text, r"^([^,]+),", 1), F.regexp_extract(text, r"^[^,]+,\s*(.+)$", 1)))
        .when(leading, pair(F.regexp_extract(text, r"([A-Za-z\-']+)$", 1), F.regexp_extract(text, r"^((?:[A-Z]\.\s*)+)", 1)))
        .when(before == "", pair(text, F.lit("")))
        .when(trailing, pair(before, last))
        .otherwise(pair(last, before))
    )


def authors(names: Column) -> Column:
    """Parsed names without the blank ones; null has none."""
    none = F.array().cast("array<struct<family:string,initials:string>>")
    return F.coalesce(F.filter(F.transform(names, author), lambda a: a.isNotNull()), none)


def short_title(title: Column) -> Column:
    words = F.regexp_extract_all(title, F.lit(r"\S+"), F.lit(0))
    return F.when(F.coalesce(title, F.lit("")) == "", "Untitled").otherwise(F.concat(F.lit('"'), F.array_join(F.slice(words, 1, 4), " "), F.lit('"')))


def author_key(people: Column, title: Column) -> Column:
    """By which entries are grouped and sorted: the first family name or the short title, in small letters."""
    return F.lower(F.when(F.size(people) > 0, F.get(people, F.lit(0))["family"]).otherwise(short_title(title)))


def in_text_names(people: Column, title: Column, conjunction: str) -> Column:
    first, second = F.get(people, F.lit(0))["family"], F.get(people, F.lit(1))["family"]
    return (
        F.when(F.size(people) == 0, short_title(title))
        .when(F.size(people) == 1, first)
        .when(F.size(people) == 2, F.concat(first, F.lit(f" {conjunction} "), second))
        .otherwise(F.concat(first, F.lit(" et al.")))
    )


def year_text(year: Column) -> Column:
    return F.when(F.coalesce(year, F.lit(0)) == 0, "n.d.").otherwise(year.cast("string"))


def in_text(style: str, people: Column, title: Column, year: Column, suffix: Column, number: Column) -> Column:
    if style == "IEEE":
        return F.concat(F.lit("["), number.cast("string"), F.lit("]"))
    if style == "CHICAGO":
        return F.concat(F.lit("("), in_text_names(people, title, "and"), F.lit(" "), year_text(year), suffix, F.lit(")"))
    return F.concat(F.lit("("), in_text_names(people, title, "&"), F.lit(", "), year_text(year), suffix, F.lit(")"))


def _inverted(a: Column) -> Column:
    return F.when(a["initials"] == "", a["family"]).otherwise(F.concat(a["family"], F.lit(", "), a["initials"]))


def _natural(a: Column) -> Column:
    return F.trim(F.concat(a["initials"], F.lit(" "), a["family"]))


def _stopped(x: Column) -> Column:
    return F.when(x.endswith("."), x).otherwise(F.concat(x, F.lit(".")))


def _listed(names: Column, joint: str, last: str) -> Column:
    """One; two with ``joint``; more with commas and ``last`` before the last."""
    n = F.size(names)
    return (
        F.when(n == 1, F.get(names, F.lit(0)))
        .when(n == 2, F.array_join(names, joint))
        .otherwise(F.concat(F.array_join(F.slice(names, F.lit(1), n - 1), ", "), F.lit(last), F.element_at(names, -1)))
    )


def entry_names(style: str, people: Column) -> Column:
    """The authors of an entry; empty without any."""
    n = F.size(people)
    if style == "APA":
        names = F.transform(people, _inverted)
        long = F.concat(F.array_join(F.slice(names, 1, APA_KEPT), ", "), F.lit(", . . . "), F.element_at(names, -1))
        full = _stopped(F.when(n <= APA_MOST, _listed(names, ", & ", ", & ")).otherwise(long))
    elif style == "CHICAGO":
        names = F.transform(people, lambda a, i: F.when(i == 0, _inverted(a)).otherwise(_natural(a)))
        long = F.concat(F.array_join(F.slice(names, 1, CHICAGO_KEPT), ", "), F.lit(", et al"))
        full = _stopped(F.when(n <= CHICAGO_MOST, _listed(names, ", and ", ", and ")).otherwise(long))
    else:
        names = F.transform(people, _natural)
        long = F.concat(F.array_join(F.slice(names, 1, IEEE_KEPT), ", "), F.lit(", et al."))
        full = F.when(n <= IEEE_MOST, _listed(names, " and ", ", and ")).otherwise(long)
    return F.when(n == 0, "").otherwise(full)


def entry(style: str, people: Column, title: Column, year: Column, suffix: Column, number: Column, source: Column, link: Column) -> Column:
    """A reference-list entry as plain text."""
    names, has_source, has_link = entry_names(style, people), F.coalesce(source, F.lit("")) != "", F.coalesce(link, F.lit("")) != ""
    title = F.when(F.coalesce(title, F.lit("")) == "", "Untitled").otherwise(title)
    nothing = F.lit("")
    if style == "APA":
        return F.concat(
            F.when(names != "", F.concat(names, F.lit(" "))).otherwise(nothing),
            F.lit("("), year_text(year), suffix, F.lit("). "), title, F.lit(". "),
            F.when(has_source, source).otherwise(nothing),
            F.when(has_link, F.concat(F.when(has_source, ", ").otherwise(" "), link)).otherwise(nothing),
        )
    if style == "CHICAGO":
        return F.concat(
            F.when(names != "", F.concat(names, F.lit(" "))).otherwise(nothing),
            year_text(year), suffix, F.lit(". “"), title, F.lit(".” "),
            F.when(has_source, F.concat(source, F.when(F.rtrim(source).endswith("."), "").otherwise("."))).otherwise(nothing),
            F.when(has_link, F.concat(F.lit(" "), link)).otherwise(nothing),
        )
    return F.concat(
        F.lit("["), number.cast("string"), F.lit("] "),
        F.when(names != "", F.concat(names, F.lit(", "))).otherwise(nothing),
        F.lit("“"), title, F.lit(",” "),
        F.when(has_source, F.concat(source, F.lit(", "))).otherwise(nothing),
        year_text(year), F.lit("."),
        F.when(has_link, F.concat(F.lit(" [Online]. Available: "), link)).otherwise(nothing),
    )


def reference_link(doi: Column, scopus_url: Column, source_link: Column) -> Column:
    return F.coalesce(F.concat(F.lit("https://doi.org/"), F.nullif(doi, F.lit(""))), scopus_url, source_link)


def joined_in_text(texts: Column) -> Column:
    """Several in-text citations in one pair of brackets."""
    inner = F.array_join(F.transform(texts, lambda t: F.btrim(t, F.lit("()"))), "; ")
    return F.when(F.size(texts) == 0, "").when(F.size(texts) == 1, F.get(texts, F.lit(0))).otherwise(F.concat(F.lit("("), inner, F.lit(")")))


def insertion_offset(sentence: Column) -> Column:
    """Where in a sentence a citation goes: before the punctuation at its end."""
    return F.char_length(F.regexp_replace(sentence, TRAILING_PUNCTUATION, ""))


def spliced(sentence: Column, citation: Column) -> Column:
    at = insertion_offset(sentence)
    return F.concat(F.substr(sentence, F.lit(1), at), F.lit(" "), citation, F.substr(sentence, at + 1))
