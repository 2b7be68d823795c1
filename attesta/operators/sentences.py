"""Sentence ends learned from the drafts themselves: abbreviations and sentence starters by log-likelihood (Punkt), then one pass over the blocks.

A period ends a sentence unless it belongs to an abbreviation. What is one shows in all drafts together: a short word that
hardly stands without its period, more often than chance has it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import rounded
from .drafts import ABBREVIATIONS
from .staging import removed, written_once

# Fixed values of the method: the score that makes an abbreviation, the likelihood that makes a starter, and the chance that
# an abbreviation has its period.
LEAST_ABBREVIATION, LEAST_STARTER, WITH_PERIOD = 0.3, 30.0, 0.99
#: The learned words go to every task.
MOST_WORDS = 200_000

_END = re.compile(r"[.!?][)\]\"'”’]*(\s+)(?=[\"'“‘(\[]*\S)")
_OPENING = "\"'“‘(["


@dataclass(frozen=True)
class SentenceModel:
    """``abbreviations``, in lower case without the last period; ``starters``: words that often begin sentences; ``names``: words that also
    stand capitalised inside sentences, after which a break is no safe guess."""

    abbreviations: frozenset[str] = field(default_factory=frozenset)
    starters: frozenset[str] = field(default_factory=frozenset)
    lower: frozenset[str] = field(default_factory=frozenset)


def _tokens(texts: DataFrame) -> DataFrame:
    """word (lower case, bare), dot (ends in a period), upper (begins with a capital), after (the word before ends in a period), end
    (the word before ends in ! or ?), before (the word before): a row for each word of a text column named text."""
    each = texts.select(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda t: t != "").alias("t")).select("t", F.posexplode("t").alias("i", "raw"))
    bare = lambda t: F.regexp_replace(F.regexp_replace(t, r"^[\"'“‘(\[]+", ""), r"[)\]\"'”’,;:]+$", "")
    word, last = bare(F.col("raw")), bare(F.when(F.col("i") > 0, F.get("t", F.col("i") - 1)))
    return each.select(
        F.lower(F.regexp_replace(word, r"[.!?]+$", "")).alias("word"), word.rlike(r"[^.]\.$").alias("dot"), word.rlike(r"^\p{Lu}").alias("upper"),
        F.coalesce(last.rlike(r"[^.]\.$"), F.lit(False)).alias("after"), (F.col("i").eqNullSafe(0) | F.coalesce(last.rlike(r"[!?]$"), F.lit(False))).alias("first"),
        F.lower(F.regexp_replace(last, r"[.!?]+$", "")).alias("before"),
    )


def _likelihood(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Dunning's statistic that a word's chance k1 / n1 in one place differs from its chance k2 / n2 elsewhere."""
    p, p1, p2 = (k1 + k2) / (n1 + n2), k1 / n1, k2 / n2
    term = lambda k, n, x: F.when(k > 0, k * F.ln(x)).otherwise(0.0) + F.when(n > k, (n - k) * F.ln(1 - x)).otherwise(0.0)
    return 2 * (term(k1, n1, p1) + term(k2, n2, p2) - term(k1, n1, p) - term(k2, n2, p))


def abbreviation_scores(tokens: DataFrame) -> DataFrame:
    """word, score (six decimals) of the words with letters that stand with a period somewhere: those from LEAST_ABBREVIATION on are abbreviations.

    The log-likelihood that the word nearly always has its period, less for each letter, more for each period inside, and less
    for each time it stands without.
    """
    counts = tokens.where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.count_if("dot").alias("dots"))
    totals = counts.agg(F.sum("n").alias("all"), F.sum("dots").alias("all_dots"))
    rows = counts.where(r"dots > 0 and word rlike '\\p{L}' and not word rlike '[^\\p{L}\\p{N}.]'").join(F.broadcast(totals), F.lit(True))
    chance, without = F.col("all_dots") / F.col("all"), F.col("n") - F.col("dots")
    chance_log = lambda p: F.col("dots") * F.ln(p) + F.when(without > 0, without * F.ln(1 - p)).otherwise(0.0)
    periods = F.char_length("word") - F.char_length(F.replace("word", F.lit("."), F.lit(""))) + 1
    letters = F.char_length("word") - periods + 1
    score = 2 * (chance_log(F.lit(WITH_PERIOD)) - chance_log(F.least(chance, F.lit(0.999)))) * F.exp(-letters) * periods * F.pow(letters.cast("double"), -without)
    return rows.select("word", rounded(score, 6).alias("score"))


def starter_scores(tokens: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """word, score (six decimals) of the capitalised words that follow a period which is no abbreviation's more often than chance has it."""
    known = abbreviations.select(F.col("word").alias("before"), F.lit(True).alias("short"))
    breaks = tokens.where("after and upper and word <> ''").join(known, "before", "left").where("short is null").groupBy("word").agg(F.count(F.lit(1)).alias("begins"))
    counts = tokens.where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.sum("n").alias("all")).join(breaks.agg(F.sum("begins").alias("breaks")), F.lit(True))
    rows = breaks.join(counts, "word").join(F.broadcast(totals), F.lit(True))
    elsewhere, rest = F.col("n") - F.col("begins"), F.greatest(F.col("all") - F.col("breaks"), F.lit(1))
    more = F.col("begins") / F.col("breaks") > elsewhere / rest
    score = F.when(more, _likelihood(F.col("begins"), F.col("breaks"), F.least(elsewhere, rest), rest)).otherwise(0.0)
    return rows.select("word", rounded(score, 6).alias("score"))


def learned(texts: DataFrame) -> SentenceModel:
    """The model of ``texts`` (text): counts over all of them stay in Spark, the words that matter, MOST_WORDS at most, come back."""
    tokens = written_once(_tokens(texts), "tokens")
    short = written_once(abbreviation_scores(tokens).where(F.col("score") >= LEAST_ABBREVIATION).select("word"), "abbreviations")
    starters = starter_scores(tokens, short).where(F.col("score") >= LEAST_STARTER).select("word")
    # Words that follow an abbreviation matter only: whether they are seen in lower case, and never capitalised inside a sentence.
    seen = tokens.where("word <> ''").groupBy("word").agg(F.count_if(~F.col("upper")).alias("lower"), F.count_if(F.col("upper") & ~F.col("after") & ~F.col("first")).alias("inside"))
    follow = tokens.where("after and upper").join(short.select(F.col("word").alias("before")), "before", "left_semi").select("word").distinct()
    plain = seen.where("lower > 0 and inside = 0").join(follow, "word", "left_semi").select("word")
    sets = []
    for df in (short, starters, plain):
        words = [r.word for r in df.limit(MOST_WORDS + 1).collect()]
        if len(words) > MOST_WORDS:
            raise ValueError(f"over {MOST_WORDS} words of a kind: are these texts prose?")
        sets.append(frozenset(words))
    removed(tokens, short)
    return SentenceModel(*sets)


KNOWN = frozenset(a.removesuffix(".").lower() for a in ABBREVIATIONS)


def spans(text: str, model: SentenceModel) -> list[tuple[int, int]]:
    """Start and end of each sentence: text[start:end] is the sentence, without the white space around it."""
    out, start = [], len(text) - len(text.lstrip())
    for m in _END.finditer(text):
        following = text[m.end() :].lstrip(_OPENING)[:1] if text[m.end()] in _OPENING else text[m.end()]
        if not (following.isupper() or following.isdigit() or text[m.end()] in _OPENING):
            continue
        if text[m.start()] == ".":
            begin = max(text.rfind(c, start, m.start()) for c in " \t\n\xa0") + 1
            word = text[max(begin, start) : m.start()].lstrip(_OPENING).lower()
            if len(word) == 1 and word.isalpha() and text[m.start() - 1].isupper():
                continue  # an initial
            if word in KNOWN or word in model.abbreviations:
                after = re.match(r"[^\s.!?,;:)\]]*", text[m.end() :].lstrip(_OPENING)).group().lower()
                if word in KNOWN or not (following.isupper() and (after in model.starters or after in model.lower)):
                    continue
        out.append((start, m.start(1)))
        start = m.end()
    end = len(text.rstrip())
    return [*out, (start, end)] if end > start else out


def learned_sentences(blocks: DataFrame, model: SentenceModel) -> DataFrame:
    """Sentences of the blocks (drafts.assembled) that aren't headings, as drafts.sentences() has them, cut by the model."""
    held = blocks.sparkSession.sparkContext.broadcast(model)
    kept = blocks.where("not is_heading").select("draft_id", "paragraph_index", "text", F.col("char_start").cast("long").alias("char_start"), "section_title")
    names = ["draft_id", "paragraph_index", "sentence_index", "text", "char_start", "char_end", "section_title"]
    kinds = dict(kept.dtypes) | {"sentence_index": "int", "char_end": "long"}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers, texts, starts, ends = [], [], [], [], []
            for i, (text, first) in enumerate(zip(batch.column("text").to_pylist(), batch.column("char_start").to_pylist())):
                for k, (a, b) in enumerate(spans(text or "", held.value)):
                    rows.append(i)
                    numbers.append(k)
                    texts.append(text[a:b])
                    starts.append(first + a)
                    ends.append(first + b)
            of = {n: batch.column(n).take(pa.array(rows, pa.int64())) for n in ("draft_id", "paragraph_index", "section_title")}
            of |= {"sentence_index": pa.array(numbers, pa.int32()), "text": pa.array(texts, pa.string()), "char_start": pa.array(starts, pa.int64()), "char_end": pa.array(ends, pa.int64())}
            yield pa.RecordBatch.from_arrays([of[n] for n in names], names)

    return kept.mapInArrow(cut, ", ".join(f"{n} {kinds[n]}" for n in names))
