"""Verification of candidates: what is known or can't be read needs no call, the rest is asked claim by claim, and answers become a cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import VERDICT_SCORES
from .models import AnswerError, by_number
from .staging import written_once

#: Candidates of a claim in one call.
AT_ONCE = 3
TOLD = ("evidence", "limitations", "recommended_usage")
# What is told of candidates without an abstract, and of those that could not be verified.
NO_ABSTRACT = ("", "No abstract could be retrieved for this reference, so its support cannot be assessed.", "Do not cite without checking the full text")
UNAVAILABLE = ("", "Automatic verification was unavailable for this candidate.", "Review manually")

#: From a claim, its context, its candidates (title, abstract, keywords) and, the second time, what was wrong with the first answer, to
#: verdicts: dicts of idx (a candidate's number in the call), verdict and, if known, evidence, limitations and recommended_usage.
Ask = Callable[[str, str, list[dict], str | None], list[dict]]


@dataclass
class Verified:
    """``outcomes``: the candidates with verdict, support_score, TOLD and from_cache; ``entries``: claim_hash, ref_id, verdict, TOLD, which
    the cache doesn't have yet."""

    outcomes: DataFrame
    entries: DataFrame


def checked(verdicts) -> list[dict]:
    """``verdicts`` if they are of the form agreed on, else an AnswerError that says what is wrong."""
    if not isinstance(verdicts, list):
        raise AnswerError("a list of verdicts is needed")
    for v in verdicts:
        if not isinstance(v, dict) or type(v.get("idx")) is not int:
            raise AnswerError("each verdict needs idx, a whole number")
        if v.get("verdict") not in VERDICT_SCORES:
            raise AnswerError(f"verdict must be one of {', '.join(VERDICT_SCORES)}")
        if any(not isinstance(v.get(c, ""), str) for c in TOLD):
            raise AnswerError(f"{', '.join(TOLD)} must be texts")
    return verdicts


def answer(ask: Ask, claim: str, context: str, candidates: list[dict], fallback: Ask | None = None) -> list[dict | None]:
    """A verdict for each candidate (by_number()), None where there is none or the call failed."""
    call = lambda told: lambda given, fault: told(claim, context, given, fault)
    try:
        return by_number(call(ask), candidates, checked, call(fallback) if fallback else None)
    except Exception:  # noqa: BLE001 - a call that fails, however it does, leaves its candidates to a reader
        return [None] * len(candidates)


def verified(candidates: DataFrame, cache: DataFrame, ask: Ask, at_once: int = AT_ONCE, fallback: Ask | None = None) -> Verified:
    """``candidates`` (claim_id, claim_hash, claim_text, claim_context, ref_id, place, title, abstract, keywords and more) with their verdicts.

    First what ``cache`` (claim_hash, ref_id, verdict, TOLD) holds; then candidates with a blank abstract, which are
    INSUFFICIENT_EVIDENCE without a call; the others are asked, up to ``at_once`` of a claim in one call, in order of place (a batch of a
    Spark task goes on to the next claim when one has failed). Those without an answer are SKIPPED. New verdicts are entries, one for each
    claim_hash and ref_id; blank, skipped and held ones are none. Calls are made once, however often the results are read.
    """
    names = candidates.columns
    held = cache.select("claim_hash", "ref_id", F.struct("verdict", *TOLD).alias("_held")).dropDuplicates(["claim_hash", "ref_id"])
    blank = F.trim(F.coalesce("abstract", F.lit(""))) == ""
    planned = written_once(candidates.join(held, ["claim_hash", "ref_id"], "left").withColumn("_blank", blank), "planned")
    pending = planned.where("_held is null and not _blank")
    number = F.row_number().over(Window.partitionBy("claim_id").orderBy("place", "ref_id")) - 1
    calls = pending.withColumn("_n", number).groupBy("claim_id", F.floor(F.col("_n") / at_once).alias("_call"))
    calls = calls.agg(F.first("claim_text").alias("claim"), F.first("claim_context").alias("context"), F.array_sort(F.collect_list(F.struct("_n", "ref_id", "title", "abstract", "keywords"))).alias("c"))
    kinds = {c: candidates.schema[c].dataType.simpleString() for c in ("claim_id", "ref_id")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {c: [] for c in ("claim_id", "ref_id", "verdict", *TOLD)}
            for call in batch.to_pylist():
                given = [{"title": c["title"] or "", "abstract": c["abstract"], "keywords": c["keywords"] or []} for c in call["c"]]
                for c, v in zip(call["c"], answer(ask, call["claim"] or "", call["context"] or "", given, fallback)):
                    rows["claim_id"].append(call["claim_id"])
                    rows["ref_id"].append(c["ref_id"])
                    rows["verdict"].append(v and v["verdict"])
                    for t in TOLD:
                        rows[t].append(v and v.get(t, ""))
            types = {"claim_id": batch.schema.field("claim_id").type, "ref_id": batch.schema.field("c").type.value_type.field("ref_id").type}
            yield pa.RecordBatch.from_arrays([pa.array(v, types.get(c, pa.string())) for c, v in rows.items()], list(rows))

    schema = f"claim_id {kinds['claim_id']}, ref_id {kinds['ref_id']}, verdict string, {', '.join(f'{t} string' for t in TOLD)}"
    told = written_once(calls.select("claim_id", "claim", "context", "c").mapInArrow(run, schema).where("verdict is not null"), "verdicts")
    asked = told.select("claim_id", "ref_id", F.struct("verdict", *TOLD).alias("_told"))
    whole = planned.join(asked, ["claim_id", "ref_id"], "left")
    fixed = lambda verdict, texts: F.struct(F.lit(verdict).alias("verdict"), *(F.lit(t).alias(c) for c, t in zip(TOLD, texts)))
    outcome = F.coalesce("_held", F.when(F.col("_blank"), fixed("INSUFFICIENT_EVIDENCE", NO_ABSTRACT)), "_told", fixed("SKIPPED", UNAVAILABLE))
    whole = whole.withColumn("_o", outcome)
    worth = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in VERDICT_SCORES.items() for x in kv]), F.col("_o.verdict")), F.lit(0.0))
    outcomes = whole.select(*names, F.col("_o.verdict").alias("verdict"), worth.alias("support_score"), *(F.col(f"_o.{t}").alias(t) for t in TOLD), F.col("_held").isNotNull().alias("from_cache"))
    new = whole.where("_held is null and not _blank and _told is not null").groupBy("claim_hash", "ref_id").agg(F.min_by("_told", "claim_id").alias("t"))
    return Verified(outcomes, new.select("claim_hash", "ref_id", "t.verdict", *(f"t.{t}" for t in TOLD)))
