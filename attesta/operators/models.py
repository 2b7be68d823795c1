"""Hooks for models: embedding, reranking and answers in batches, inside Arrow tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from ..functions.text import EMBEDDING_DIM
from .staging import written_once


def embedder(load: Callable[[], Callable[[list[str]], np.ndarray]]):
    """A column function from texts to unit vectors; ``load`` runs once a task and gives the model."""

    @pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            x = np.asarray(model(texts.fillna("").to_list()), np.float64)
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            yield pd.Series(list((x / np.where(norm > 0, norm, 1)).astype(np.float32)))

    return encode


def hashed_embedding(texts: DataFrame, key: str, text_column: str, dimensions: int = EMBEDDING_DIM) -> DataFrame:
    """``key``, dim, n, weight: the stand-in embedding of each text. Each word, without what is no letter or digit, counts for the dimension
    that its md5 gives, and weights are counts by their Euclidean length.

    Words are counted inside the rows and each distinct word of a batch is hashed once, so nothing is shuffled; a task holds a batch.
    Texts without words have no rows.
    """
    kind = texts.schema[key].dataType.simpleString()
    words = F.split(F.regexp_replace(F.lower(F.coalesce(F.col(text_column), F.lit(""))), r"[^\p{L}\p{N} \n\t\r]", ""), r"[ \n\t\r]+")

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            flat, row = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
            codes = flat.dictionary_encode()
            dims = np.array([int.from_bytes(hashlib.md5(w.encode(), usedforsecurity=False).digest(), "big") % dimensions if w else -1 for w in codes.dictionary.to_pylist()], np.int64)
            dim = dims[codes.indices.to_numpy()] if len(flat) else np.zeros(0, np.int64)
            keys, n = np.unique(row[dim >= 0] * dimensions + dim[dim >= 0], return_counts=True)
            row = keys // dimensions
            norm = np.sqrt(np.bincount(row, n.astype(float) ** 2, minlength=batch.num_rows))[row] if len(row) else np.zeros(0)
            columns = [batch.column(key).take(pa.array(row)), pa.array((keys % dimensions).astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(n / norm)]
            yield pa.RecordBatch.from_arrays(columns, [key, "dim", "n", "weight"])

    return texts.select(key, words.alias("words")).mapInArrow(embed, f"{key} {kind}, dim long, n long, weight double")


def reranker(load: Callable[[], Callable[[list[tuple[str, str]]], np.ndarray]]):
    """A column function from query and document to a score from 0 to 1, the sigmoid of the model's output."""

    @pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for queries, docs in batches:
            yield pd.Series(1 / (1 + np.exp(-np.asarray(model(list(zip(queries, docs, strict=True))), np.float64))))

    return score


def answered(rows: DataFrame, cache: DataFrame, keys: list[str], ask: Callable[[list[dict]], list[dict | None]], answer_schema: str, size: int = 25) -> DataFrame:
    """keys and answer for ``rows``: from ``cache``, else asked for in batches of ``size``; null where an answer failed.

    ``ask`` gets rows as dicts and gives as many dicts of ``answer_schema``, None for failures.
    """
    names = [c.strip().split(" ")[0] for c in answer_schema.split(",")]
    held_keys = [k for k, _ in rows.dtypes if k in keys]
    key_schema = ", ".join(f"{k} {t}" for k, t in rows.dtypes if k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), size):
                part = batch.iloc[at : at + size]
                given = ask(part.to_dict("records"))
                out = part[held_keys].reset_index(drop=True)
                for n in names:
                    out[n] = [None if g is None else g.get(n) for g in given]
                yield out[held_keys + names]

    pending = rows.join(cache, keys, "left_anti").mapInPandas(run, f"{key_schema}, {answer_schema}")
    held = cache.join(rows.select(*keys).distinct(), keys, "left_semi").select(*keys, *names)
    return held.unionByName(pending)


class AnswerError(ValueError):
    """An answer that isn't of the form agreed on."""


def by_number(ask: Callable, given: list, check: Callable[[object], list[dict]], fallback: Callable | None = None) -> list[dict | None]:
    """The answer to each of ``given``, None where there is none; ``ask(given, fault)`` gives dicts with idx, a number in ``given``.

    ``check`` returns an answer of the form agreed on and raises an AnswerError that says what is wrong otherwise; then ``ask`` is called
    once more with that text. Where it fails all the same, or at once in another way, ``fallback`` is asked, once. Numbers beyond
    ``given`` count for nothing, of two answers for one the last counts. The last error is raised when no call succeeds.
    """

    def repaired() -> list[dict]:
        try:
            return check(ask(given, None))
        except AnswerError as fault:
            return check(ask(given, str(fault)))

    try:
        told = repaired()
    except Exception:
        if fallback is None:
            raise
        told = check(fallback(given, None))
    of = {x["idx"]: x for x in told}
    return [of.get(i) for i in range(len(given))]


@dataclass
class Decisions:
    """``answers``: keys and the answer's fields for all rows that have one; ``entries``: those that the cache doesn't have yet; ``failures``: keys and
    error of the rows whose batch failed."""

    answers: DataFrame
    entries: DataFrame
    failures: DataFrame

    def required(self) -> Decisions:
        """These decisions, or an error if a batch failed. Keep the entries first: a second run then asks for the rest only."""
        lost = self.failures.count()
        if lost:
            raise RuntimeError(f"{lost} rows have no decision: {self.failures.first()['error']}")
        return self


def decided(rows: DataFrame, cache: DataFrame, keys: list[str], ask: Callable, check: Callable, answer_schema: str, size: int = 25, fallback: Callable | None = None) -> Decisions:
    """Decisions on ``rows``: from ``cache`` (``keys`` and the fields of ``answer_schema``), else by ``ask`` in batches of ``size`` (by_number()).

    Rows are numbered within their batch. A row that an answer leaves out has no decision, and none is made up. A batch that fails fails
    the stage, once that is required() of the result, and not the batches beside it. Calls are made once, however often the results are
    read. Repeated keys are asked once.
    """
    names = [c.strip().split(" ")[0] for c in answer_schema.split(",")]
    key_schema = ", ".join(f"{k} {t}" for k, t in rows.dtypes if k in keys)
    held_keys = [k for k, _ in rows.dtypes if k in keys]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), size):
                part = batch.iloc[at : at + size]
                out, error = part[held_keys].reset_index(drop=True), None
                try:
                    told = by_number(ask, part.to_dict("records"), check, fallback)
                except Exception as fault:  # noqa: BLE001 - told by required(), with the rows
                    told, error = [None] * len(part), f"{type(fault).__name__}: {fault}"
                for n in names:
                    out[n] = [None if x is None else x.get(n) for x in told]
                yield out.assign(_told=[x is not None for x in told], _error=error)[[*held_keys, *names, "_told", "_error"]]

    pending = rows.dropDuplicates(keys).join(cache, keys, "left_anti")
    told = written_once(pending.mapInPandas(run, f"{key_schema}, {answer_schema}, _told boolean, _error string"), "decisions")
    new = told.where("_told").select(*keys, *names)
    held = cache.join(rows.select(*keys).distinct(), keys, "left_semi").select(*keys, *names)
    return Decisions(held.unionByName(new), new, told.where("_error is not null").select(*keys, F.col("_error").alias("error")))


def salvaged_json(text: Column, schema: str) -> Column:
    """The first object in a model's answer, also inside prose or a fenced block; null when there is none."""
    return F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), schema)
