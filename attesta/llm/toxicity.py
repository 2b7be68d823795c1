"""Toxicity from two Kneser-Ney models of text, one of toxic and one of ordinary documents.

A document's score comes from the difference of its two log-likelihoods a byte. The models
predict each byte of the lower-cased text from the three before it and discount what their
class has seen; the mass that is left goes to a shared Kneser-Ney model, so expressions that are
rare in the labelled text weigh nearly the same in either. Its continuation counts, down to single
bytes, come from the table of all runs of five bytes in all documents, which stays in Spark and grows with
them; the labelled sample only looks up what it needs. (Models of whole words rank held-out documents far worse
here: most words are rare, and toxic wordings also show in parts of words.) A logistic
curve, fitted on labelled documents that the models have not seen, turns the difference into
a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, named_batch, row_slices, slices, small_batches, staged, table

#: The models and the curve are fitted on this many labelled documents of each class at most, of this many bytes of
#: text each at most: those with the smallest hashes of their ids. It bounds the models' size on driver and executors.
TRAIN_DOCS = 4000
TRAIN_BYTES = 1 << 16
#: Of labels with more grades than this there is an error, as each is a job of its own.
MOST_GRADES = 16
DISCOUNT = 0.75
ORDER = 4
#: The runs of bytes whose first bytes are counted in the continuation counts of the shared model's highest order.
LONG = ORDER + 1
#: Runs that a task holds before it hands them on.
HELD_GRAMS = 1 << 20
#: Added to a text's length when the ratio is divided by it: a few bytes alone tell little.
FLOOR_BYTES = 64


@dataclass
class ToxicityModel:
    code: np.ndarray  # by byte, its place in the alphabet of the models (0: none)
    size: int  # of the alphabet
    row: np.ndarray  # by three codes, the row of ``llr``
    llr: np.ndarray  # by row and code, the log of the next byte's probabilities' ratio
    slope: float = 1.0
    offset: float = 0.0

    def cells(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By byte of a padded text, row and code."""
        c = self.code[text]
        at = np.zeros(len(c), np.int64)
        at[3:] = (c[:-3].astype(np.int64) * self.size + c[1:-2]) * self.size + c[2:-1]
        return self.row[at], c

    def ratio(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """By document, the log-likelihood ratio a byte (0 without text)."""
        text, starts = _padded(data, off)
        total = np.zeros(len(text) + 1)
        if len(text):
            np.cumsum(self.llr[self.cells(text)], dtype=np.float64, out=total[1:])
        n = np.diff(off)
        return (total[starts + n] - total[starts]) / (n + FLOOR_BYTES)

    def score(self, ratio: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * ratio + self.offset, -30, 30)))


def _padded(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased documents with four spaces before each, and where each starts behind them."""
    n = len(off) - 1
    pad = LONG - 1
    out = np.full(len(data) + pad * n, 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(pad * np.arange(1, n + 1), np.diff(off))] = LOWER[data]
    return out, off[:-1] + pad * np.arange(1, n + 1)


def _grams(text: np.ndarray, k: int) -> np.ndarray:
    """The last k bytes at each byte, as a number; the first k - 1 places are of the padding before them."""
    out = text.astype(np.int64)
    for i in range(1, k):
        out[i:] |= text[:-i].astype(np.int64) << (8 * i)
    return out


GRAMS = "gram long, toxic long, ordinary long"
GRAMS_ARROW = pa.schema([("gram", pa.int64()), ("toxic", pa.int64()), ("ordinary", pa.int64())])


def _inner(text: np.ndarray, off: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether a byte of the padded text belongs to a document."""
    n = np.diff(off)
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def _class_counts(batches):
    for batch in batches:
        toxic = np.array(batch.column("toxic").to_pylist(), np.int64)
        at = 0
        for part, data, off in slices(batch.select(["text"])):
            text, starts = _padded(data, off)
            inner = _inner(text, off, starts)
            found, of = np.unique(_grams(text, ORDER)[inner], return_inverse=True)
            is_toxic = np.repeat(toxic[at : at + part.num_rows], np.diff(off))
            yield named_batch(GRAMS_ARROW, gram=found, toxic=np.bincount(of, is_toxic, len(found)).astype(np.int64), ordinary=np.bincount(of, 1 - is_toxic, len(found)).astype(np.int64))
            at += part.num_rows


GRAM_ARROW = pa.schema([("gram", pa.int64())])


def _long_grams(most: int):
    def grams(batches):
        held = np.zeros(0, np.int64)
        for batch in batches:
            for _, data, off in slices(batch):
                text, starts = _padded(data, off)
                if len(text):
                    held = np.union1d(held, _grams(text, LONG)[_inner(text, off, starts)])
                if len(held) > most:
                    yield named_batch(GRAM_ARROW, gram=held)
                    held = held[:0]
        yield named_batch(GRAM_ARROW, gram=held)

    return grams


def _last(gram: Column, k: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << 8 * k) - 1))


def continuations(docs: DataFrame) -> list[DataFrame]:
    """For each order from 1 to ORDER: gram, n, by how many different bytes it is preceded in all ``docs``, and the sum
    (whole) and number (kinds) of n over the grams of its context."""
    long = docs.select("text").mapInArrow(_long_grams(HELD_GRAMS), "gram long").distinct()
    counts = [staged(long.groupBy(_last(F.col("gram"), ORDER).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "grams")]
    for k in range(ORDER - 1, 0, -1):
        counts.insert(0, counts[0].groupBy(_last(F.col("gram"), k).alias("gram")).agg(F.count(F.lit(1)).alias("n")))
    context = Window.partitionBy(F.shiftright("gram", 8))  # of 256 grams at most
    return [c.withColumns({"whole": F.sum("n").over(context), "kinds": F.count(F.lit(1)).over(context)}) for c in counts]


def _with_continuations(grams: DataFrame, docs: DataFrame) -> DataFrame:
    """``grams`` with n, whole and kinds of their last k bytes, for each k from 1 to ORDER."""
    for k, counts in enumerate(continuations(docs), 1):
        counts = counts.select(F.col("gram").alias("_last"), *(F.col(c).alias(f"{c}{k}") for c in ("n", "whole", "kinds")))
        grams = grams.join(counts, _last(F.col("gram"), k) == F.col("_last"), "left").drop("_last")
    return grams


def _shared(found: pa.Table) -> np.ndarray:
    """By gram, the shared model's probability of its last byte after the others."""
    out = np.full(found.num_rows, 1 / 256)
    for k in range(1, ORDER + 1):
        n, whole, kinds = (found[f"{c}{k}"].to_numpy() for c in ("n", "whole", "kinds"))
        out = (n - DISCOUNT + DISCOUNT * kinds * out) / whole
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method, with a weak prior on the slope."""
    a = b = 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        r = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - y) * x).sum() + 1e-4 * a, (p - y).sum()])
        hess = np.array([[(r * x * x).sum() + 1e-4, (r * x).sum()], [(r * x).sum(), r.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        step *= min(1.0, 20 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def held_out(doc_id: Column) -> Column:
    """Documents kept from all fitting: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, grade: Column, per_grade: int, max_bytes: int) -> DataFrame:
    """doc_id, text and grade of at most ``per_grade`` labelled documents of each grade, none of them held out."""
    marked = labels.select("doc_id", grade.cast("int").alias("grade")).where(F.col("grade").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    # Only ids and sizes are ranked; the texts of the sample follow by a second join.
    ids = docs.select("doc_id", F.octet_length("text").alias("size")).join(marked, "doc_id").where(F.col("size").between(1, max_bytes))
    grades = [r.grade for r in marked.select("grade").distinct().orderBy("grade").limit(MOST_GRADES + 1).collect()]
    if len(grades) > MOST_GRADES:
        raise ValueError(f"labels of more than {MOST_GRADES} grades")
    picked = None
    for g in grades:
        few = ids.where(F.col("grade") == g).select("doc_id", "grade").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_grade)
        picked = few if picked is None else picked.unionByName(few)
    if picked is None:
        return marked.join(docs.select("doc_id", "text"), "doc_id").limit(0)
    return docs.select("doc_id", "text").join(F.broadcast(picked.dropDuplicates(["doc_id"])), "doc_id").where(F.octet_length("text") <= max_bytes)


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_DOCS, max_bytes: int = TRAIN_BYTES) -> ToxicityModel:
    """The models and the curve, from ``labels`` (doc_id, toxic) of documents that aren't held out and the text of all
    ``docs``. Three quarters of the labelled sample go into the models, the rest into the curve. Without
    documents of both classes every score is the share of toxic ones (0.5 where there are none)."""
    small_batches(docs.sparkSession)
    sample = training_sample(docs, labels, F.col("toxic"), per_class, max_bytes).select("doc_id", "text", (F.col("grade") > 0).cast("long").alias("toxic")).persist()
    tuning = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(4)) == 0
    grams = sample.where(~tuning).select("toxic", "text").mapInArrow(_class_counts, GRAMS).groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    found = _with_continuations(grams, docs).toArrow()
    gram = found["gram"].to_numpy()
    code = np.zeros(256, np.int64)
    used = np.unique(np.concatenate([(gram >> 8 * i) & 255 for i in range(ORDER)])).astype(np.int64)
    code[used] = np.arange(1, len(used) + 1)
    size = len(used) + 1
    a, b, c, byte = (code[(gram >> 8 * i) & 255] for i in range(ORDER - 1, -1, -1))
    contexts, of = np.unique((a * size + b) * size + c, return_inverse=True)
    row = np.full(size**3, len(contexts), np.int32)  # the last row: contexts that the sample lacks
    row[contexts] = np.arange(len(contexts))
    model = ToxicityModel(code.astype(np.int16), size, row, np.zeros((len(contexts) + 1, size), np.float32))
    shared, seen, left = _shared(found), [], []
    for name in ("toxic", "ordinary"):
        n = found[name].to_numpy()
        whole = np.bincount(of, n, len(contexts))
        left.append(np.where(whole > 0, np.bincount(of, np.minimum(n, DISCOUNT), len(contexts)) / np.maximum(whole, 1), 1))
        seen.append(np.maximum(n - DISCOUNT, 0) / np.maximum(whole, 1)[of] + left[-1][of] * shared)
    # Of a byte that neither class has after a context, both have their left mass times the same shared probability, which
    # cancels out; of a context that neither has, both have the shared probability alone, and the ratio's log is 0.
    model.llr[:-1] = np.log(left[0] / left[1])[:, None]
    model.llr[of, byte] = np.log(seen[0] / seen[1])
    ratio = ratio_udf(model, sample.sparkSession)
    tune = sample.where(tuning).select("toxic", ratio("text").alias("ratio")).toPandas()
    # The sample is balanced, documents are not: weigh the curve by the classes' share among all labels.
    n, n_toxic = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("toxic") > 0).cast("long")), F.lit(0))).first()
    share = (n_toxic + 0.5) / (n + 1)
    y, x = tune.toxic.to_numpy(), tune.ratio.to_numpy()
    if 0 < y.sum() < len(y):
        model.slope, model.offset = _logistic(x, y)
        model.offset += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    else:
        model.slope, model.offset = 0.0, float(np.log(share / (1 - share)))
    sample.unpersist()
    return model


def ratio_udf(model: ToxicityModel, spark: SparkSession, score: bool = False):
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def ratio(text: pa.Array) -> pa.Array:
        out = [held.value.ratio(data, off) for _, _, data, off in row_slices(text)]
        out = np.concatenate(out) if out else np.zeros(0)
        return pa.array(held.value.score(out) if score else out)

    return ratio


def with_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with ``toxicity``, the probability from 0 to 1 (a column of this name is replaced). Null and empty texts
    have the probability at a ratio of 0."""
    return docs.withColumn("toxicity", ratio_udf(model, docs.sparkSession, True)("text"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted"))
