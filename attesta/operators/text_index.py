"""An inverted index for BM25: postings in blocks by impact, and searches that open only the blocks that can matter."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import rounded
from .staging import removed, written_once

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Postings in a block; blocks that a search opens first, and how many times more in each next round.
BLOCK, FIRST_BLOCKS, GROWTH = 256, 4, 8
#: Queries' weights go to every task up to this size.
MOST_WEIGHTS = 64 << 20
#: Scores have six decimals; limits get as much slack.
SLACK = 2e-6


def saturation(tf: Column, length: Column, average: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def inverse_frequencies(in_docs: DataFrame, totals: DataFrame) -> DataFrame:
    """token, idf from token, n (its documents) and n_docs: tokens of more than half of the documents get a share of the mean."""
    raw = in_docs.join(F.broadcast(totals.select("n_docs")), F.lit(True)).select("token", (F.ln(F.col("n_docs") - F.col("n") + 0.5) - F.ln(F.col("n") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean), F.lit(True)).select("token", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


@dataclass
class TextIndex:
    """``docs``: ref_id, length, token, tf (arrays); ``postings``: token, block_no, n, most_tf, least_length, ref_ids, in order of impact;
    ``frequencies``: token, n. Additions append rows to all three; frequencies of a token are summed when they are read."""

    docs: DataFrame
    postings: DataFrame
    frequencies: DataFrame
    generation: int = 0

    @staticmethod
    def build(corpus: DataFrame, block: int = BLOCK, generation: int = 0) -> TextIndex:
        """The index of ``corpus`` (ref_id, words; null words: none)."""
        docs = written_once(counted(corpus), "index-docs")
        flat = docs.select("ref_id", "length", F.explode(F.arrays_zip("token", "tf")).alias("t")).select("ref_id", "length", "t.token", "t.tf")
        frequencies = written_once(flat.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "index-frequencies")
        average = docs.agg(F.avg("length").alias("average"))
        impact = saturation(F.col("tf"), F.col("length"), F.col("average"))
        ordered = flat.join(F.broadcast(average), F.lit(True)).select("token", "ref_id", "tf", "length", impact.alias("impact"))
        # Ranges of (token, impact): the postings of a common token lie in several partitions, none has its whole list.
        ordered = ordered.repartitionByRange("token", F.desc("impact"), "ref_id").sortWithinPartitions("token", F.desc("impact"), "ref_id")
        kind = corpus.schema["ref_id"].dataType.simpleString()
        schema = f"token string, block_no long, n long, most_tf long, least_length long, ref_ids array<{kind}>"
        return TextIndex(docs, written_once(ordered.mapInArrow(_blocks(block, generation), schema), "index-postings"), frequencies, generation)

    def added(self, corpus: DataFrame, block: int = BLOCK) -> TextIndex:
        """The index with the documents of ``corpus`` too, none of which it has yet: their postings are blocks of their own, and
        statistics are those of all documents."""
        new = TextIndex.build(corpus, block, self.generation + 1)
        return TextIndex(self.docs.unionByName(new.docs), self.postings.unionByName(new.postings), self.frequencies.unionByName(new.frequencies), new.generation)

    def statistics(self) -> tuple[DataFrame, DataFrame]:
        """token, idf and n_docs, average (length)."""
        totals = self.docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("average"))
        return inverse_frequencies(self.frequencies.groupBy("token").agg(F.sum("n").alias("n")), totals), totals

    def best(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """claim_id, ref_id, bm25 (six decimals), bm25_rank of each query's ``k`` best documents, and claim_id, token, block_no of the
        blocks opened. ``queries``: claim_id, words (repeats count). Documents share a token with the query; ties go to the smaller id.

        In rounds, more blocks each time, the highest first: they give documents, whose exact scores give a score to beat. A document
        in none of the opened blocks cannot beat it once each token has a limit, its blocks above it are opened, and the
        limits of a query's tokens sum to less than that score. Tokens that alone cannot reach it are not
        opened at all, which spares the longest lists, of common tokens. Queries of many common words open most blocks; best_by_scan()
        is made for these.
        """
        idf, totals = self.statistics()
        asked = queries.select("claim_id", F.explode("words").alias("token")).groupBy("claim_id", "token").agg(F.count(F.lit(1)).alias("times"))
        weights = written_once(asked.join(idf, "token").select("claim_id", "token", (F.col("times") * F.col("idf")).alias("weight")), "weights")
        totals = written_once(totals, "totals")
        directory = self.postings.select("token", "block_no", "most_tf", "least_length").join(weights.select("token").distinct(), "token", "left_semi")
        most = F.greatest(F.col("weight"), F.lit(0.0)) * saturation(F.col("most_tf"), F.col("least_length"), F.col("average"))
        bounds = weights.join(directory, "token").join(F.broadcast(totals), F.lit(True)).select("claim_id", "token", "block_no", most.alias("most"))
        bounds = written_once(bounds, "bounds")
        needed, found, opened, first = bounds, None, None, FIRST_BLOCKS
        order = Window.partitionBy("claim_id").orderBy(F.desc("most"), "token", "block_no")
        while found is None or not needed.isEmpty():
            now = written_once(needed.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= first).select("claim_id", "token", "block_no"), "opened")
            new = self._scored(now, weights, totals, found)
            found = written_once(new if found is None else found.unionByName(new), "scored")
            opened = now if opened is None else opened.unionByName(now)
            needed = written_once(_needed(bounds, _first(found, k), k).join(opened, ["claim_id", "token", "block_no"], "left_anti"), "needed")
            first *= GROWTH
        return _first(found, k), opened

    def _scored(self, opened: DataFrame, weights: DataFrame, totals: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """claim_id, ref_id, bm25 of the documents in the ``opened`` blocks (claim_id, token, block_no), but for ``known`` ones."""
        refs = self.postings.select("token", "block_no", "ref_ids").join(opened, ["token", "block_no"]).select("claim_id", F.explode("ref_ids").alias("ref_id")).distinct()
        if known is not None:
            refs = refs.join(known.select("claim_id", "ref_id"), ["claim_id", "ref_id"], "left_anti")
        docs = self.docs.join(refs.select("ref_id").distinct(), "ref_id", "left_semi").select("ref_id", "length", F.explode(F.arrays_zip("token", "tf")).alias("t"))
        return scored_pairs(refs, docs.select("ref_id", "length", "t.token", "t.tf"), weights, totals).withColumn("bm25", rounded(F.col("bm25"), 6))


def counted(corpus: DataFrame) -> DataFrame:
    """ref_id, length, token, tf: of each document of ``corpus`` (ref_id, words) its distinct words and how often it has them. Counted
    inside the rows, without a shuffle; null words are none."""
    kind = corpus.schema["ref_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("words")
            codes = (flat := words.flatten()).dictionary_encode()
            size = max(len(codes.dictionary), 1)
            row = pc.list_parent_indices(words).to_numpy()
            keys, tf = np.unique(row * size + codes.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
            offsets = pa.array(np.searchsorted(keys // size, np.arange(batch.num_rows + 1)), pa.int32())
            length = np.bincount(row, minlength=batch.num_rows) if len(flat) else np.zeros(batch.num_rows, np.int64)
            lists = [pa.ListArray.from_arrays(offsets, v) for v in (codes.dictionary.take(pa.array(keys % size)), pa.array(tf, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("ref_id"), pa.array(length, pa.int64()), *lists], ["ref_id", "length", "token", "tf"])

    words = F.array_compact(F.coalesce("words", F.array().cast("array<string>"))).alias("words")
    return corpus.select("ref_id", words).mapInArrow(count, f"ref_id {kind}, length long, token array<string>, tf array<long>")


def best_by_scan(queries: DataFrame, corpus: DataFrame, k: int, most_bytes: int = MOST_WEIGHTS) -> DataFrame:
    """As TextIndex.best() of all of ``corpus``, without an index: the queries' weights go to every task and the documents pass by once.

    Weights are a table of tokens and queries; over ``most_bytes`` an index is built and searched.
    """
    docs = written_once(counted(corpus), "counted")
    totals = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("average")).first()
    in_docs = docs.select(F.explode("token").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    idf = inverse_frequencies(in_docs, docs.sparkSession.createDataFrame([tuple(totals)], "n_docs long, average double"))
    asked = queries.select("claim_id", F.explode("words").alias("token")).groupBy("claim_id", "token").agg(F.count(F.lit(1)).alias("times"))
    size = asked.agg(F.count_distinct("token"), F.count_distinct("claim_id")).first()
    if size[0] * size[1] * 8 > most_bytes:
        removed(docs)
        return TextIndex.build(corpus).best(queries, k)[0]
    weights = asked.join(idf, "token").select("claim_id", "token", (F.col("times") * F.col("idf")).alias("weight")).collect()
    claims, tokens = (sorted({r[c] for r in weights}) for c in ("claim_id", "token"))
    of_claim, of_token = ({x: i for i, x in enumerate(xs)} for xs in (claims, tokens))
    table, has = np.zeros((len(tokens), len(claims))), np.zeros((len(tokens), len(claims)), np.float32)
    for r in weights:
        table[of_token[r.token], of_claim[r.claim_id]], has[of_token[r.token], of_claim[r.claim_id]] = r.weight, 1
    held = docs.sparkSession.sparkContext.broadcast((table, has))
    kinds = [df.schema[c].dataType for df, c in ((queries, "claim_id"), (corpus, "ref_id"))]
    average, at_once = totals.average or 1.0, max(16, (1 << 21) // max(len(tokens), 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, shares = held.value
        names, vocabulary = pa.array(claims, to_arrow_type(kinds[0])), pa.array(tokens, pa.string())
        last = np.full(len(claims), -np.inf)  # each query's k-th best so far, in this task
        for batch in batches:
            for first in range(0, batch.num_rows, at_once):
                part = batch.slice(first, at_once)
                known = pc.index_in(part.column("token").flatten(), value_set=vocabulary)
                row = pc.list_parent_indices(part.column("token")).to_numpy()
                mine = known.is_valid().to_numpy(zero_copy_only=False)
                row, column, tf = row[mine], known.filter(known.is_valid()).to_numpy(), part.column("tf").flatten().to_numpy()[mine]
                length = part.column("length").to_numpy()[row]
                parts = np.zeros((part.num_rows, len(tokens)))
                parts[row, column] = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))
                scores = np.floor(parts @ weight * 1e6 + 0.5) / 1e6
                scores[(parts > 0).astype(np.float32) @ shares == 0] = -np.inf
                if part.num_rows > k:
                    last = np.maximum(last, -np.partition(-scores, k - 1, axis=0)[k - 1])
                doc, claim = np.nonzero((scores >= last) & (scores > -np.inf))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(claim)), part.column("ref_id").take(pa.array(doc)), pa.array(scores[doc, claim])], ["claim_id", "ref_id", "bm25"])

    found = docs.mapInArrow(score, f"claim_id {kinds[0].simpleString()}, ref_id {kinds[1].simpleString()}, bm25 double")
    return _first(found, k)


def scored_pairs(pairs: DataFrame, postings: DataFrame, weights: DataFrame, totals: DataFrame) -> DataFrame:
    """claim_id, ref_id, bm25 of the ``pairs`` that share a token, from ``postings`` (ref_id, length, token, tf) of their documents.

    ``weights``: claim_id, token, weight; ``totals``: one row with the average length. Pairs meet postings by document, so no
    token brings the documents together that have it.
    """
    asked = postings.join(weights.select("token").distinct(), "token", "left_semi").join(F.broadcast(totals), F.lit(True))
    parts = asked.select("ref_id", "token", saturation(F.col("tf"), F.col("length"), F.col("average")).alias("part"))
    terms = pairs.join(parts, "ref_id").join(weights, ["claim_id", "token"])
    return terms.groupBy("claim_id", "ref_id").agg(F.sum(F.col("weight") * F.col("part")).alias("bm25"))


def _first(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("claim_id").orderBy(F.desc("bm25"), "ref_id")
    return scored.withColumn("bm25_rank", F.row_number().over(order)).where(F.col("bm25_rank") <= k)


def _needed(bounds: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """claim_id, token, block_no, most of the blocks that a document better than the ``k``-th of ``first`` could be in."""
    last = first.where(F.col("bm25_rank") == k).select("claim_id", (F.col("bm25") - SLACK).alias("last"))
    top = bounds.groupBy("claim_id", "token").agg(F.max("most").alias("top"))
    # Tokens from the least bound on are left out, as long as all of them together stay below the score to beat. The rest of
    # that score is shared out among the others, in proportion.
    rising = Window.partitionBy("claim_id").orderBy("top", "token").rowsBetween(Window.unboundedPreceding, 0)
    shares = top.join(last, "claim_id", "left").withColumn("below", F.sum("top").over(rising)).withColumn("out", F.coalesce(F.col("below") < F.col("last"), F.lit(False)))
    of_claim = Window.partitionBy("claim_id")
    spare = F.col("last") - F.sum(F.when(F.col("out"), F.col("top")).otherwise(0.0)).over(of_claim)
    rest = F.sum(F.when(F.col("out"), 0.0).otherwise(F.col("top"))).over(of_claim)
    limits = shares.withColumn("limit", F.when(F.col("out"), float("inf")).when(F.col("last") > 0, F.col("top") * spare / rest).otherwise(float("-inf")))
    return bounds.join(limits.select("claim_id", "token", "limit"), ["claim_id", "token"]).where(F.col("most") >= F.col("limit")).select("claim_id", "token", "block_no", "most")


def _blocks(size: int, generation: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come in order of token and impact; a block ends with its token, its size or its batch. Its number is made of
        # the addition, the partition and its place there.
        made = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            token = batch.column("token")
            codes = token.dictionary_encode().indices.to_numpy()
            tf, length = (batch.column(c).to_numpy() for c in ("tf", "length"))
            starts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            cuts = [c for a, b in zip(starts, starts[1:]) for c in range(a, b, size)]
            ends = [*cuts[1:], len(codes)]
            numbers = (generation << 46) + (TaskContext.get().partitionId() << 24) + made + np.arange(len(cuts))
            made += len(cuts)
            offsets = pa.array([*cuts, len(codes)], pa.int32())
            columns = [token.take(pa.array(cuts)), pa.array(numbers, pa.int64()), pa.array(np.subtract(ends, cuts)), pa.array(np.maximum.reduceat(tf, cuts)), pa.array(np.minimum.reduceat(length, cuts)), pa.ListArray.from_arrays(offsets, batch.column("ref_id"))]
            yield pa.RecordBatch.from_arrays(columns, ["token", "block_no", "n", "most_tf", "least_length", "ref_ids"])

    return cut
