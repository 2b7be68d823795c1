"""Best-fit packing of documents into training sequences of several permitted lengths.

Only ids and lengths move. They are dealt evenly over packing groups of bounded volume, so
a task holds the pieces of one group. In a group, pieces go by falling length into the open
bin with the least room that takes them; where none does, the bin size with the least cost a
packed token opens. At the end every bin shrinks to the least permitted length of its contents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import names_apart, table

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Tokens of a packing group, on average; bins are only shared within a group.
GROUP_TOKENS = 16 << 20
#: What a token costs besides, in a sequence as long as this one, against attention in it.
ATTENTION_LENGTH = 16384
PACKED = "bin_id long, bin_capacity int, bin_used int, bin_offset int"


def sequence_cost(capacity: int) -> float:
    """Of a sequence: linear in its tokens, with attention growing with its square."""
    return capacity * (1 + capacity / ATTENTION_LENGTH)


class VariableBins:
    """Open bins by the room they have left; ``put`` gives the bin and the offset of a piece."""

    def __init__(self, capacities: tuple[int, ...], to_come: int):
        self.capacities, self.to_come = sorted(capacities), to_come
        self.used: list[int] = []
        self.opened: list[int] = []
        self._by_room: list[list[int]] = [[] for _ in range(self.capacities[-1] + 1)]
        self._rooms = 0  # bit r is set when a bin has room r

    def put(self, length: int) -> tuple[int, int]:
        self.to_come -= length
        fitting = self._rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            k = self._by_room[room].pop()
            if not self._by_room[room]:
                self._rooms &= ~(1 << room)
        else:
            # What can still come fills the room, at best: the cost is shared by that many tokens.
            size = min((c for c in self.capacities if c >= length), key=lambda c: (sequence_cost(c) / (length + min(c - length, self.to_come)), c))
            k, room = len(self.used), size
            self.used.append(0)
            self.opened.append(size)
        at = self.used[k]
        self.used[k] += length
        if room > length:
            self._by_room[room - length].append(k)
            self._rooms |= 1 << (room - length)
        return k, at

    def downsized(self) -> np.ndarray:
        """By bin, the least permitted length that holds its contents."""
        sizes = np.array(self.capacities)
        return sizes[np.searchsorted(sizes, np.array(self.used, np.int64))]


@names_apart("_bp_")
def pack(docs: DataFrame, length: Column, capacities: tuple[int, ...] = CAPACITIES, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Rows of ``docs``, one for each piece, with piece, start, n_tokens, bin_id, bin_capacity, bin_used and bin_offset.

    A document longer than the largest capacity is cut into pieces of that length and a rest. ``length`` counts tokens;
    a row where it is null or less than 1 counts as 1 (a lone separator). Pieces of equal length, repeated rows
    included, are packed in no fixed order. An empty table gives no rows. Columns with these names are replaced. Carry
    ids rather than texts: all columns of ``docs`` are shuffled.
    """
    names = ["piece", "start", "n_tokens", "bin_id", "bin_capacity", "bin_used", "bin_offset"]
    largest = max(capacities)
    sized = docs.withColumn("_bp_length", F.greatest(F.coalesce(length, F.lit(1)), F.lit(1)).cast("long")).drop(*names)
    pieces = sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_bp_length - 1) div {largest}")))).withColumns(
        {"start": F.col("piece") * largest, "n_tokens": F.least(F.lit(largest), F.col("_bp_length") - F.col("piece") * largest).cast("int")}
    )
    total = sized.agg(F.coalesce(F.sum("_bp_length"), F.lit(0))).first()[0]
    dealt = pieces.drop("_bp_length").repartition(max(1, -(-total // group_tokens))).withColumn("_bp_group", F.spark_partition_id().cast("long"))

    def fill(batches):
        rows = list(batches)
        if not rows:
            return
        all_rows = pd.concat(rows, ignore_index=True)
        n = all_rows.n_tokens.to_numpy()
        bins = VariableBins(capacities, int(n.sum()))
        order = np.argsort(-n, kind="stable")
        placed = np.zeros((len(n), 2), np.int64)
        placed[order] = [bins.put(int(x)) for x in n[order]] if len(n) else placed
        k = placed[:, 0]
        yield all_rows.assign(
            bin_id=(all_rows["_bp_group"].to_numpy() << 32) + k,
            bin_capacity=bins.downsized()[k].astype("int32") if len(n) else np.zeros(0, "int32"),
            bin_used=np.array(bins.used, "int32")[k],
            bin_offset=placed[:, 1].astype("int32"),
        )[list(all_rows.columns[:-1]) + ["bin_id", "bin_capacity", "bin_used", "bin_offset"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields[:-1])
    return dealt.mapInPandas(fill, f"{schema}, {PACKED}")


def word_count(text: Column) -> Column:
    """Words between white space, and one for the separator; the stand-in for a tokenizer's count."""
    return (F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) + 1).cast("long")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed by words into sequences of 512 to 8192."""
    docs = table(spark, sf_dir, "documents").select("doc_id", word_count(F.col("text")).alias("doc_tokens"))
    return pack(docs, F.col("doc_tokens"))
