"""From normalised text back to the raw text it came from: a map of intervals instead of a number for each character."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters that Python's str.strip() takes for white space.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
_WHITE = np.array([ord(c) for c in WHITE], np.uint32)
RUNS = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("start", "source", "length")]))
MAPPED = T.StructType([T.StructField("normalized", T.StringType()), T.StructField("runs", RUNS)])


def intervals(raw: str) -> tuple[str, np.ndarray]:
    """The normalised text, and rows start, source, length: that many characters from ``start`` on came from ``source`` on.

    Carriage returns go, spaces, tabs and non-breaking spaces become one space for each run of them, which came from the
    first, and white space at both ends goes. Both columns rise strictly.
    """
    points = np.frombuffer(raw.encode("utf-32-le"), np.uint32)
    at = np.flatnonzero(points != 13)
    there = points[at]
    blank = (there == 32) | (there == 9) | (there == 160)
    stays = ~blank
    stays[:1] = True
    stays[1:] |= ~blank[:-1]
    source, out = at[stays], np.where(blank, 32, there)[stays].astype(np.uint32)
    inked = np.flatnonzero(~np.isin(out, _WHITE))
    if not len(inked):
        return "", np.zeros((0, 3), np.int64)
    source, out = source[inked[0] : inked[-1] + 1], out[inked[0] : inked[-1] + 1]
    start = np.concatenate([[0], np.flatnonzero(np.diff(source) != 1) + 1])
    length = np.diff(np.append(start, len(source)))
    return out.tobytes().decode("utf-32-le"), np.column_stack([start, source[start], length])


@F.pandas_udf(MAPPED)
def normalized_with_map(raw: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """normalized and runs of a text (a struct; both null where the text is)."""
    for batch in raw:
        made = [(None, None) if text is None else intervals(text) for text in batch]
        names = ("start", "source", "length")
        yield pd.DataFrame({"normalized": [t for t, _ in made], "runs": [None if r is None else [dict(zip(names, x)) for x in r.tolist()] for _, r in made]})


def source_offset(runs: Column, offset: Column) -> Column:
    """Where the character at ``offset`` of the normalised text stands in the raw text; null beyond either end. The run is found
    by halving the runs, 31 times at most."""
    last = F.get(runs, F.size(runs) - 1)

    def halve(state: Column, _: Column) -> Column:
        middle = F.shiftright(state["low"] + state["high"] + 1, 1)
        right = F.get(runs, middle)["start"] <= offset
        return F.struct(F.when(right, middle).otherwise(state["low"]).alias("low"), F.when(right, state["high"]).otherwise(F.greatest(middle - 1, state["low"])).alias("high"))

    rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(F.size(runs), F.lit(1)) + 1)).cast("int")))
    found = F.aggregate(rounds, F.struct(F.lit(0).alias("low"), (F.size(runs) - 1).alias("high")), halve, lambda state: F.get(runs, state["low"]))
    inside = (offset >= 0) & (offset < last["start"] + last["length"])
    return F.when(inside, F.transform(F.array(found), lambda r: r["source"] + offset - r["start"])[0]).cast("int")


def source_span(runs: Column, start: Column, end: Column) -> Column:
    """The span (start, end) of the raw text that a span of the normalised text came from; null for empty spans."""
    whole = F.struct(source_offset(runs, start).alias("start"), (source_offset(runs, end - 1) + 1).alias("end"))
    return F.when((end > start) & whole["start"].isNotNull() & whole["end"].isNotNull(), whole)
