"""Jaccard join of documents on word shingles by vertical partitioning.

Shingles have one global order: rare ones first, by levels of frequency, then by hash. Documents with
equal sets are one class from the start. Two classes that link share a shingle that stands early enough in
either set for the rest to make up the overlap (a positional prefix filter); such pairs are candidates. The order is cut
into fragments, each fragment's overlap of a candidate is counted by itself, and the partial counts are summed per pair.

A large group of texts made from one another would give candidates with the square of its size. So classes that share
prefix shingles gather around a pivot, the class that shares most with them, and each is told by what sets it
apart from its pivot, fragment by fragment: R, the pivot's shingles that it lacks, and A, those that it has besides. For classes
i and j of a pivot of p shingles that share s of these differences, the overlap is p - R_i - R_j + s, so they link when

    (100 + percent) s >= W_i + W_j - (100 - percent) p,    W = 100 R + percent A,

and i links with the pivot itself when W_i <= (100 - percent) p. If both do, they are in one component already; otherwise
s must be positive, and rare differences come first in a prefix filter of their own. Copies with edits of their own
share no rare difference, so hardly a pair of them is looked at, however many there are, and no link is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, NON_SPACE_BYTES, discard, mixed, prefix_hash, row_slices, small_batches, span_hash, staged, table, unused, word_hashes, word_spans
from .components import components

FRAGMENTS = 8
#: Frequent is a shingle in so many documents of a run of so many bytes of text. At most so many, the most frequent ones,
#: are told apart (9 bytes each go to every executor). It changes the order, and how many pairs are looked at; no result.
FREQUENT, COUNT_BYTES, MOST_FREQUENT = 4, 3 << 20, 1 << 20
#: Up to this many representatives' ids go to every executor (8 bytes each); beyond it their texts are joined.
BROADCAST_IDS = 2 << 20
#: Pivots of fewer classes are none: the pairs of a small group are few.
LEAST_GROUP = 8
#: A class gathers around a pivot if so much of their sketches of so many bytes is equal. Both decide how many pairs are looked at; no result.
SKETCH, NEAR_PIVOT = 32, 0.4
#: Unlike texts share a rare shingle by chance, but hardly so many.
EARLY = 8
_SKETCH_EDGES = np.append(np.arange(SKETCH, dtype=np.uint64) << np.uint64(58), np.uint64(2**63))


def shingles(data: np.ndarray, off: np.ndarray, width: int) -> list[np.ndarray]:
    """By row, the distinct shingles of ``width`` words (63-bit hashes, rising), or the one of all words where there are fewer."""
    data = LOWER[data]
    s, e, row = word_spans(data, off, NON_SPACE_BYTES)
    words = word_hashes(data, s, e)
    prefix = prefix_hash(words)
    first = np.searchsorted(row, np.arange(len(off)))
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    of = np.repeat(np.arange(len(n)), count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[of]
    hashes = span_hash(prefix, start, start + np.minimum(width, n)[of]) >> np.uint64(1)
    return [np.unique(x) for x in np.split(hashes, np.cumsum(count)[:-1])] if len(n) else []


def set_id(x: np.ndarray) -> int:
    """One number for a set of shingles."""
    with np.errstate(over="ignore"):
        return int((mixed(x + np.uint64(len(x))).sum(dtype=np.uint64)).astype(np.int64)) if len(x) else 0


def _ordered(x: np.ndarray, frequent: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The set in the global order: by level (0 for all that aren't among the frequent ones), then by hash."""
    if not len(frequent) or not len(x):
        return x
    at = np.searchsorted(frequent, x)
    at[at == len(frequent)] = 0
    own = np.where(frequent[at] == x, level[at], 0)
    return x[np.argsort(own, kind="stable")]


def _frequent(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, and of each the level of its frequency (steps of a quarter more)."""

    def often(parts: list[np.ndarray]) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found[n >= FREQUENT].astype(np.int64)), pa.array(n[n >= FREQUENT])], ["shingle", "n"])

    def count(batches):
        held, size = [], 0
        for batch in batches:
            for _, _, data, off in row_slices(batch.column("text")):
                held += shingles(data, off, width)
                size += len(data)
                if size > COUNT_BYTES:
                    yield often(held)
                    held, size = [], 0
        if held:
            yield often(held)

    top = docs.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "shingle").limit(MOST_FREQUENT)
    found = top.select("shingle", F.floor(F.log(1.25, "n")).cast("byte").alias("level")).toArrow()
    order = np.argsort(found["shingle"].to_numpy())
    return found["shingle"].to_numpy()[order].astype(np.uint64), found["level"].to_numpy()[order]


def _needed(n: np.ndarray, percent: int) -> np.ndarray:
    return (percent * n + 99) // 100


def _prefixes(docs: DataFrame, frequent, width: int, percent: int) -> DataFrame:
    """shingle, cid, n (size of the set), pos (place in it): the prefix of each class, once a batch."""

    def cut(batches):
        for batch in batches:
            seen: set[int] = set()
            for _, _, data, off in row_slices(batch.column("text")):
                parts, cids, sizes = [], [], []
                for x in shingles(data, off, width):
                    cid = set_id(x)
                    if len(x) and cid not in seen:
                        seen.add(cid)
                        parts.append(_ordered(x, *frequent.value)[: len(x) - int(_needed(len(x), percent)) + 1])
                        cids.append(cid)
                        sizes.append(len(x))
                if parts:
                    k = np.array([len(p) for p in parts])
                    pos = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                    columns = [np.concatenate(parts).astype(np.int64), np.repeat(np.array(cids, np.int64), k), np.repeat(np.array(sizes, np.int32), k), pos.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shingle", "cid", "n", "pos"])

    return docs.select("text").mapInArrow(cut, "shingle long, cid long, n int, pos int")


def _fragments(docs: DataFrame, wanted: DataFrame, n_wanted: int, width: int) -> DataFrame:
    """cid, fragment, part: the sets of the wanted classes (cid, _js_row), from one document of each; empty parts too."""

    # Fragments of the order: the hash's highest bits, of frequent and other shingles alike.
    cuts = np.arange(1, FRAGMENTS, dtype=np.uint64) * np.uint64(2**63 // FRAGMENTS)

    def cut(batches):
        for batch in batches:
            want = batch.column("cid").to_numpy()
            for i, j, data, off in row_slices(batch.column("text")):
                sets = [(c, x) for c, x in zip(want[i:j], shingles(data, off, width), strict=True) if set_id(x) == c]
                edges = [np.concatenate([[0], np.searchsorted(x, cuts), [len(x)]]) for _, x in sets]
                size = np.diff(np.array(edges, np.int64).reshape(-1, FRAGMENTS + 1)).ravel()
                cid = np.repeat(np.array([c for c, _ in sets], np.int64), FRAGMENTS)
                fragment = np.tile(np.arange(FRAGMENTS, dtype=np.int32), len(sets))
                values = np.concatenate([np.zeros(0, np.uint64), *(x for _, x in sets)]).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(fragment), lists], ["cid", "fragment", "part"])

    few = F.broadcast(wanted) if n_wanted <= BROADCAST_IDS else wanted
    return docs.select("_js_row", "text").join(few, "_js_row").select("cid", "text").mapInArrow(cut, "cid long, fragment int, part array<long>")


def _fragments_of(docs: DataFrame, sized: DataFrame, cids: DataFrame, width: int) -> DataFrame:
    """_fragments() of the classes ``cids`` (cid), staged, one row for each class and fragment."""
    wanted = staged(sized.join(cids, "cid", "left_semi").groupBy("cid").agg(F.min("_js_row").alias("_js_row")), "wanted")
    parts = staged(_fragments(docs, wanted, wanted.count(), width), "fragments")
    discard(wanted)
    if not parts.groupBy("cid", "fragment").count().where("count > 1").isEmpty():  # rows with one id and text
        parts = staged(parts.dropDuplicates(["cid", "fragment"]), "fragments")
    return parts


def _alpha(percent: int, a: str = "n_a", b: str = "n_b") -> Column:
    """The least overlap of sets of n_a and n_b shingles that link."""
    return F.expr(f"({percent} * (cast({a} as long) + {b}) + {100 + percent} - 1) div {100 + percent}")


def _early(percent: int, a: str = "n_a", b: str = "n_b") -> Column:
    """So many shingles that a pair shares are asked to stand early in either set: EARLY, or as many as prefixes have room for."""
    return F.least(F.lit(EARLY), _alpha(percent, a, b) - F.expr(f"({percent} * cast(greatest({a}, {b}) as long) + 99) div 100") + 1)


def _with_overlaps(pairs: DataFrame, parts: DataFrame, overlap: Column) -> DataFrame:
    """Pairs (a, b, n_a, n_b) with k, the sum over the fragments of ``overlap`` of part_a and part_b."""
    one = pairs.join(parts.select(F.col("cid").alias("a"), "fragment", F.col("part").alias("part_a")), "a")
    both = one.join(parts.select(F.col("cid").alias("b"), "fragment", F.col("part").alias("part_b")), ["b", "fragment"])
    return both.select("a", "b", "n_a", "n_b", overlap.alias("k")).groupBy("a", "b", "n_a", "n_b").agg(F.sum("k").alias("k"))


def _linked(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """The pairs whose fragments' overlaps add up to enough."""
    # First with two bytes of each shingle: equal shingles stay equal, and where several of one set have become one, all may be shared.
    brief = parts.withColumn("part", F.transform("part", lambda x: (F.pmod(x, F.lit(1 << 16)) - (1 << 15)).cast("short")))
    at_most = F.size(F.array_intersect("part_a", "part_b")) + F.size("part_a") - F.size(F.array_distinct("part_a"))
    likely = staged(_with_overlaps(pairs, brief, at_most).where(F.col("k") >= _alpha(percent)).drop("k"), "likely-pairs")
    ends = likely.select(F.col("a").alias("cid")).unionByName(likely.select(F.col("b").alias("cid"))).distinct()
    overlaps = _with_overlaps(likely, parts.join(ends, "cid", "left_semi"), F.size(F.array_intersect("part_a", "part_b")))
    return overlaps.where(F.col("k") >= _alpha(percent)).select("a", "b")


def _sketch(x: np.ndarray) -> np.ndarray:
    """The low byte of the first shingle in each of SKETCH equal ranges of hashes (-1: none): equal in as many places as sets are similar."""
    at = np.searchsorted(x, _SKETCH_EDGES)
    out = np.full(SKETCH, -1, np.int16)
    held = at[:-1] < at[1:]
    out[held] = x[at[:-1][held]] & np.uint64(255)
    return out


def _with_pivots(prefixes: DataFrame, sized: DataFrame) -> DataFrame:
    """cid, n, pivot, n_pivot: of classes that gather around a pivot in groups of LEAST_GROUP or more, the pivots among them."""
    # In a group of near copies the text that the others were made from shares the most: its prefix has the shingles of the most classes.
    spread = prefixes.groupBy("shingle").agg(F.count(F.lit(1)).alias("in_classes")).where(F.col("in_classes") >= LEAST_GROUP)
    hot = staged(prefixes.join(spread, "shingle").select("shingle", "cid", "n", "in_classes"), "hot-prefixes")
    central = hot.groupBy("cid").agg(F.sum("in_classes").alias("central"))
    # One for each shingle and class of sizes; the one of the class of sizes below or above may do as well.
    band = F.floor(F.log(1.25, "n")).cast("int")
    centers = hot.join(central, "cid").groupBy("shingle", band.alias("band")).agg(F.max(F.struct("central", "cid", "n")).alias("p"))
    # A class goes to the center that most of its prefix names, of those with a similar set; centers follow their own in turn.
    asked = hot.withColumn("band", F.explode(F.array(band - 1, band, band + 1)))
    votes = staged(asked.join(centers, ["shingle", "band"]).groupBy("cid", "n", F.col("p.cid").alias("pivot"), F.col("p.n").alias("n_pivot"), "p.central").agg(F.count(F.lit(1)).alias("votes")), "votes")
    discard(hot)
    sketches = staged(sized.join(votes, "cid", "left_semi").groupBy("cid").agg(F.min("sketch").alias("sketch")), "sketches")
    theirs = sketches.select(F.col("cid").alias("pivot"), F.col("sketch").alias("other"))
    similarity = F.expr("size(filter(zip_with(sketch, other, (x, y) -> x = y and x >= 0), x -> x)) / size(filter(zip_with(sketch, other, (x, y) -> x >= 0 or y >= 0), x -> x))")

    def near(to: DataFrame) -> DataFrame:
        """The rows of ``to`` (cid, pivot) whose sketches say that the two sets are similar."""
        return to.join(sketches, "cid").join(theirs, "pivot").where(similarity >= NEAR_PIVOT).drop("sketch", "other")

    best = F.max(F.struct("votes", "central", "pivot", "n_pivot")).alias("v")
    first = staged(near(votes).groupBy("cid", "n").agg(best).select("cid", "n", "v.pivot", "v.n_pivot"), "near-centers")
    discard(votes)
    up = first.where("cid <> pivot").select(F.col("cid").alias("pivot"), F.col("pivot").alias("up"), F.col("n_pivot").alias("n_up"))
    second = near(first.join(up, "pivot").select("cid", "n", F.col("up").alias("pivot"), F.col("n_up").alias("n_pivot")))
    both = first.join(second.select("cid", F.col("pivot").alias("up"), F.col("n_pivot").alias("n_up")), "cid", "left")
    chosen = staged(both.select("cid", "n", F.coalesce("up", "pivot").alias("pivot"), F.coalesce("n_up", "n_pivot").alias("n_pivot")), "chosen")
    discard(first, sketches)
    large = chosen.groupBy("pivot", "n_pivot").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= LEAST_GROUP).select(F.col("pivot").alias("large"), F.col("n_pivot").alias("n_large"))
    own = large.select(F.col("large").alias("cid"), F.col("n_large").alias("n"), F.col("large").alias("pivot"), F.col("n_large").alias("n_pivot"))
    others = chosen.join(large, F.col("cid") == F.col("large"), "left_anti").join(large, F.col("pivot") == F.col("large"), "left_semi")
    return own.unionByName(others)


def _differences(members: DataFrame, parts: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Two tables: cid, pivot, n, n_pivot, weight, size of the differences;
    and cid, fragment, different: the differences (shingles that the member has besides: -1 - shingle)."""
    mine = members.where("cid <> pivot").join(parts, "cid")
    theirs = parts.select(F.col("cid").alias("pivot"), "fragment", F.col("part").alias("pivot_part"))
    both = mine.join(theirs, ["pivot", "fragment"]).withColumns({"lacks": F.array_except("pivot_part", "part"), "has": F.array_except("part", "pivot_part")})
    told = both.select("cid", "pivot", "n", "n_pivot", F.size("lacks").alias("r"), F.size("has").alias("a"), F.concat("lacks", F.transform("has", lambda x: -1 - x)).alias("different"))
    told = staged(told, "differences")
    r, a = F.sum("r"), F.sum("a")
    summed = told.groupBy("cid", "pivot", "n", "n_pivot").agg((100 * r + percent * a).alias("weight"), (r + a).alias("size"))
    return staged(summed, "weights"), told


def _alike_differences(weights: DataFrame, told: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b, n_a, n_b of one pivot, not both linked with it, that share early enough differences."""
    slack, whole = F.col("n_pivot") * (100 - percent), 100 + percent
    rows = told.select("cid", F.explode("different").alias("e")).join(weights, "cid")
    often = rows.groupBy("pivot", "e").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    by_rarity = Window.partitionBy("cid").orderBy("f", "e")
    shared = rows.join(often, ["pivot", "e"]).withColumns({"rank": F.row_number().over(by_rarity), "k": F.count(F.lit(1)).over(Window.partitionBy("cid"))})
    placed = shared.withColumn("pos", F.col("size") - F.col("k") + F.col("rank") - 1).withColumn("far", F.col("weight") > slack)
    # Even with the nearest partner that counts, s has to be so large.
    least = F.ceil(F.when(F.col("far"), F.col("weight") - slack).otherwise(F.col("weight") + 1) / whole)
    placed = staged(placed.where(F.col("pos") <= F.col("size") - least).select("pivot", "e", "cid", "n", "n_pivot", "weight", "size", "pos", "far"), "placed")
    right = placed.select("pivot", "e", *(F.col(c).alias(f"{c}2") for c in ("cid", "n", "weight", "size", "pos", "far")))
    s = F.ceil((F.col("weight") + F.col("weight2") - slack) / whole)
    early = (F.col("pos") <= F.col("size") - s) & (F.col("pos2") <= F.col("size2") - s)
    found = placed.where("far").join(right, ["pivot", "e"]).where("cid <> cid2 and (not far2 or cid < cid2)").where(early)
    return _pairs(found).drop("c")


def _pairs(found: DataFrame) -> DataFrame:
    """cid, n, cid2, n2 as pairs a, b, n_a, n_b with a < b, and how many rows each has (c)."""
    first = F.col("cid") < F.col("cid2")
    a, b = F.struct("cid", "n"), F.struct(F.col("cid2").alias("cid"), F.col("n2").alias("n"))
    both = found.select(F.when(first, a).otherwise(b).alias("a"), F.when(first, b).otherwise(a).alias("b"))
    return both.groupBy(F.col("a.cid").alias("a"), F.col("b.cid").alias("b"), F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b")).agg(F.count(F.lit(1)).alias("c"))


def _across(prefixes: DataFrame, groups: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs of different pivots and components that share an early enough prefix shingle. A shingle's largest group is only ever one side of a pair."""
    told = prefixes.join(groups, "cid", "left").withColumn("pivot", F.coalesce("pivot", "cid"))
    rows = staged(told.join(roots, F.col("cid") == F.col("node"), "left").select("shingle", "cid", "n", "pos", "pivot", F.coalesce("root", "cid").alias("root")), "rooted")
    sizes = rows.groupBy("shingle", "pivot").agg(F.count(F.lit(1)).alias("k")).groupBy("shingle").agg(F.max_by("pivot", F.struct("k", "pivot")).alias("hub"), F.count(F.lit(1)).alias("pivots")).where("pivots > 1").drop("pivots")
    mixed_rows = rows.join(sizes, "shingle")
    right = mixed_rows.select("shingle", *(F.col(c).alias(f"{c}2") for c in ("cid", "n", "pos", "pivot", "root")), (F.col("pivot") == F.col("hub")).alias("of_hub"))
    # Of the alpha shingles that a pair shares, the first k stand before place n - alpha + k in either set.
    alpha, k = _alpha(percent, "n", "n2"), _early(percent, "n", "n2")
    early = (F.col("pos") < F.col("n") - alpha + k) & (F.col("pos2") < F.col("n2") - alpha + k) & F.expr(f"100 * least(n, n2) >= {percent} * greatest(n, n2)")
    found = mixed_rows.where("pivot <> hub").drop("hub").join(right, "shingle").where("pivot <> pivot2 and root <> root2 and (of_hub or cid < cid2)").where(early)
    return _pairs(found).where(F.col("c") >= _early(percent)).drop("c")


def jaccard_groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` (with doc_id and text, any others) with n_shingles and component_id; columns of these names are replaced.

    Two documents link when their sets of distinct shingles of ``width`` words have a Jaccard similarity of ``percent``
    hundredths or more. Words lie between white space, A-Z lower-cased; fewer words than ``width`` are one shingle.
    component_id: the smallest doc_id that links reach. Documents without words, or without text, have
    no shingles and link with nothing. Repeated rows and equal texts link. A row without a doc_id links, but names no component; with
    no doc_id in reach component_id is null. An empty table gives no rows; a text of any length is one set.
    """
    found = labels_of(docs, width, percent)
    docs = docs.drop("n_shingles", "component_id")
    own_id, own_text = unused(docs, "_id"), unused(docs, "_text")
    on = F.col("doc_id").eqNullSafe(F.col(own_id)) & F.xxhash64("text").eqNullSafe(F.col(own_text))
    return docs.join(found.select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_text), "n_shingles", "component_id"), on).drop(own_id, own_text)


def labels_of(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), n_shingles and component_id as in jaccard_groups(): one row for each doc_id and
    text, without the texts."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("_js_row"))

    @F.arrow_udf("struct<cid:long,n:int,sketch:array<smallint>>")
    def measure(text: pa.Array) -> pa.Array:
        sets = [x for _, _, data, off in row_slices(text) for x in shingles(data, off, width)]
        return pa.StructArray.from_arrays([pa.array([set_id(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int32()), pa.array([_sketch(x) for x in sets], pa.list_(pa.int16()))], ["cid", "n", "sketch"])

    measured = docs.select("doc_id", "_js_row", F.xxhash64("text").alias("text_hash"), measure("text").alias("s"))
    sized = staged(measured.select("doc_id", "_js_row", "text_hash", "s.cid", "s.n", "s.sketch"), "shingle-sets")
    frequent = spark.sparkContext.broadcast(_frequent(docs, width))
    every = staged(_prefixes(docs, frequent, width, percent), "all-prefixes")
    shared = every.groupBy("shingle").agg(F.min("cid").alias("low"), F.max("cid").alias("high")).where("low <> high").select("shingle")
    prefixes = staged(every.join(shared, "shingle").distinct(), "prefixes")
    discard(every)
    frequent.unpersist()

    links = []

    def verified(pairs: DataFrame, parts: DataFrame | None = None) -> None:
        pairs = staged(pairs, "pairs")
        if pairs.isEmpty():
            return
        if parts is None:
            ends = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
            parts = _fragments_of(docs, sized, ends, width)
        links.append(staged(_linked(pairs, parts, percent), "links"))
        discard(pairs, parts)

    members = staged(_with_pivots(prefixes, sized), "members")
    groups = members.where("cid = pivot").select("cid", "pivot")
    if not groups.isEmpty():
        parts = _fragments_of(docs, sized, members.select("cid"), width)
        weights, told = _differences(members, parts, percent)
        links.append(weights.where(F.col("weight") <= F.col("n_pivot") * (100 - percent)).select(F.col("cid").alias("a"), F.col("pivot").alias("b")))
        verified(_alike_differences(weights, told, percent), parts)
        discard(told)
        groups = groups.unionByName(weights.select("cid", "pivot"))
    none = spark.createDataFrame([], "node long, root long")
    verified(_across(prefixes, groups, components(_all(links)) if links else none, percent))
    roots = components(_all(links)) if links else none
    discard(prefixes, members)

    rooted = sized.where("n > 0").join(roots, F.col("cid") == F.col("node"), "left").select("doc_id", "cid", F.coalesce("root", "cid").alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("least"))
    classes = staged(rooted.select("cid", "root").distinct().join(least, "root").select("cid", "least"), "classes")
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return sized.dropDuplicates(["doc_id", "text_hash"]).join(classes, "cid", "left").select("doc_id", "text_hash", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def _all(links: list[DataFrame]) -> DataFrame:
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def one_of_each(grouped: DataFrame) -> DataFrame:
    """Of the rows of jaccard_groups(), one of each component: that with the smallest doc_id. Rows without shingles all
    stay, and so do rows without a doc_id of which the component has none at all."""
    first = grouped.where(F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id")) & (F.col("n_shingles") > 0))
    if not first.where("component_id is not null").groupBy("component_id").count().where("count > 1").isEmpty():
        # Rows that repeat a doc_id: one of them stays.
        first = first.where("component_id is not null").dropDuplicates(["component_id"]).unionByName(first.where("component_id is null"))
    return first.unionByName(grouped.where("n_shingles = 0 and component_id is not null"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, linked on shingles of four words at a similarity of 0.85."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_groups(docs, 4, 85).select("doc_id", "n_shingles", "component_id")


#: Overlaps of all pairs that share a shingle, components by repeated relaxation.
OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS k FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.k = b.k AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS x, doc_id AS c FROM s UNION SELECT p.x, r.c FROM r JOIN p ON p.y = r.x WHERE r.c < p.x)
SELECT s.doc_id, CAST(any_value(len(s.g)) AS BIGINT) AS n_shingles, min(r.c) AS component_id FROM s JOIN r ON r.x = s.doc_id GROUP BY s.doc_id
"""
