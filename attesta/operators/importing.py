"""The library: import with duplicates, backfill, enrichment from providers, clean-up of copies."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalized_title
from .staging import removed, written_once

MIN_ABSTRACT = 200
#: Rows that an import warns of one by one.
WARNINGS = 10
#: Provider fields, each filled where it is blank; the citation count only where it is null.
ENRICHED = ("abstract", "source_title", "year", "citation_count", "doi")


def trusted_abstract(abstract: Column) -> Column:
    return F.when(F.char_length(abstract) >= MIN_ABSTRACT, abstract)


def mark_duplicates(rows: DataFrame) -> DataFrame:
    """``rows`` (row_no, doi, eid, has_id, title) with duplicate: whether an earlier, accepted row has the DOI or the EID,
    or, for rows without any identifier, the title. Rows that are duplicates themselves don't count as earlier ones.

    Of rows with the same pair of identifiers only the first can be accepted, so the pairs alone are looked at. With one
    identifier each, a pair's first row is accepted. Where pairs share one of two identifiers they are settled in rounds
    (_settled). Titles come last: the first accepted row of each decides.
    """
    title = F.when(F.length(normalized_title(F.col("title"))) > 0, normalized_title(F.col("title")))
    keyed = rows.select("row_no", F.lower("doi").alias("_doi"), F.lower("eid").alias("_eid"), title.alias("_title"), "has_id")
    pairs = keyed.where("_doi is not null or _eid is not null").groupBy("_doi", "_eid").agg(F.min("row_no").alias("first"))
    if pairs.where("_doi is not null and _eid is not null").isEmpty():
        accepted = pairs.select("first")
    else:
        accepted = _settled(pairs).select("first")
    by_id = keyed.join(accepted.select(F.col("first").alias("row_no"), F.lit(True).alias("_first")), "row_no", "left")
    known = F.col("_doi").isNotNull() | F.col("_eid").isNotNull()
    by_id = by_id.withColumn("_taken", F.when(known, F.coalesce("_first", F.lit(False))).otherwise(F.col("has_id")))
    # The earliest row that takes a title: an accepted one with an identifier, or the first without any.
    takers = by_id.where("_title is not null and (_taken or not has_id)").groupBy("_title").agg(F.min("row_no").alias("_taker"))
    marked = by_id.join(takers, "_title", "left")
    duplicate = F.when(F.col("has_id"), ~F.col("_taken")).otherwise(F.coalesce(F.col("_taker") < F.col("row_no"), F.lit(False)))
    return rows.join(marked.select("row_no", duplicate.alias("duplicate")), "row_no")


def _keys(pairs: DataFrame) -> DataFrame:
    return pairs.select("first", F.explode(F.array_compact(F.array(F.concat(F.lit("d"), "_doi"), F.concat(F.lit("e"), "_eid")))).alias("key"))


def _earlier(pairs: DataFrame) -> DataFrame:
    """first, earlier (0, 1, or more than 1: how many earlier pairs share an identifier with it), which (the latest of the two that count).

    Of each identifier only its first two pairs are looked for, by sums that each task makes before the shuffle; the rest have more than one before them.
    """
    keys = written_once(_keys(pairs), "keys")
    least = keys.groupBy("key").agg(F.min("first").alias("least"))
    placed = written_once(keys.join(least, "key"), "keys")
    second = placed.where("first > least").groupBy("key").agg(F.min("first").alias("second"))
    number = F.when(F.col("first") == F.col("least"), 0).when(F.col("first") == F.col("second"), 1).otherwise(2)
    told = placed.join(second, "key", "left").select("first", number.alias("n"), F.when(F.col("first") > F.col("least"), F.col("least")).alias("which"))
    return told.groupBy("first").agg(F.sum("n").alias("earlier"), F.max("which").alias("which"))


def _alternating(earlier: DataFrame) -> DataFrame:
    """first, accepted, of the pairs that hang, one by one, on a pair with nothing before it: every second one is accepted.

    A pair with a single earlier neighbour is accepted if and only if that is not. Composed along a chain these choices
    alternate, so the distance to the chain's start decides, which pointer doubling finds: rounds grow with the
    logarithm of the longest chain.
    """
    # up: the pair that the chain was followed to, steps before this one; null where that is its start.
    up = F.when(F.col("earlier") == 1, F.col("which"))
    chains = written_once(earlier.where("earlier < 2").select("first", up.alias("up"), F.col("earlier").alias("steps")), "chains")
    while not (open_ := chains.where("up is not null")).isEmpty():
        ahead = chains.select(F.col("first").alias("up"), F.col("steps").alias("more"), F.col("up").alias("next"))
        # What hangs on a pair with several before it finds nothing there and is left for a later round.
        moved = open_.join(ahead, "up").select("first", F.col("next").alias("up"), F.col("steps") + F.col("more"))
        before, chains = chains, written_once(chains.where("up is null").union(moved), "chains")
        removed(before)
    return chains.select("first", (F.col("steps") % 2 == 0).alias("accepted"))


def _settled(pairs: DataFrame) -> DataFrame:
    """The accepted ones of the distinct pairs (_doi, _eid, first), in order of their first rows.

    A pair is accepted if no accepted earlier one shares an identifier with it. Each round settles all pairs that depend on a
    pair with nothing before it, directly or along a chain (_alternating), and takes away what shares an identifier with an accepted one:
    then pairs that waited for several are first themselves or part of a chain. So rounds grow with how deep such
    pairs are nested, not with the length of chains, and no task has a group of pairs that hang together.
    """
    accepted = []
    pairs = written_once(pairs.select("first", "_doi", "_eid"), "pairs")
    while not pairs.isEmpty():
        judged = _alternating(written_once(_earlier(pairs), "earlier"))
        taken = pairs.join(judged.where("accepted"), "first", "left_semi")
        accepted.append(taken.select("first"))
        rest = pairs.join(judged, "first", "left_anti")
        shared = _keys(rest).join(_keys(taken).select("key"), "key", "left_semi").select("first").distinct()
        pairs = written_once(rest.join(shared, "first", "left_anti"), "pairs")
    return reduce(DataFrame.union, accepted) if accepted else pairs.select("first")


def known_rows(library: DataFrame, incoming: DataFrame) -> DataFrame:
    """row_no, ref_id: which paper of the library an incoming row is, by its DOI, else its EID, else, without any identifier, its title.

    Of eid, title and has_id, what either table lacks is not asked. Each key joins by itself, so rows without it meet nobody.
    """
    both = set(library.columns) & set(incoming.columns)
    keys = [("doi", F.col("doi"), F.lit(True)), ("eid", F.col("eid"), F.lit(True))]
    if "title" in both and "has_id" in incoming.columns:
        keys.append(("title", F.nullif(normalized_title(F.col("title")), F.lit("")), ~F.col("has_id")))
    found = []
    for order, (name, key, asked) in enumerate(keys):
        if name in both:
            held = library.select(key.alias("_key"), "ref_id").where("_key is not null").groupBy("_key").agg(F.min("ref_id").alias("ref_id"))
            found.append(incoming.where(asked).select("row_no", key.alias("_key")).where("_key is not null").join(held, "_key").select("row_no", F.struct(F.lit(order), "ref_id").alias("_r")))
    return reduce(DataFrame.union, found).groupBy("row_no").agg(F.min("_r").getField("ref_id").alias("ref_id"))


def backfilled(library: DataFrame, incoming: DataFrame) -> DataFrame:
    """``library`` (ref_id, doi, abstract, status) with abstracts of 200 characters or more that an incoming row of the same paper
    (known_rows) brings; such rows are ENRICHED by DATASET and need embedding again."""
    offered = incoming.select("row_no", trusted_abstract(F.col("abstract")).alias("_new")).where("_new is not null")
    first = offered.join(known_rows(library, incoming), "row_no").groupBy("ref_id").agg(F.min_by("_new", "row_no").alias("_new"))
    fills = F.col("abstract").isNull() & F.col("_new").isNotNull()
    return library.join(first, "ref_id", "left").withColumns(
        {
            "abstract": F.coalesce("abstract", "_new"),
            "status": F.when(fills, "ENRICHED").otherwise(F.col("status")),
            "provider": F.when(fills, "DATASET"),
            "stale": fills,
        }
    ).drop("_new")


def import_summary(rows: DataFrame) -> DataFrame:
    """imported, duplicates, invalid, of rows with valid and duplicate."""
    valid, duplicate = F.col("valid"), F.col("duplicate")
    count = lambda c: F.count_if(c)
    return rows.agg(count(valid & ~duplicate).alias("imported"), count(valid & duplicate).alias("duplicates"), count(~valid).alias("invalid"))


def with_backfills(rows: DataFrame, library: DataFrame) -> DataFrame:
    """``rows`` (row_no, valid, duplicate, abstract, doi and what known_rows() takes) with backfills: whether the row gives its abstract to a
    paper of the ``library`` that has none. Of several rows for one paper the first with an abstract of 200 characters does."""
    blank = library.where(F.col("abstract").isNull() | (F.col("abstract") == "")).select("ref_id")
    known = known_rows(library, rows).join(blank, "ref_id", "left_semi")
    gives = rows.where(F.col("valid") & F.col("duplicate") & trusted_abstract(F.col("abstract")).isNotNull()).select("row_no")
    first = known.join(gives, "row_no", "left_semi").groupBy("ref_id").agg(F.min("row_no").alias("row_no")).select("row_no", F.lit(True).alias("backfills"))
    return rows.join(first, "row_no", "left").withColumn("backfills", F.coalesce("backfills", F.lit(False)))


def import_report(rows: DataFrame, shown: int = WARNINGS) -> DataFrame:
    """imported, duplicates, invalid, backfilled and warnings (texts) of an import, one row, from one pass over ``rows`` (row_no, valid, duplicate,
    backfills, has_id).

    A duplicate that backfills counts as backfilled only. Imported rows without an identifier are warned of: the ``shown`` first, and
    then how many more. Each batch of a task gives its counts and its first few rows, so what comes together is small.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            taken, again = b.valid & ~b.duplicate, b.valid & b.duplicate
            bare = b.row_no[taken & ~b.has_id]
            counts = {"imported": taken.sum(), "duplicates": (again & ~b.backfills).sum(), "invalid": (~b.valid).sum(), "backfilled": (again & b.backfills).sum(), "bare": len(bare)}
            yield pd.DataFrame([counts | {"first": sorted(bare.tolist())[:shown]}])

    parts = rows.select("row_no", "valid", "duplicate", "backfills", "has_id").mapInPandas(count, "imported long, duplicates long, invalid long, backfilled long, bare long, first array<long>")
    total = parts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("imported", "duplicates", "invalid", "backfilled", "bare")), F.slice(F.array_sort(F.flatten(F.collect_list("first"))), 1, shown).alias("first"))
    each = F.transform("first", lambda n: F.concat(F.lit("Row "), n.cast("string"), F.lit(": no DOI/EID found in LINK; enrichment will likely be incomplete")))
    more = F.concat(F.lit("...and "), (F.col("bare") - shown).cast("string"), F.lit(" more rows without identifiers"))
    warnings = F.when(F.col("bare") > shown, F.concat(each, F.array(more))).otherwise(each)
    return total.select("imported", "duplicates", "invalid", "backfilled", warnings.alias("warnings"))


def enriched(papers: DataFrame, providers: list[tuple[str, DataFrame]], without_abstracts: tuple[str, ...] = ()) -> DataFrame:
    """``papers`` (ref_id and ENRICHED) after the chain of providers (ref_id and ENRICHED each, one row a paper).

    Providers fill blanks in order, up to and with the first that has an abstract; titles are never touched. A provider's row with a true
    failed (a column it need not have) is a call that failed. Providers of ``without_abstracts`` aren't asked for papers that
    have a year and a source title. status: ENRICHED with an abstract, INCOMPLETE when some provider knew the paper, FAILED when none did;
    provider: who gave the abstract; message: without an abstract, which providers were tried.
    """
    tried = F.array().cast("array<string>")
    out = papers.withColumns({"_open": F.coalesce(F.col("abstract"), F.lit("")) == "", "_known": F.lit(False), "_tried": tried, "provider": F.lit(None).cast("string")})
    for name, offer in providers:
        failed = F.coalesce("failed", F.lit(False)) if "failed" in offer.columns else F.lit(False)
        o = offer.select("ref_id", F.struct(*ENRICHED).alias("_o"), failed.alias("_bad"))
        fill = lambda c: F.coalesce(F.col(c), F.col(f"_o.{c}")) if c == "citation_count" else F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.col(f"_o.{c}").cast("string")).cast(dict(papers.dtypes)[c])
        known = F.col("year").isNotNull() & (F.coalesce("source_title", F.lit("")) != "")
        called = F.col("_open") & ~known if name in without_abstracts else F.col("_open")
        out = out.join(o, "ref_id", "left").withColumn("_bad", F.coalesce("_bad", F.lit(False)))
        asked = called & F.col("_o").isNotNull() & ~F.col("_bad")
        gives = asked & (F.coalesce(F.col("_o.abstract"), F.lit("")) != "")
        told = F.concat("_tried", F.array(F.when(F.col("_bad"), f"{name}:error").otherwise(name)))
        out = out.withColumns(
            {c: F.when(asked, fill(c)).otherwise(F.col(c)) for c in ENRICHED}
            | {"provider": F.when(gives, name).otherwise(F.col("provider")), "_known": F.col("_known") | asked, "_open": F.col("_open") & ~gives, "_tried": F.when(called, told).otherwise(F.col("_tried"))}
        ).drop("_o", "_bad")
    status = F.when(~F.col("_open"), "ENRICHED").when(F.col("_known"), "INCOMPLETE").otherwise("FAILED")
    listed = F.when(F.size("_tried") > 0, F.array_join("_tried", ", ")).otherwise("none")
    message = F.when(F.col("_open"), F.concat(F.lit("No abstract retrieved (tried: "), listed, F.lit(")")))
    return out.withColumns({"status": status, "message": message}).drop("_open", "_known", "_tried")


def library_winners(library: DataFrame, key: Column) -> DataFrame:
    """ref_id, winner_id: which copy of a key stays. With an embedding first, then with an abstract, the oldest, the least id."""
    keyed = library.withColumn("_key", key).where("_key is not null")
    best = keyed.groupBy("_key").agg(F.min(F.struct(~F.col("embedded"), ~F.col("has_abstract"), "created_at", "ref_id")).getField("ref_id").alias("winner_id"))
    return keyed.select("ref_id", "_key").join(best, "_key").select("ref_id", "winner_id")


def library_losers(library: DataFrame, keys: list[Column]) -> DataFrame:
    """ref_id, winner_id of the copies that go: those by the first key, then by each further key those that have not gone yet.

    A winner that has gone itself, by whichever key, is followed until one that stays, by pointer doubling. A
    winner always precedes its copies in library_winners' order, so no way leads back.
    """
    lost = None
    for key in keys:
        new = library_winners(library, key).where("ref_id <> winner_id")
        lost = new if lost is None else lost.unionByName(new.join(lost.select("ref_id"), "ref_id", "left_anti"))
    lost = written_once(lost, "losers")
    while True:
        further = lost.select(F.col("ref_id").alias("winner_id"), F.col("winner_id").alias("_to"))
        if lost.join(further, "winner_id", "left_semi").isEmpty():
            return lost
        before, lost = lost, written_once(lost.join(further, "winner_id", "left").select("ref_id", F.coalesce("_to", "winner_id").alias("winner_id")), "losers")
        removed(before)


def repointed(children: DataFrame, losers: DataFrame) -> DataFrame:
    """``children`` (claim_id, ref_id and more) with the winners in place of the losers; where a claim then has a paper twice,
    the row that had it before stays, else that of the least old ref_id."""
    moved = children.join(losers, "ref_id", "left").withColumn("_to", F.coalesce("winner_id", "ref_id"))
    rest = [c for c in children.columns if c not in ("claim_id", "ref_id")]
    kept = moved.groupBy("claim_id", "_to").agg(F.min_by(F.struct(F.lit(0), *rest), F.struct(F.col("winner_id").isNotNull(), "ref_id")).alias("_k"))
    values = {c: F.col("_k")[c] for c in rest} | {"claim_id": F.col("claim_id"), "ref_id": F.col("_to")}
    return kept.select(*(values[c].alias(c) for c in children.columns))


def replaced(table: DataFrame, prepared: DataFrame, new: DataFrame) -> DataFrame:
    """``table`` after a run over the ``prepared`` claims (claim_id): their old rows go, whether or not they have new ones; others stay."""
    return table.join(prepared.select("claim_id"), "claim_id", "left_anti").select(*table.columns).unionByName(new)


def upsert_ignore(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` and the rows of ``new`` whose keys it lacks, one of each."""
    return table.unionByName(new.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti"))


def inverted_abstract(words: DataFrame) -> DataFrame:
    """ref_id, abstract from ref_id and positions (a map from a word to where it stands)."""
    placed = words.select("ref_id", F.explode("positions").alias("word", "at")).select("ref_id", "word", F.explode("at").alias("at"))
    return placed.groupBy("ref_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("abstract"))


