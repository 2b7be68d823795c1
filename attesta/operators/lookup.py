"""Look-ups at providers whose answers are tables: several identifiers in order of precedence, and breakers that stop the rows after them.

A provider's client goes through papers in order and remembers what it met. That memory is a few positions in the order (where a view was
refused, where credentials were, where the third answer without an abstract came), so it is found by aggregation, and no
task reads the rows one after the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import written_once

# Answers without an abstract before a provider is no longer asked; identifiers in one request; seconds of blocking
# after which a batch run ends.
PROBES, GROUP, LONG_BLOCK = 3, 50, 120
#: How an answer's status counts: found, refused for its view, refused for good, or nothing.
FOUND, VIEW, REFUSED = "found", "view", "refused"


def outcome(status: Column, note: Column) -> Column:
    """FOUND for 200; VIEW and REFUSED for 401 and 403, by whether ``note`` has AUTHORIZATION_ERROR; null for whatever else."""
    denied = status.isin(401, 403)
    return F.when(status == 200, FOUND).when(denied & F.coalesce(F.contains(note, F.lit("AUTHORIZATION_ERROR")), F.lit(False)), VIEW).when(denied, REFUSED)


def numbered(df: DataFrame, *order: str, name: str = "position") -> DataFrame:
    """``df`` with ``name``, from 0, in this order, which must tell rows apart: ranges are sorted in tasks of their own and their sizes added up."""
    cut = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    cut = written_once(cut.withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    sizes = cut.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # A row for each task of the sort.
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def _attempts(papers: DataFrame, answers: DataFrame, keys: list[str], view: str) -> DataFrame:
    """position, tried (the answers to the paper's identifiers, in order: how they count, and what they hold), for one view."""
    rest = [c for c in answers.columns if c not in ("view", "kind", "id", "status", "note")]
    held = answers.where(F.col("view") == view).select("kind", "id", F.struct(outcome(F.col("status"), F.col("note")).alias("is"), *rest).alias("a"))
    held = held.groupBy("kind", "id").agg(F.max("a").alias("a"))
    asked = papers.select("position", F.posexplode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("id")) for k in keys))).alias("n", "k"))
    found = asked.where("k.id is not null").select("position", "n", "k.kind", "k.id").join(held, ["kind", "id"], "left")
    return found.groupBy("position").agg(F.array_sort(F.collect_list(F.struct("n", "a"))).alias("tried"))


def _first(tried: Column, least: Column) -> Column:
    """The first answer that isn't nothing, from the identifier numbered ``least`` on."""
    return F.get(F.filter(tried, lambda t: (t["n"] >= least) & t["a"]["is"].isNotNull()), F.lit(0))


def looked_up_in_order(papers: DataFrame, answers: DataFrame, keys: list[str], probes: int = PROBES) -> DataFrame:
    """``papers`` (position and the ``keys``) with answer (a struct of the answer's columns; null for none) and asked_view.

    ``answers``: view ("full" or "default"), kind (which of the keys), id, status, note and whatever is told, abstract among it. The keys
    are tried in order, up to the first that is found. The first row that is refused the full view switches to the default one,
    with the same identifier, and so do all rows after it; credentials that are refused end the look-up with their row. In
    the default view, ``probes`` answers without an abstract end it with the row after the last of them. Of two answers
    for one identifier the greater counts. Papers must have distinct positions; those without identifiers have no answer.
    """
    kept = written_once(papers, "papers")
    full = _attempts(kept, answers, keys, "full").select("position", F.col("tried").alias("_full"))
    plain = _attempts(kept, answers, keys, "default").select("position", F.col("tried").alias("_plain"))
    both = written_once(kept.join(full, "position", "left").join(plain, "position", "left").withColumn("_f", _first(F.col("_full"), F.lit(0))), "lookups")
    marks = both.groupBy(F.col("_f.a.is").alias("is")).agg(F.min("position").alias("at")).collect()
    at = {r["is"]: r["at"] for r in marks}
    switch, refused = at.get(VIEW), at.get(REFUSED)
    if refused is not None and switch is not None:
        switch = None if refused < switch else switch
    in_full = F.lit(True) if switch is None else F.col("position") < switch
    least = F.when(F.col("position") == F.lit(switch), F.col("_f.n")).otherwise(0) if switch is not None else F.lit(0)
    told = F.when(in_full, F.col("_f")).otherwise(_first(F.col("_plain"), least))
    both = both.withColumn("_a", told["a"]).withColumn("asked_view", F.when(in_full, "full").otherwise("default"))
    end = both.where(F.col("_a.is") == REFUSED).agg(F.min("position")).first()[0]
    alive = F.lit(True) if end is None else F.col("position") < end
    bare = both.where(alive & ~in_full & (F.col("_a.is") == FOUND) & (F.trim(F.coalesce(F.col("_a.abstract"), F.lit(""))) == ""))
    last = [r.position for r in bare.select("position").orderBy("position").limit(probes).collect()]
    if len(last) == probes:
        alive = alive & (F.col("position") <= last[-1])
    answered = F.when(alive & (F.col("_a.is") == FOUND), F.col("_a").dropFields("is"))
    return both.withColumn("answer", answered).withColumn("asked_view", F.when(alive, F.col("asked_view"))).select(*papers.columns, "answer", "asked_view")


def prefetched(papers: DataFrame, answers: DataFrame, key: str = "doi", group: int = GROUP, long_block: float = LONG_BLOCK) -> DataFrame:
    """``key``, grouped (its request's number), answer (null where the provider has none), of the identifiers that batch requests resolve.

    Distinct identifiers, sorted, make requests of ``group``. ``answers``: ``key``, retry_after, failed and whatever is told. A request that
    holds a row with failed, or with a retry_after up to ``long_block``, resolves nothing; one with a longer
    retry_after ends the run with its request. Identifiers that aren't resolved have no row: they are left to single look-ups.
    """
    rest = [c for c in answers.columns if c not in (key, "retry_after", "failed")]
    ids = numbered(papers.where(F.col(key).isNotNull()).select(key).distinct(), key).withColumn("grouped", F.floor(F.col("position") / group))
    held = answers.groupBy(key).agg(F.max("retry_after").alias("_wait"), F.max(F.coalesce("failed", F.lit(False))).alias("_failed"), F.max(F.struct(*rest)).alias("answer"))
    asked = written_once(ids.join(held, key, "left"), "prefetched")
    requests = asked.groupBy("grouped").agg(F.max("_wait").alias("_wait"), F.max(F.coalesce("_failed", F.lit(False))).alias("_failed"))
    end = requests.where(F.col("_wait") > long_block).agg(F.min("grouped")).first()[0]
    good = requests.where("_wait is null and not _failed")
    if end is not None:
        good = good.where(F.col("grouped") < end)
    return asked.join(good.select("grouped"), "grouped").select(key, "grouped", "answer")

