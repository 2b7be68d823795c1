from __future__ import annotations

import random

from pyspark.sql import functions as F

from attesta.operators import importing

SCHEMA = "row_no long, doi string, eid string, has_id boolean, title string"


def sequential(rows):
    dois, eids, titles, out = set(), set(), set(), {}
    for no, doi, eid, has_id, title in sorted(rows):
        doi, eid = doi and doi.lower(), eid and eid.lower()
        out[no] = bool(doi and doi in dois or eid and eid in eids or not has_id and title in titles)
        if not out[no]:
            dois |= {doi} - {None}
            eids |= {eid} - {None}
            titles |= {title} - {None}
    return out


def marked(spark, rows):
    return {r.row_no: r.duplicate for r in importing.mark_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_a_duplicate_does_not_take_its_second_identifier(spark):
    rows = [(1, "A", None, True, "t1"), (2, "A", "B", True, "t2"), (3, None, "B", True, "t3")]
    assert marked(spark, rows) == {1: False, 2: True, 3: False}


def test_random_imports_match_reading_in_order(spark):
    rng = random.Random(5)
    for both in (True, False):
        rows = []
        for no in range(300):
            doi = rng.choice([None, f"d{rng.randrange(40)}"])
            eid = rng.choice([None, f"E{rng.randrange(40)}"]) if both or doi is None else None
            rows.append((no, doi, eid, bool(doi or eid) or rng.random() < 0.1, rng.choice([None, f"title {rng.randrange(60)}"])))
        assert marked(spark, rows) == sequential(rows)


def test_nothing_to_import(spark):
    assert marked(spark, []) == {}


def test_only_trusted_abstracts_fill_gaps(spark):
    library = spark.createDataFrame([(1, "a", None, "PENDING"), (2, "b", "own", "ENRICHED"), (3, "c", None, "PENDING")], "ref_id long, doi string, abstract string, status string")
    incoming = spark.createDataFrame([(1, "a", "x" * 200), (2, "b", "y" * 200), (3, "c", "short")], "row_no long, doi string, abstract string")
    out = {r.ref_id: (r.status, r.stale) for r in importing.backfilled(library, incoming).collect()}
    assert out == {1: ("ENRICHED", True), 2: ("ENRICHED", False), 3: ("PENDING", False)}


def test_a_long_chain_takes_rounds_by_its_logarithm(spark, monkeypatch):
    rows = [(i, f"d{i // 2}", f"e{(i + 1) // 2}", True, None) for i in range(3000)]
    rows += [(10_000 + i, "hub", f"h{i}", True, None) for i in range(200)] + [(9000 + i, None, f"h{i}", True, None) for i in range(150)]
    written = []
    monkeypatch.setattr(importing, "written_once", lambda df, label, f=importing.written_once: written.append(label) or f(df, label))
    assert marked(spark, rows) == sequential(rows)
    assert written.count("chains") <= 16


def test_winners_that_went_themselves_are_followed(spark):
    # 1 and 2 share a DOI, 2 and 3 an EID, 3 and 4 a title.
    rows = [(1, False, 9, "d", None, None), (2, False, 8, "d", "e", None), (3, False, 7, None, "e", "t"), (4, False, 6, None, None, "t"), (5, True, 9, None, None, None)]
    library = spark.createDataFrame(rows, "ref_id long, has_abstract boolean, created_at int, doi string, eid string, title string").selectExpr("*", "false as embedded")
    losers = importing.library_losers(library, [F.col("doi"), F.col("eid"), F.col("title")])
    assert {r.ref_id: r.winner_id for r in losers.collect()} == {1: 4, 2: 4, 3: 4}
    assert importing.library_losers(library.where("ref_id = 5"), [F.col("doi"), F.col("eid")]).count() == 0


def test_report_counts_in_one_pass_and_warns_of_the_first_rows(spark):
    rows = [(i, i % 10 > 0, i % 3 == 0, i % 9 == 0, i % 2 == 0) for i in range(1, 101)]
    told = importing.import_report(spark.createDataFrame(rows, "row_no long, valid boolean, duplicate boolean, backfills boolean, has_id boolean").repartition(5)).collect()
    (r,) = told
    valid = [x for x in rows if x[1]]
    bare = [x[0] for x in valid if not x[2] and not x[4]]
    assert (r.imported, r.duplicates, r.invalid, r.backfilled) == (sum(not x[2] for x in valid), sum(x[2] and not x[3] for x in valid), 10, sum(x[2] and x[3] for x in valid))
    assert r.warnings == [f"Row {i}: no DOI/EID found in LINK; enrichment will likely be incomplete" for i in bare[:10]] + [f"...and {len(bare) - 10} more rows without identifiers"]
    (none,) = importing.import_report(spark.createDataFrame([], "row_no long, valid boolean, duplicate boolean, backfills boolean, has_id boolean")).collect()
    assert tuple(none) == (0, 0, 0, 0, [])
