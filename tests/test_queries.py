"""Every query of the library against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from attesta.plans import bundle_queries, citation_queries, draft_queries, library_queries, retrieval_queries, service_queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = {k: f for m in (retrieval_queries, library_queries, draft_queries, citation_queries, service_queries, bundle_queries) for k, f in m.QUERIES.items()}
SQL = {k: s for m in (retrieval_queries, library_queries, draft_queries, citation_queries, service_queries, bundle_queries) for k, s in m.SQL.items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as from read_parquet('{DATA}/{t}.parquet')")
    return con


def normal(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in row) for row in df.astype(object).where(df.notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_what_sql_gives(spark, duck, name):
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert normal(ours) == normal(theirs)


def test_sentences_stand_where_their_offsets_say(spark):
    assert draft_queries.sentence_offsets(spark, DATA).where("misplaced > 0").count() == 0
    learned = draft_queries.learned_sentences(spark, DATA).agg({"misplaced": "sum", "sentences": "sum"}).first()
    assert learned["sum(misplaced)"] == 0 and learned["sum(sentences)"] > 1000
