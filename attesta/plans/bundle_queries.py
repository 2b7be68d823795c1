"""Queries of whole results: goals with answers, merged libraries, audits and bundles of drafts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import claims
from ..operators import exporting, importing, sdg, shortlist
from ..operators.staging import ensure_shared_dir
from ..operators.tables import BucketedTable
from . import citation_queries as cited
from . import draft_queries
from .retrieval_queries import read

ANSWERED = "case p_partkey % 5 when 0 then 'statistical claim' when 1 then ' PREVIOUS_RESEARCH ' when 2 then 'opinion' when 3 then 'Causal_Claim' end"


def claim_types(spark, sf_dir):
    """Types as a classifier spells them."""
    return read(spark, sf_dir, "part").select("p_partkey", claims.normalized_claim_type(F.expr(ANSWERED), F.col("p_size") % 2 == 0).alias("claim_type"))


def _asked(spark, sf_dir):
    return sdg.with_candidates(draft_queries._texts(spark, sf_dir))


def sdg_candidates(spark, sf_dir):
    """All 17 goals of each text in the order in which a classifier sees them."""
    return _asked(spark, sf_dir).select("text_id", F.array_join(F.transform("candidates", lambda c: c["goal"].cast("string")), ",").alias("goals"), F.size(F.filter("candidates", lambda c: F.size(c["phrases"]) > 0)).cast("long").alias("n_hit"))


def sdg_classified(spark, sf_dir):
    """Answers with goals that aren't there, keywords that weren't found, refusals, and none at all."""
    kind = F.col("text_id") % 4
    answer = {
        "answer_goal": F.when(kind == 1, 99).when(kind == 2, 11).when(kind == 3, 7),
        "answer_keyword": F.when(kind == 1, "nonsense").when(kind == 2, "urban"),
        "answer_fits": F.when(kind == 3, F.lit(False)),
        "answer_follow_up": F.when(kind == 2, "public transport"),
    }
    return sdg.classified(_asked(spark, sf_dir).withColumns(answer)).select("text_id", "goal", "goal_name", "keyword", "closest_goal", "closest_name")


def _library(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ref_id"), (F.col("doc_id") % 2 == 0).alias("embedded"), (F.col("n_chars") >= 200).alias("has_abstract"), (F.col("doc_id") % 7).alias("created_at"),
        F.expr("case when doc_id % 3 <> 0 then concat('10.1/', doc_id % 150) end").alias("doi"), F.expr("case when doc_id % 3 <> 1 then concat('2-s2.0-', doc_id % 110) end").alias("eid"),
    )


def library_merge(spark, sf_dir):
    """Copies by DOI, then by EID, with the papers that they go for."""
    return importing.library_losers(_library(spark, sf_dir), [F.lower("doi"), F.col("eid")])


def repointed_rows(spark, sf_dir):
    """Recommendations whose papers were merged in tens: the first three of each are one."""
    rows = read(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 500).alias("claim_id"), F.col("l_partkey").alias("ref_id")).agg(F.max("l_orderkey").alias("note"))
    losers = read(spark, sf_dir, "part").where("p_partkey % 10 in (1, 2)").select(F.col("p_partkey").alias("ref_id"), (F.col("p_partkey") - F.col("p_partkey") % 10).alias("winner_id"))
    return importing.repointed(rows, losers)


def backfill_by_keys(spark, sf_dir):
    """Abstracts for papers known by DOI, EID or title."""
    docs = read(spark, sf_dir, "documents")
    title = F.concat(F.lit("Title "), F.col("doc_id") % 400, F.lit("!"))
    doi, eid = F.expr("case when doc_id % 3 = 0 then concat('10.1/', doc_id) end"), F.expr("case when doc_id % 3 = 1 then concat('2-s2.0-', doc_id) end")
    library = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("ref_id"), doi.alias("doi"), eid.alias("eid"), F.concat(F.lit("title "), "doc_id").alias("title"), F.when(F.col("doc_id") % 5 == 0, F.col("text")).alias("abstract"), F.lit("PENDING").alias("status"))
    incoming = docs.select(F.col("doc_id").alias("row_no"), doi.alias("doi"), eid.alias("eid"), title.alias("title"), (F.col("doc_id") % 3 < 2).alias("has_id"), F.col("text").alias("abstract"))
    return importing.backfilled(library, incoming).select("ref_id", F.sha2("abstract", 256).alias("abstract_hash"), "status", "provider", "stale")


def _audited(spark, sf_dir):
    rows = cited._claims(spark, sf_dir).withColumn("draft_id", F.col("claim_id") % 50)
    there = F.when(F.col("claim_id") % 7 == 0, 3).otherwise(5) == 5
    texts = cited.accepted_texts(spark, sf_dir)
    outcome = F.when(F.col("citation_text").isNull(), "NOT_ACCEPTED").when(there, "INSERTED").otherwise("POSITION_MISMATCH")
    return rows.where("needs_citation").join(texts, "claim_id", "left").withColumn("outcome", outcome)


def audit_counts(spark, sf_dir):
    return shortlist.audit_counts(_audited(spark, sf_dir))


def _accepted(spark, sf_dir):
    pick = lambda expr: F.when(F.col("ref_id") % 3 != 0, F.expr(expr))
    return shortlist.decided(cited._log(spark, sf_dir)).select(
        "claim_id", "ref_id", "at", F.concat(F.lit("On "), "ref_id").alias("title"), F.when(F.col("ref_id") % 4 != 0, 2000 + F.col("ref_id")).alias("year"), F.when(F.col("ref_id") % 5 != 0, F.concat(F.lit("https://l.org/"), "ref_id")).alias("link"),
        pick("cast(ref_id + 50 as double)").alias("score_percentage"), pick("'SUPPORTED'").alias("verdict"), pick("'Strong'").alias("recommendation_label"), pick("'ACCEPTED'").alias("user_decision"), pick("case when ref_id % 2 = 0 then 'note' end").alias("user_note"),
        F.expr("concat('(Smith', ref_id, ', 2020)')").alias("in_text"),
    )


def _report(spark, sf_dir):
    rows = _audited(spark, sf_dir).withColumns({"section_title": F.lit("Intro"), "paragraph_index": F.col("claim_id") % 9, "claim_text": F.when(F.col("claim_id") % 2 == 0, ""), "claim_type": F.lit("CAUSAL_CLAIM"), "existing_citation_status": F.lit("NONE")})
    return shortlist.audit_columns(rows, _accepted(spark, sf_dir).drop("in_text"))


def audit_columns(spark, sf_dir):
    """The 15 columns of the report for every claim that needs a citation."""
    return _report(spark, sf_dir)


def json_bundles(spark, sf_dir):
    """Every draft's accepted claims and bibliography; its audit only by two columns, to keep the SQL readable."""
    accepted = _accepted(spark, sf_dir).withColumns({"draft_id": F.col("claim_id") % 50, "sentence": F.concat(F.lit("Claim "), "claim_id")}).where("claim_id % 3 = 0")
    audit = _report(spark, sf_dir).select("draft_id", "claim_id", "paragraph_index", "insertion_status").where("claim_id % 2 = 0")
    numbers = shortlist.bibliography_order(accepted).withColumn("text", F.concat(F.lit("Smith "), "ref_id"))
    drafts = spark.range(60).select(F.col("id").alias("draft_id"), F.concat(F.lit("d"), "id", F.lit(".docx")).alias("filename"))
    return exporting.json_bundle(drafts, accepted, audit, numbers, at="2024-01-01").select("draft_id", F.sha2("json", 256).alias("json_hash"))


def best_references_by_draft(spark, sf_dir):
    return shortlist.best_references(cited._recommendations(spark, sf_dir).withColumn("draft_id", F.col("claim_id") % 20), 5)


def replaced_rows(spark, sf_dir):
    """A second run over every third claim, of which every second finds nothing."""
    old = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim_id"), "l_linenumber")
    again = read(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("claim_id"))
    new = again.where("claim_id % 2 = 0").select("claim_id", F.lit(9).cast(old.schema["l_linenumber"].dataType).alias("l_linenumber"))
    return importing.replaced(old, again, new).groupBy("claim_id").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("total"))


def replaced_table(spark, sf_dir):
    """The same two runs as commits to a table, which is read afterwards."""
    old = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_linenumber").cast("long").alias("n"))
    again = read(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("claim_id"))
    table = BucketedTable(spark, f"{ensure_shared_dir(spark)}/table-{uuid.uuid4().hex}", buckets=16)
    table.replace(old.select("claim_id"), old)
    table.replace(again, again.where("claim_id % 2 = 0").withColumn("n", F.lit(9).cast("long")))
    return table.read().groupBy("claim_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("total"))


_ALL = (claim_types, sdg_candidates, sdg_classified, library_merge, repointed_rows, backfill_by_keys, audit_counts, audit_columns, json_bundles, best_references_by_draft, replaced_rows, replaced_table)
QUERIES = {f.__name__: f for f in _ALL}

_PHRASES = " UNION ALL ".join(f"SELECT {g} AS goal, '{name}' AS goal_name, {i} AS no, '{p}' AS phrase" for g, name, phrases in sdg.GOALS for i, p in enumerate(phrases))
_CANDIDATES = f"""t AS (SELECT p_partkey AS text_id, {draft_queries.TEXTS} AS text FROM part), h AS ({draft_queries._GOALS}), all_phrases AS ({_PHRASES}),
gs AS (SELECT goal, goal_name, arg_min(phrase, no) AS opening FROM all_phrases GROUP BY 1, 2),
c AS (SELECT text_id, goal, goal_name, opening, n, ps, row_number() OVER (PARTITION BY text_id ORDER BY n DESC, goal) AS place FROM (
  SELECT t.text_id, gs.goal, gs.goal_name, gs.opening, count(h.phrase) AS n, coalesce(list(h.phrase ORDER BY length(h.phrase) DESC, h.phrase) FILTER (h.phrase IS NOT NULL), []) AS ps FROM t CROSS JOIN gs LEFT JOIN h ON h.text_id = t.text_id AND h.goal = gs.goal GROUP BY ALL))"""
_G = "('framework', 'model', 'system', 'innovation', 'technology', 'management')"
_DOCS = """l AS (SELECT doc_id AS ref_id, doc_id % 2 = 0 AS embedded, n_chars >= 200 AS has_abstract, doc_id % 7 AS created_at, CASE WHEN doc_id % 3 <> 0 THEN '10.1/' || doc_id % 150 END AS doi, CASE WHEN doc_id % 3 <> 1 THEN '2-s2.0-' || doc_id % 110 END AS eid FROM documents)"""


def _won(key: str) -> str:
    return f"SELECT ref_id, first_value(ref_id) OVER (PARTITION BY {key} ORDER BY embedded DESC, has_abstract DESC, created_at, ref_id) AS winner_id FROM l WHERE {key} IS NOT NULL"


_ACCEPTED = f"""{cited._ACC}, {cited._TEXTS},
au AS (SELECT o_orderkey AS claim_id, o_orderkey % 50 AS draft_id, concat('Claim ', o_orderkey, ' of ', o_orderpriority, '.') AS sentence, citation_text, CASE WHEN citation_text IS NULL THEN 'NOT_ACCEPTED' WHEN o_orderkey % 7 = 0 THEN 'POSITION_MISMATCH' ELSE 'INSERTED' END AS outcome
  FROM orders LEFT JOIN tx ON claim_id = o_orderkey WHERE o_orderstatus <> 'F')"""

SQL = {
    "claim_types": """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'STATISTICAL_CLAIM' WHEN 1 THEN 'PREVIOUS_RESEARCH' WHEN 3 THEN 'CAUSAL_CLAIM' ELSE CASE WHEN p_size % 2 = 0 THEN 'GENERAL_BACKGROUND' ELSE 'NO_CITATION_NEEDED' END END AS claim_type FROM part""",
    "sdg_candidates": f"WITH {_CANDIDATES} SELECT text_id, string_agg(CAST(goal AS VARCHAR), ',' ORDER BY place) AS goals, count(*) FILTER (n > 0) AS n_hit FROM c GROUP BY 1",
    "sdg_classified": f"""WITH {_CANDIDATES}, a AS (SELECT text_id, CASE text_id % 4 WHEN 2 THEN 11 WHEN 3 THEN 7 END AS g, text_id % 4 <> 3 AS fits, CASE WHEN text_id % 4 = 2 THEN 'urban' END AS k FROM t),
m AS (SELECT c.*, a.fits, CASE WHEN list_contains(ps, k) THEN k ELSE ps[1] END AS k FROM c JOIN a USING (text_id) WHERE CASE WHEN a.g IS NULL THEN place = 1 ELSE goal = a.g END),
f AS (SELECT *, fits AND NOT (coalesce(k IN {_G}, false) AND len(list_filter(ps, lambda p: p NOT IN {_G})) = 0) AS ok FROM m)
SELECT text_id, CASE WHEN ok THEN goal END AS goal, CASE WHEN ok THEN goal_name END AS goal_name, CASE WHEN ok THEN coalesce(k, CASE WHEN text_id % 4 = 2 THEN 'public transport' ELSE opening END) END AS keyword,
  CASE WHEN NOT ok THEN goal END AS closest_goal, CASE WHEN NOT ok THEN goal_name END AS closest_name FROM f""",
    "library_merge": f"""WITH RECURSIVE {_DOCS}, d AS (SELECT * FROM ({_won("doi")}) WHERE ref_id <> winner_id), e AS (SELECT * FROM ({_won("eid")}) WHERE ref_id <> winner_id AND ref_id NOT IN (SELECT ref_id FROM d)),
g AS (SELECT * FROM d UNION ALL SELECT * FROM e), w AS (SELECT ref_id, winner_id FROM g UNION ALL SELECT w.ref_id, g.winner_id FROM w JOIN g ON g.ref_id = w.winner_id)
SELECT ref_id, winner_id FROM w WHERE winner_id NOT IN (SELECT ref_id FROM g)""",
    "repointed_rows": """WITH r AS (SELECT l_orderkey % 500 AS claim_id, l_partkey AS old, CASE WHEN l_partkey % 10 IN (1, 2) THEN l_partkey - l_partkey % 10 ELSE l_partkey END AS ref_id, max(l_orderkey) AS note FROM lineitem GROUP BY 1, 2)
SELECT claim_id, ref_id, arg_min(note, (ref_id <> old, old)) AS note FROM r GROUP BY 1, 2""",
    "backfill_by_keys": """WITH b AS (SELECT doc_id AS ref_id, CASE WHEN doc_id % 5 = 0 THEN text END AS abstract FROM documents WHERE doc_id % 2 = 0),
i AS (SELECT CASE WHEN doc_id % 3 < 2 THEN doc_id ELSE doc_id % 400 END AS ref_id, arg_min(text, doc_id) AS a FROM documents WHERE length(text) >= 200 GROUP BY 1)
SELECT ref_id, sha256(coalesce(abstract, a)) AS abstract_hash, CASE WHEN abstract IS NULL AND a IS NOT NULL THEN 'ENRICHED' ELSE 'PENDING' END AS status, CASE WHEN abstract IS NULL AND a IS NOT NULL THEN 'DATASET' END AS provider, abstract IS NULL AND a IS NOT NULL AS stale FROM b LEFT JOIN i USING (ref_id)""",
    "audit_counts": f"WITH {_ACCEPTED} SELECT draft_id, count(*) FILTER (outcome = 'INSERTED') AS inserted, count(*) FILTER (outcome = 'POSITION_MISMATCH') AS mismatched, count(*) FILTER (outcome = 'NOT_ACCEPTED') AS not_accepted FROM au GROUP BY 1",
    "audit_columns": f"""WITH {_ACCEPTED}, p AS (SELECT claim_id, string_agg('On ' || ref_id, '; ' ORDER BY "at", ref_id) AS t, string_agg(CASE WHEN ref_id % 4 <> 0 THEN CAST(2000 + ref_id AS VARCHAR) ELSE 'n.d.' END, '; ' ORDER BY "at", ref_id) AS y, coalesce(string_agg('https://l.org/' || ref_id, '; ' ORDER BY "at", ref_id) FILTER (ref_id % 5 <> 0), '') AS k, arg_min(ref_id, ("at", ref_id)) FILTER (ref_id % 3 <> 0) AS r FROM acc GROUP BY 1)
SELECT draft_id, au.claim_id, 'Intro' AS section_title, au.claim_id % 9 AS paragraph_index, sentence AS claim_text, 'CAUSAL_CLAIM' AS claim_type, 'NONE' AS existing_citation_status, citation_text, t AS reference_titles, y AS reference_years, k AS reference_links,
  CAST(r + 50 AS DOUBLE) AS score_percentage, CASE WHEN r IS NOT NULL THEN 'SUPPORTED' END AS verdict, CASE WHEN r IS NOT NULL THEN 'Strong' END AS recommendation_label, CASE WHEN p.claim_id IS NULL THEN 'PENDING' ELSE 'ACCEPTED' END AS user_decision, CASE WHEN r % 2 = 0 THEN 'note' END AS user_note, outcome AS insertion_status FROM au LEFT JOIN p USING (claim_id)""",
    "json_bundles": f"""WITH {_ACCEPTED}, a3 AS (SELECT * FROM acc WHERE claim_id % 3 = 0),
ac AS (SELECT claim_id % 50 AS draft_id, claim_id, '{{"claim_id":"' || claim_id || '","sentence_text":"Claim ' || claim_id || '","citation_text":' || CASE WHEN count(*) = 1 THEN '"(Smith' || any_value(ref_id) || ', 2020)"' ELSE 'null' END || ',"reference_ids":[' || string_agg('"' || ref_id || '"', ',' ORDER BY "at", ref_id) || ']}}' AS j FROM a3 GROUP BY claim_id),
aj AS (SELECT draft_id, string_agg(j, ',' ORDER BY claim_id) AS j FROM ac GROUP BY 1),
uj AS (SELECT draft_id, string_agg('{{"paragraph_index":' || claim_id % 9 || ',"insertion_status":"' || outcome || '"}}', ',' ORDER BY claim_id) AS j FROM au WHERE claim_id % 2 = 0 GROUP BY 1),
b AS (SELECT claim_id % 50 AS draft_id, ref_id, min(("at", claim_id)) AS f FROM a3 GROUP BY 1, 2), bj AS (SELECT draft_id, string_agg('{{"reference_id":"' || ref_id || '","text":"Smith ' || ref_id || '"}}', ',' ORDER BY f, ref_id) AS j FROM b GROUP BY 1),
d AS (SELECT range AS draft_id FROM range(60))
SELECT draft_id, sha256('{{"draft":{{"id":"' || draft_id || '","filename":"d' || draft_id || '.docx"}},"generated_at":"2024-01-01","citation_style":"APA","insertion_mode":"n/a","accepted":[' || coalesce(aj.j, '') || '],"audit":[' || coalesce(uj.j, '') || '],"bibliography":[' || coalesce(bj.j, '') || ']}}') AS json_hash
FROM d LEFT JOIN aj USING (draft_id) LEFT JOIN uj USING (draft_id) LEFT JOIN bj USING (draft_id)""",
    "best_references_by_draft": f"""WITH {cited._REC}, b AS (SELECT claim_id % 20 AS draft_id, ref_id, max(score) AS score, arg_min(claim_id, (-score, claim_id)) AS claim_id FROM rec WHERE rank = 1 GROUP BY 1, 2)
SELECT * FROM (SELECT *, score >= 65 AS usable, score >= 75 AS recommended, row_number() OVER (PARTITION BY draft_id ORDER BY score DESC, claim_id, ref_id) AS place FROM b) WHERE place <= 5""",
    "replaced_rows": """SELECT claim_id, count(*) AS n, CAST(sum(x) AS BIGINT) AS total FROM (SELECT l_orderkey AS claim_id, l_linenumber AS x FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0) UNION ALL SELECT o_orderkey, 9 FROM orders WHERE o_orderkey % 6 = 0) GROUP BY 1""",
}
SQL["replaced_table"] = SQL["replaced_rows"]
