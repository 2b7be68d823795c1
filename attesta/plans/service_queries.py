"""The smaller queries that the service's pages ask: batches, counters, summaries, templates, bundles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import identifiers, providers
from ..functions.text import rounded
from ..operators import drafts, exporting, shortlist
from .citation_queries import _ACC, _claims, _log
from .draft_queries import _BLOCKS, _raw
from .retrieval_queries import read


def pending_batch(spark, sf_dir):
    """The next papers to enrich: the oldest that wait."""
    return read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").orderBy("o_orderdate", "o_orderkey").limit(25).select("o_orderkey")


def missing_template(spark, sf_dir):
    """Rows to fill in for one year, and for none, as lines of the template."""
    orders = read(spark, sf_dir, "orders").select("*", F.when(F.col("o_custkey") % 10 != 0, F.year("o_orderdate")).alias("year"))
    chosen = orders.where("o_totalprice < 60000 and (year = 1995 or year is null)")
    authors = F.transform(F.filter(F.array(F.concat(F.lit("A"), "o_custkey"), F.when(F.col("o_custkey") % 3 == 0, "B. Second"), F.lit("")), lambda n: n.isNotNull()), lambda n: F.struct(n.alias("name")))
    papers = chosen.select(
        F.col("o_orderkey").alias("original_row_number"), "year", F.col("o_orderpriority").alias("field_of_study"), authors.alias("authors"), F.concat(F.lit("T"), "o_orderkey").alias("title"), F.lit(None).cast("string").alias("source_title"), F.concat(F.lit("https://l.org/"), "o_orderkey").alias("source_link")
    )
    rows = exporting.abstract_template(papers)
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in exporting.TEMPLATE]
    return rows.select(F.lit("|".join(rows.columns)).alias("header"), F.concat_ws("|", *cells).alias("line"))


def claim_counts(spark, sf_dir):
    """Per draft of 100 claims: claims, those that need a citation, those with one, accepted papers."""
    claims = _claims(spark, sf_dir).select((F.col("claim_id") % 100).alias("draft_id"), "claim_id", "needs_citation")
    counts = claims.groupBy("draft_id").agg(F.count(F.lit(1)).alias("claims"), F.count_if("needs_citation").alias("needs"))
    taken = claims.join(shortlist.decided(_log(spark, sf_dir)), "claim_id").groupBy("draft_id").agg(F.countDistinct("claim_id").alias("cited"), F.count(F.lit(1)).alias("accepted"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return counts.join(taken, "draft_id", "left").select("draft_id", "claims", "needs", zero("cited"), zero("accepted"))


def draft_summary(spark, sf_dir):
    """Each draft's last run and its coverage."""
    runs = read(spark, sf_dir, "events").groupBy((F.col("user_id") % 100).alias("draft_id")).agg(F.max(F.struct("ts", "event_id", "event_type")).alias("last"))
    claims = _claims(spark, sf_dir).where("needs_citation").select((F.col("claim_id") % 100).alias("draft_id"), "claim_id")
    cited = claims.join(shortlist.decided(_log(spark, sf_dir)).select("claim_id").distinct().withColumn("c", F.lit(1)), "claim_id", "left")
    coverage = cited.groupBy("draft_id").agg(F.count(F.lit(1)).alias("needs"), F.count("c").alias("covered"))
    joined = coverage.join(runs, "draft_id", "left")
    return joined.select("draft_id", "needs", "covered", rounded(100 * F.col("covered") / F.col("needs"), 1).alias("percent"), F.col("last.event_id").alias("run_id"), F.col("last.event_type").alias("status"))


def stage_counters(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("drafts"), F.count_if(F.col("value") > 50).alias("needs"), F.min("event_id").alias("first"))


def body_starts(spark, sf_dir):
    raw = _raw(spark, sf_dir).withColumn("text", F.when(F.col("is_heading") & (F.col("paragraph_index") == F.col("draft_id") % 4 * 3), F.concat(F.lit("II. Introduction to "), "text")).otherwise(F.col("text")))
    return drafts.body_start(drafts.assembled(raw)).select("draft_id", F.col("body_start").cast("long").alias("body_start"))


def export_bundle(spark, sf_dir):
    """Of each draft the papers by first acceptance, with how many claims cite them."""
    accepted = shortlist.decided(_log(spark, sf_dir)).withColumn("draft_id", F.col("claim_id") % 100)
    numbers = shortlist.bibliography_order(accepted)
    uses = accepted.groupBy("draft_id", "ref_id").agg(F.countDistinct("claim_id").alias("claims"))
    return numbers.join(uses, ["draft_id", "ref_id"])


def provider_names(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", F.expr("case when c_custkey % 2 = 0 then c_name end").alias("indexed"), F.expr("case when c_custkey % 3 = 0 then c_mktsegment end").alias("preferred"), F.expr("case when c_custkey % 5 <> 0 then concat('S', c_custkey) else ' ' end").alias("surname"), F.expr("case when c_custkey % 7 <> 0 then 'G' end").alias("given"))
    return c.select("c_custkey", providers.indexed_author(F.col("indexed"), F.col("preferred"), F.col("surname"), F.col("given")).alias("author"), providers.family_given(F.col("surname"), F.col("given"), F.col("indexed")).alias("name"))


def openalex_dois(spark, sf_dir):
    url = F.concat(F.when(F.col("p_partkey") % 2 == 0, F.lit("https://doi.org/")).otherwise(F.lit("http://doi.org/")), F.lit("10.1/AbC"), "p_partkey")
    return read(spark, sf_dir, "part").select("p_partkey", identifiers.openalex_doi(url).alias("doi"))


def paragraph_rewrite(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("p"), F.when(F.col("doc_id") % 3 == 0, F.lit("not there")).otherwise(F.element_at(F.split("text", r"\."), 1)).alias("s"))
    return docs.select("doc_id", F.sha2(providers.rewritten(F.col("p"), F.col("s"), F.lit("(Smith, 2023)")), 256).alias("paragraph_hash"))


def emphasis_split(spark, sf_dir):
    parts = providers.emphasized(F.col("p_name"), F.substring("p_type", 1, 1))
    return read(spark, sf_dir, "part").select("p_partkey", parts.alias("e")).select("p_partkey", "e.before", "e.match", "e.after")


def union_of_sheets(spark, sf_dir):
    """Tables of unlike columns, one under the other."""
    a = read(spark, sf_dir, "supplier").select(F.col("s_name").alias("title"), F.col("s_suppkey").alias("row_no"))
    b = read(spark, sf_dir, "customer").select(F.col("c_name").alias("title"), F.col("c_mktsegment").alias("field_of_study"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("field_of_study").agg(F.count("title").alias("titles"), F.count("row_no").alias("numbered"))


def top_runs(spark, sf_dir):
    """The three last runs of each draft."""
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return read(spark, sf_dir, "events").withColumn("nth", F.row_number().over(order)).where("nth <= 3").select("user_id", "event_id", "nth")


_ALL = (pending_batch, missing_template, claim_counts, draft_summary, stage_counters, body_starts, export_bundle, provider_names, openalex_dois, paragraph_rewrite, emphasis_split, union_of_sheets, top_runs)
QUERIES = {f.__name__: f for f in _ALL}

_CLAIMS = "c AS (SELECT o_orderkey % 100 AS draft_id, o_orderkey AS claim_id, o_orderstatus <> 'F' AS needs FROM orders)"
_INTRO = "CASE WHEN is_heading AND paragraph_index = draft_id % 4 * 3 THEN 'II. Introduction to ' || t ELSE t END"

SQL = {
    "pending_batch": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 25",
    "missing_template": """SELECT 'NO.|YEAR|FIELD OF STUDY|AUTHORS|DOCUMENT TITLE|SOURCE TITLE|LINK|ABSTRACT' AS header,
  o_orderkey || '|' || coalesce(CAST(year AS VARCHAR), '') || '|' || o_orderpriority || '|A' || o_custkey || CASE WHEN o_custkey % 3 = 0 THEN '; B. Second' ELSE '' END || '|T' || o_orderkey || '||https://l.org/' || o_orderkey || '|' AS line
FROM (SELECT *, CASE WHEN o_custkey % 10 <> 0 THEN CAST(year(o_orderdate) AS INTEGER) END AS year FROM orders) WHERE o_totalprice < 60000 AND (year = 1995 OR year IS NULL)""",
    "claim_counts": f"""WITH {_ACC}, {_CLAIMS}, t AS (SELECT draft_id, count(DISTINCT claim_id) AS cited, count(*) AS accepted FROM c JOIN acc USING (claim_id) GROUP BY 1)
SELECT c.draft_id, count(*) AS claims, count(*) FILTER (WHERE needs) AS needs, coalesce(any_value(cited), 0) AS cited, coalesce(any_value(accepted), 0) AS accepted FROM c LEFT JOIN t ON t.draft_id = c.draft_id GROUP BY 1""",
    "draft_summary": f"""WITH {_ACC}, {_CLAIMS}, v AS (SELECT draft_id, count(*) AS needs, count(*) FILTER (WHERE claim_id IN (SELECT claim_id FROM acc)) AS covered FROM c WHERE needs GROUP BY 1),
r AS (SELECT user_id % 100 AS draft_id, arg_max(event_id, (ts, event_id)) AS run_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY 1)
SELECT v.draft_id, needs, covered, floor(100.0 * covered / needs * 10.0 + 0.5) / 10.0 AS percent, run_id, status FROM v LEFT JOIN r ON r.draft_id = v.draft_id""",
    "stage_counters": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS drafts, count(*) FILTER (WHERE value > 50) AS needs, min(event_id) AS first FROM events GROUP BY 1",
    "body_starts": f"""WITH {_BLOCKS.replace("generate_subscripts(ls, 1) - 1 AS paragraph_index FROM", "generate_subscripts(ls, 1) - 1 AS paragraph_index, (generate_subscripts(ls, 1) - 1) % 3 = 0 AS is_heading FROM").replace("SELECT draft_id, CAST(paragraph_index", "SELECT draft_id, CAST(paragraph_index").replace("FROM raw)", f"FROM (SELECT * REPLACE ({_INTRO} AS t) FROM raw))")},
o AS (SELECT *, coalesce(sum(length(text) + 2) OVER (PARTITION BY draft_id ORDER BY paragraph_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM blocks)
SELECT draft_id, CAST(coalesce(min(a) FILTER (WHERE is_heading AND regexp_matches(text, '(?i)^\\s*(?:\\d+[.)]?\\s*|[ivxlcdm]+[.)]\\s*)?introduction\\b')), 0) AS BIGINT) AS body_start FROM o GROUP BY 1""",
    "export_bundle": f"""WITH {_ACC}, f AS (SELECT claim_id % 100 AS draft_id, ref_id, min(("at", claim_id)) AS first, count(DISTINCT claim_id) AS claims FROM acc GROUP BY 1, 2) SELECT draft_id, ref_id, row_number() OVER (PARTITION BY draft_id ORDER BY first, ref_id) AS number, claims FROM f""",
    "provider_names": """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS i, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS p, CASE WHEN c_custkey % 5 <> 0 THEN 'S' || c_custkey ELSE ' ' END AS s, CASE WHEN c_custkey % 7 <> 0 THEN 'G' END AS g FROM customer)
SELECT c_custkey, coalesce(i, p, CASE WHEN trim(s) <> '' AND g IS NOT NULL THEN s || ', ' || g END, nullif(trim(s), ''), g) AS author, CASE WHEN g IS NOT NULL THEN s || ', ' || g ELSE s END AS name FROM c""",
    "openalex_dois": "SELECT p_partkey, lower('10.1/AbC' || p_partkey) AS doi FROM part",
    "paragraph_rewrite": """WITH d AS (SELECT doc_id, text AS p, CASE WHEN doc_id % 3 = 0 THEN 'not there' ELSE split_part(text, '.', 1) END AS s FROM documents), a AS (SELECT *, strpos(p, s) AS a FROM d)
SELECT doc_id, sha256(CASE WHEN a > 0 AND s <> '' THEN p[1:a + length(s) - 1] || ' (Smith, 2023)' || p[a + length(s):] ELSE trim(p || ' (Smith, 2023)') END) AS paragraph_hash FROM a""",
    "emphasis_split": """WITH a AS (SELECT p_partkey, p_name AS t, p_type[1:1] AS p, strpos(p_name, p_type[1:1]) AS a FROM part)
SELECT p_partkey, CASE WHEN a > 0 THEN t[1:a - 1] ELSE t END AS before, CASE WHEN a > 0 THEN p ELSE '' END AS match, CASE WHEN a > 0 THEN t[a + length(p):] ELSE '' END AS after FROM a""",
    "union_of_sheets": "SELECT NULL AS field_of_study, count(*) AS titles, count(*) AS numbered FROM supplier UNION ALL SELECT c_mktsegment, count(*), 0 FROM customer GROUP BY 1",
    "top_runs": "SELECT * FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth <= 3",
}
