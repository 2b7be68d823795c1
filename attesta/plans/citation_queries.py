"""Queries of citations, shortlists, decisions and exports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import citations as cite
from ..operators import exporting, shortlist
from ..operators.citing import formatted
from .retrieval_queries import read

NAMES = (
    "concat('Smith', s_suppkey % 7, ', J. A.')",
    "concat('J. A. Doe', substr('abcdefghij', s_suppkey % 10 + 1, 1))",
    "concat('Jane Q. Lee', substr('abcdefghij', s_nationkey % 10 + 1, 1))",
    "'Zegarra Silva D.'",
    "'Wu'",
    "' '",
)
_PEOPLE = "array({0}, {1}, {2}, {3}, {4}, {5})".format(*NAMES)
#: How many of the names, from which on: 0 to 24, with repeats.
_TAKEN = "case s_suppkey % 8 when 0 then 0 when 1 then 1 when 2 then 2 when 3 then 3 when 4 then 6 when 5 then 8 when 6 then 12 else 24 end"


def _references(spark, sf_dir):
    base = F.expr(_PEOPLE)
    names = F.slice(F.flatten(F.array_repeat(base, 5)), F.lit(1), F.expr(_TAKEN))
    return read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("ref_id"),
        F.lit(0).alias("list_id"),
        names.alias("authors"),
        F.expr("case when s_suppkey % 9 <> 0 then concat('On ', s_name, ' and the art of ', s_nationkey) end").alias("title"),
        F.expr("case when s_suppkey % 5 <> 0 then 2000 + s_nationkey % 3 end").cast("int").alias("year"),
        F.expr("case s_suppkey % 3 when 0 then 'IEEE Trans. Tests.' when 1 then 'Journal of Tests' end").alias("source_title"),
        F.expr("case when s_suppkey % 4 = 0 then concat('10.1/', s_suppkey) end").alias("doi"),
        F.expr("case when s_suppkey % 4 = 1 then concat('https://s.org/', s_suppkey) end").alias("scopus_url"),
        F.expr("case when s_suppkey % 4 = 2 then concat('https://l.org/', s_suppkey) end").alias("source_link"),
        F.col("s_suppkey").alias("position"),
    )


def _styled(style: str):
    def query(spark, sf_dir):
        return formatted(_references(spark, sf_dir), style).select("ref_id", "in_text", "entry", "list_rank")

    query.__name__ = f"cite_{style.lower()}"
    return query


cite_apa, cite_chicago, cite_ieee = (_styled(s) for s in cite.STYLES)


def author_names(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", F.posexplode(F.expr(_PEOPLE)).alias("at", "raw"))
    return rows.select("s_suppkey", "at", cite.author(F.col("raw")).alias("a")).select("s_suppkey", "at", "a.family", "a.initials")


_SENTENCE = "concat(c_name, ' is in ', c_mktsegment, case c_custkey % 4 when 0 then '.' when 1 then '?\"' when 2 then ' [1].' else '' end)"


def splice_citation(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.expr(_SENTENCE).alias("s"))
    return rows.select("c_custkey", cite.insertion_offset(F.col("s")).cast("long").alias("offset"), cite.spliced(F.col("s"), F.lit("(Smith, 2023)")).alias("spliced"))


def _recommendations(spark, sf_dir):
    order = Window.partitionBy("claim_id").orderBy(F.desc("score"), "ref_id")
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("claim_id"), F.col("l_suppkey").alias("ref_id")).agg(F.max(F.floor(F.col("l_quantity") * 2 + F.col("l_linenumber")).cast("double")).alias("score"))
    verdicts = F.element_at(F.array(*map(F.lit, shortlist.VERDICTS[:5])), (F.col("ref_id") % 5 + 1).cast("int"))
    return rows.withColumn("rank", F.row_number().over(order)).withColumn("verdict", verdicts)


def topn_per_claim(spark, sf_dir):
    return shortlist.top_per_claim(_recommendations(spark, sf_dir), 3).select("claim_id", "ref_id", "place")


def best_references(spark, sf_dir):
    return shortlist.best_references(_recommendations(spark, sf_dir), 50)


def best_reference(spark, sf_dir):
    return shortlist.best_reference(_recommendations(spark, sf_dir))


def verdict_histogram(spark, sf_dir):
    return shortlist.verdict_histogram(_recommendations(spark, sf_dir))


def _log(spark, sf_dir):
    decision = F.expr("case l_linenumber % 4 when 0 then 'REJECTED' when 1 then 'SAVED' else 'ACCEPTED' end")
    return read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 2000).alias("claim_id"), (F.col("l_suppkey") % 40).alias("ref_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), decision.alias("decision"))


def decisions(spark, sf_dir):
    return shortlist.decided(_log(spark, sf_dir))


def _claims(spark, sf_dir):
    """Orders as claims: the sentence stands in its draft's text, but for every seventh, which moved."""
    sentence = F.expr("concat('Claim ', o_orderkey, ' of ', o_orderpriority, '.')")
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"), F.col("o_orderkey").alias("draft_id"), sentence.alias("sentence"), (F.col("o_orderstatus") != "F").alias("needs_citation"))
    return rows.withColumn("char_start", F.when(F.col("claim_id") % 7 == 0, 3).otherwise(5)).withColumn("char_end", F.col("char_start") + F.length("sentence"))


def accepted_texts(spark, sf_dir):
    accepted = shortlist.decided(_log(spark, sf_dir)).withColumn("in_text", F.expr("concat('(Smith', ref_id, ', 2020)')"))
    return shortlist.accepted_texts(accepted)


def coverage(spark, sf_dir):
    return shortlist.coverage(_claims(spark, sf_dir), shortlist.decided(_log(spark, sf_dir)))


def audit_report(spark, sf_dir):
    c = _claims(spark, sf_dir)
    texts = F.concat(F.lit("Intro"), F.col("sentence"), F.lit(" End"))
    return shortlist.audit(c, c.select("draft_id", texts.alias("raw_text")), accepted_texts(spark, sf_dir)).select("claim_id", "outcome", "citation_text")


def _lines(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("draft_id"), F.posexplode(F.split("text", "\n")).alias("paragraph_index", "text"))


def markdown_export(spark, sf_dir):
    """Documents with a citation at the end of every second line."""
    lines = _lines(spark, sf_dir)
    splices = lines.where("paragraph_index % 2 = 1").select("draft_id", "paragraph_index", F.lit(0).alias("start"), F.char_length("text").alias("end"), F.col("text").alias("sentence"), F.concat(F.lit("(Smith, "), "paragraph_index", F.lit(")")).alias("citation"))
    return exporting.markdown(lines.withColumn("is_heading", F.col("paragraph_index") % 3 == 0), splices).select("draft_id", F.sha2("markdown", 256).alias("markdown_hash"))


def json_export(spark, sf_dir):
    accepted = shortlist.decided(_log(spark, sf_dir)).withColumn("draft_id", F.col("claim_id") % 100)
    return exporting.accepted_json(accepted).select("draft_id", F.sha2("json", 256).alias("json_hash"))


def download_names(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", exporting.download_name(F.concat("p_name", F.lit(': a/b "c"? '), "p_type"), "docx").alias("name"))


def bibliography_numbers(spark, sf_dir):
    accepted = shortlist.decided(_log(spark, sf_dir)).withColumn("draft_id", F.col("claim_id") % 100)
    return shortlist.bibliography_order(accepted)


def markdown_report(spark, sf_dir):
    """Drafts with reference lists and audit tables, where they have any."""
    lines = _lines(spark, sf_dir)
    n, doc = F.col("paragraph_index"), F.col("draft_id")
    references = lines.where((doc % 2 == 1) & (n < 4)).select("draft_id", (-n).alias("number"), F.concat(F.lit("*"), F.substring("text", 1, 20), F.lit("*")).alias("text"))
    audit = lines.where((doc % 3 != 0) & (n % 4 == 1)).select(
        "draft_id", n.alias("place"), F.when(n % 8 == 1, "Intro").alias("section_title"), F.concat(F.lit("a|"), "text").alias("claim_text"), F.lit("CAUSAL_CLAIM").alias("claim_type"), F.lit("NONE").alias("existing_citation_status"),
        F.when(n % 8 == 5, n / 2).alias("score_percentage"), F.when(n % 8 == 5, "SUPPORTED").alias("verdict"), F.lit("PENDING").alias("user_decision"), F.lit("INSERTED").alias("insertion_status"),
    )
    none = lines.where("false").select("draft_id", "paragraph_index", F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("sentence"), F.lit("").alias("citation"))
    return exporting.markdown(lines.withColumn("is_heading", n % 3 == 0), none, references, audit).select("draft_id", F.sha2("markdown", 256).alias("markdown_hash"))


_ALL = (cite_apa, cite_chicago, cite_ieee, author_names, splice_citation, topn_per_claim, best_references, best_reference, verdict_histogram, decisions, accepted_texts, coverage, audit_report, markdown_export, markdown_report, json_export, download_names, bibliography_numbers)
QUERIES = {f.__name__: f for f in _ALL}

# The names in the form that the parser should find, written out.
_PARSED = """[{'f': concat('Smith', s_suppkey % 7), 'i': 'J. A.'}, {'f': concat('Doe', substr('abcdefghij', s_suppkey % 10 + 1, 1)), 'i': 'J. A.'}, {'f': concat('Lee', substr('abcdefghij', s_nationkey % 10 + 1, 1)), 'i': 'J. Q.'},
  {'f': 'Zegarra Silva', 'i': 'D.'}, {'f': 'Wu', 'i': ''}, {'f': NULL, 'i': NULL}]"""
_REFS = f"""p5 AS (SELECT *, {_PARSED} AS one FROM supplier),
refs AS (SELECT s_suppkey AS ref_id, list_filter(flatten([one, one, one, one, one])[1:{_TAKEN}], lambda x: x.f IS NOT NULL) AS p, CASE WHEN s_suppkey % 9 <> 0 THEN concat('On ', s_name, ' and the art of ', s_nationkey) END AS title,
  CASE WHEN s_suppkey % 5 <> 0 THEN 2000 + s_nationkey % 3 END AS year, CASE s_suppkey % 3 WHEN 0 THEN 'IEEE Trans. Tests.' WHEN 1 THEN 'Journal of Tests' END AS source,
  CASE s_suppkey % 4 WHEN 0 THEN 'https://doi.org/10.1/' || s_suppkey WHEN 1 THEN 'https://s.org/' || s_suppkey WHEN 2 THEN 'https://l.org/' || s_suppkey END AS link FROM p5),
named AS (SELECT *, len(p) AS n, CASE WHEN title IS NULL THEN 'Untitled' ELSE '"' || array_to_string(string_split(title, ' ')[1:4], ' ') || '"' END AS short, coalesce(CAST(year AS VARCHAR), 'n.d.') AS y,
  list_transform(p, lambda x: CASE WHEN x.i = '' THEN x.f ELSE x.f || ', ' || x.i END) AS inv, list_transform(p, lambda x: trim(x.i || ' ' || x.f)) AS nat FROM refs),
keyed AS (SELECT *, lower(CASE WHEN n > 0 THEN p[1].f ELSE short END) AS k FROM named),
suffixed AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY k, year) > 1 THEN chr(CAST(96 + row_number() OVER (PARTITION BY k, year ORDER BY lower(coalesce(title, '')), ref_id) AS INTEGER)) ELSE '' END AS s FROM keyed)"""


def _who(joint: str) -> str:
    return f"CASE WHEN n = 0 THEN short WHEN n = 1 THEN p[1].f WHEN n = 2 THEN p[1].f || ' {joint} ' || p[2].f ELSE p[1].f || ' et al.' END"


def _dot(x: str) -> str:
    return f"CASE WHEN ({x}) LIKE '%.' THEN ({x}) ELSE ({x}) || '.' END"


_APA_NAMES = _dot("CASE WHEN n = 1 THEN inv[1] WHEN n <= 20 THEN array_to_string(inv[1:n - 1], ', ') || ', & ' || inv[n] ELSE array_to_string(inv[1:19], ', ') || ', . . . ' || inv[n] END")
_CHI_LIST = "list_concat(inv[1:1], nat[2:])"
_CHI_NAMES = _dot(f"CASE WHEN n = 1 THEN inv[1] WHEN n <= 10 THEN array_to_string(({_CHI_LIST})[1:n - 1], ', ') || ', and ' || nat[n] ELSE array_to_string(({_CHI_LIST})[1:7], ', ') || ', et al' END")
_IEEE_NAMES = "CASE WHEN n = 1 THEN nat[1] WHEN n = 2 THEN nat[1] || ' and ' || nat[2] WHEN n <= 6 THEN array_to_string(nat[1:n - 1], ', ') || ', and ' || nat[n] ELSE array_to_string(nat[1:3], ', ') || ', et al.' END"
_REC = """rec AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, ref_id) AS rank, ['SUPPORTED', 'PARTIALLY_SUPPORTED', 'TOPICALLY_RELATED_BUT_NOT_EVIDENCE', 'INSUFFICIENT_EVIDENCE', 'CONTRADICTED'][ref_id % 5 + 1] AS verdict
  FROM (SELECT l_orderkey AS claim_id, l_suppkey AS ref_id, max(floor(l_quantity * 2 + l_linenumber)) AS score FROM lineitem GROUP BY 1, 2))"""
_ACC = """acc AS (SELECT claim_id, ref_id, max("at") AS "at" FROM (SELECT l_orderkey % 2000 AS claim_id, l_suppkey % 40 AS ref_id, l_orderkey * 10 + l_linenumber AS "at", l_linenumber % 4 AS d FROM lineitem) GROUP BY 1, 2 HAVING arg_max(d, "at") IN (2, 3))"""
_TEXTS = """tx AS (SELECT claim_id, CASE WHEN count(*) = 1 THEN '(Smith' || any_value(ref_id) || ', 2020)' ELSE '(' || string_agg('Smith' || ref_id || ', 2020', '; ' ORDER BY "at", ref_id) || ')' END AS citation_text FROM acc GROUP BY 1)"""
_BEST = """b AS (SELECT ref_id, max(score) AS score, arg_min(claim_id, (-score, claim_id)) AS claim_id FROM rec WHERE rank = 1 GROUP BY 1)"""


def _best(n: int) -> str:
    return f"WITH {_REC}, {_BEST} SELECT ref_id, score, claim_id, score >= 65 AS usable, score >= 75 AS recommended FROM b ORDER BY score DESC, claim_id, ref_id LIMIT {n}"


SQL = {
    "cite_apa": f"""WITH {_REFS} SELECT ref_id, '(' || {_who("&")} || ', ' || y || s || ')' AS in_text, CASE WHEN n > 0 THEN {_APA_NAMES} || ' ' ELSE '' END || '(' || y || s || '). ' || coalesce(title, 'Untitled') || '. ' || coalesce(source, '') || coalesce(CASE WHEN source IS NULL THEN ' ' ELSE ', ' END || link, '') AS entry,
  row_number() OVER (ORDER BY k, coalesce(year, 0), s, ref_id) AS list_rank FROM suffixed""",
    "cite_chicago": f"""WITH {_REFS} SELECT ref_id, '(' || {_who("and")} || ' ' || y || s || ')' AS in_text, CASE WHEN n > 0 THEN {_CHI_NAMES} || ' ' ELSE '' END || y || s || '. “' || coalesce(title, 'Untitled') || '.” ' || CASE WHEN source IS NULL THEN '' ELSE {_dot("source")} END || coalesce(' ' || link, '') AS entry,
  row_number() OVER (ORDER BY k, coalesce(year, 0), s, ref_id) AS list_rank FROM suffixed""",
    "cite_ieee": f"""WITH {_REFS}, i AS (SELECT *, row_number() OVER (ORDER BY ref_id) AS no FROM keyed) SELECT ref_id, '[' || no || ']' AS in_text, '[' || no || '] ' || CASE WHEN n > 0 THEN {_IEEE_NAMES} || ', ' ELSE '' END || '“' || coalesce(title, 'Untitled') || ',” ' || coalesce(source || ', ', '') || y || '.' || coalesce(' [Online]. Available: ' || link, '') AS entry, no AS list_rank FROM i""",
    "author_names": f"""SELECT s_suppkey, CAST("at" - 1 AS INTEGER) AS "at", x.f AS family, x.i AS initials FROM (SELECT s_suppkey, unnest(p) AS x, generate_subscripts(p, 1) AS "at" FROM (SELECT s_suppkey, {_PARSED} AS p FROM supplier))""",
    "splice_citation": f"""WITH t AS (SELECT c_custkey, {_SENTENCE} AS s FROM customer), o AS (SELECT *, length(regexp_replace(s, '[.?!…"''”’]+$', '')) AS o FROM t) SELECT c_custkey, o AS "offset", s[1:o] || ' (Smith, 2023)' || s[o + 1:] AS spliced FROM o""",
    "topn_per_claim": f"WITH {_REC} SELECT claim_id, ref_id, rank AS place FROM rec WHERE rank <= 3",
    "best_references": _best(50),
    "best_reference": _best(1),
    "verdict_histogram": f"WITH {_REC} SELECT v AS verdict, count(rec.verdict) AS n FROM (SELECT unnest(['SUPPORTED', 'PARTIALLY_SUPPORTED', 'TOPICALLY_RELATED_BUT_NOT_EVIDENCE', 'INSUFFICIENT_EVIDENCE', 'CONTRADICTED', 'SKIPPED']) AS v) LEFT JOIN rec ON rec.verdict = v GROUP BY 1",
    "decisions": f"""WITH {_ACC} SELECT claim_id, ref_id, "at" FROM acc""",
    "accepted_texts": f"WITH {_ACC}, {_TEXTS} SELECT claim_id, citation_text FROM tx",
    "coverage": f"""WITH {_ACC}, c AS (SELECT o_orderkey AS claim_id FROM orders WHERE o_orderstatus <> 'F'), j AS (SELECT c.claim_id FROM c JOIN acc USING (claim_id))
SELECT (SELECT count(*) FROM c) AS needs, (SELECT count(*) FROM j) AS accepted, (SELECT count(DISTINCT claim_id) FROM j) AS covered, floor((SELECT count(DISTINCT claim_id) FROM j) * 100.0 / (SELECT count(*) FROM c) * 10.0 + 0.5) / 10.0 AS percent""",
    "audit_report": f"WITH {_ACC}, {_TEXTS} SELECT o_orderkey AS claim_id, CASE WHEN citation_text IS NULL THEN 'NOT_ACCEPTED' WHEN o_orderkey % 7 = 0 THEN 'POSITION_MISMATCH' ELSE 'INSERTED' END AS outcome, citation_text FROM orders LEFT JOIN tx ON claim_id = o_orderkey WHERE o_orderstatus <> 'F'",
    "markdown_export": """WITH l AS (SELECT doc_id, i, t, length(regexp_replace(t, '[.?!…"''”’]+$', '')) AS o FROM (SELECT doc_id, unnest(ls) AS t, generate_subscripts(ls, 1) - 1 AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
m AS (SELECT doc_id, i, CASE WHEN i = 0 THEN '# ' WHEN i % 3 = 0 THEN '## ' ELSE '' END || CASE WHEN i % 2 = 1 THEN t[1:o] || ' (Smith, ' || i || ')' || t[o + 1:] ELSE t END AS t FROM l)
SELECT doc_id AS draft_id, sha256(string_agg(t, chr(10) || chr(10) ORDER BY i)) AS markdown_hash FROM m GROUP BY 1""",
    "markdown_report": """WITH l AS (SELECT doc_id, unnest(ls) AS t, generate_subscripts(ls, 1) - 1 AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
b AS (SELECT doc_id, string_agg(CASE WHEN i = 0 THEN '# ' WHEN i % 3 = 0 THEN '## ' ELSE '' END || t, chr(10) || chr(10) ORDER BY i) AS body FROM l GROUP BY 1),
r AS (SELECT doc_id, string_agg('- *' || substring(t, 1, 20) || '*', chr(10) ORDER BY -i) AS refs FROM l WHERE doc_id % 2 = 1 AND i < 4 GROUP BY 1),
a AS (SELECT doc_id, string_agg('| ' || CASE WHEN i % 8 = 1 THEN 'Intro' ELSE '' END || ' | ' || substring('a\\|' || replace(t, '|', '\\|'), 1, 120) || ' | CAUSAL_CLAIM | NONE | ' || CASE WHEN i % 8 = 5 THEN format('{:.1f}', i / 2) || '% | SUPPORTED' ELSE ' | ' END || ' | PENDING | INSERTED |', chr(10) ORDER BY i) AS rows
  FROM l WHERE doc_id % 3 <> 0 AND i % 4 = 1 GROUP BY 1)
SELECT doc_id AS draft_id, sha256(body || coalesce(chr(10) || chr(10) || '## References' || chr(10) || chr(10) || refs, '') || chr(10) || chr(10) || '## Citation Audit Report' || chr(10) || chr(10)
  || coalesce('| Section | Claim | Type | Existing citation | Score | Verdict | Decision | Status |' || chr(10) || '|---|---|---|---|---|---|---|---|' || chr(10) || rows, '_No claims required a citation._')) AS markdown_hash
FROM b LEFT JOIN r USING (doc_id) LEFT JOIN a USING (doc_id)""",
    "json_export": f"""WITH {_ACC}, e AS (SELECT claim_id % 100 AS draft_id, claim_id, '{{"claim_id":' || claim_id || ',"references":[' || string_agg(CAST(ref_id AS VARCHAR), ',' ORDER BY "at", ref_id) || ']}}' AS j FROM acc GROUP BY claim_id)
SELECT draft_id, sha256('{{"accepted":[' || string_agg(j, ',' ORDER BY claim_id) || ']}}') AS json_hash FROM e GROUP BY 1""",
    "download_names": """SELECT p_partkey, '[INTI] ' || trim(regexp_replace(p_name || ': a/b "c"? ' || p_type, '[\\\\/:*?"<>|\\x00-\\x1f]', '_', 'g')) || '.docx' AS name FROM part""",
    "bibliography_numbers": f"""WITH {_ACC}, f AS (SELECT claim_id % 100 AS draft_id, ref_id, min(("at", claim_id)) AS first FROM acc GROUP BY 1, 2) SELECT draft_id, ref_id, row_number() OVER (PARTITION BY draft_id ORDER BY first, ref_id) AS number FROM f""",
}
