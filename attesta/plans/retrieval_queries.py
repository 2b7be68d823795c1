"""Queries of retrieval, ranking and scoring, with SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.text import RETRIEVAL_STOPWORDS, VERIFIER_STOPWORDS, rounded, sentence_hash, tokens
from ..operators import retrieval
from ..operators.keyphrases import CUTTING, LEAST_CHARACTERS, key_phrases, with_keywords
from ..operators.models import hashed_embedding
from ..operators.staging import computed_once
from ..operators.text_index import TextIndex, best_by_scan
from ..operators.vector_index import VectorIndex
from ..operators.verification import NO_ABSTRACT, UNAVAILABLE, verified
from .recommend import gate, recommend, recommend_drafts, reranked

AS_OF_YEAR, WINDOW_YEARS = 2026, 5
MIN_YEAR = AS_OF_YEAR - (WINDOW_YEARS - 1)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim_id"), F.col("text").alias("query"))
    return items.join(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("claim_id"), F.col("embedding").alias("vector")), "claim_id")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ref_id"),
        F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[^ \n]+"), F.lit(0)), 1, 8), " ").alias("title"),
        F.col("text").alias("abstract"),
        (2017 + F.col("doc_id") % 10).cast("int").alias("year"),
    )
    return docs.join(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ref_id"), F.col("embedding").alias("vector")), "ref_id", "left")


def vector_topk(spark, sf_dir):
    return VectorIndex.build(papers(spark, sf_dir)).nearest(claims(spark, sf_dir), retrieval.RETRIEVED)[0]


def recency_filtered_topk(spark, sf_dir):
    return VectorIndex.build(papers(spark, sf_dir)).nearest(claims(spark, sf_dir), retrieval.RETRIEVED, MIN_YEAR)[0]


def vector_topk_scan(spark, sf_dir):
    """vector_topk without an index: the claims go to the papers."""
    return retrieval.vector_topk(claims(spark, sf_dir), papers(spark, sf_dir))


def tokenize_docs(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("tokens_hash"))


def _texts(spark, sf_dir):
    return papers(spark, sf_dir).select("ref_id", tokens(F.concat_ws(" ", "title", "abstract")).alias("words"))


def bm25_topk(spark, sf_dir):
    """Whole items as queries: their words are mostly common ones, so the papers are passed by once."""
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim_id"), tokens(F.col("text")).alias("words"))
    return best_by_scan(asked, _texts(spark, sf_dir), 20)


def bm25_index_topk(spark, sf_dir):
    """Searches of three words, those of each item that the fewest papers have, in the index."""
    index = TextIndex.build(_texts(spark, sf_dir))
    words = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim_id"), F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    order = Window.partitionBy("claim_id").orderBy("n", "token")
    rarest = words.join(index.frequencies, "token").withColumn("place", F.row_number().over(order)).where("place <= 3")
    return index.best(rarest.groupBy("claim_id").agg(F.collect_list("token").alias("words")), 5)[0]


def _preranked(spark, sf_dir):
    c, p = claims(spark, sf_dir), papers(spark, sf_dir)
    words = p.where("vector is not null").select("ref_id", tokens(F.concat_ws(" ", "title", "abstract")).alias("words"))
    asked = computed_once(with_keywords(c.select("claim_id", "query", tokens(F.col("query")).alias("query_words"))))
    ranked = retrieval.prerank(computed_once(retrieval.vector_topk(c, p)), asked, p.select("ref_id", tokens(F.col("title")).alias("keyword_words")), words)
    return ranked, asked, p


def hybrid_prerank(spark, sf_dir):
    return _preranked(spark, sf_dir)[0].select("claim_id", "ref_id", "vector_rank", rounded(F.col("lexical"), 6).alias("lexical"), rounded(F.col("keyword"), 6).alias("keyword"), "prerank", "prerank_rank")


def fake_rerank(spark, sf_dir):
    return reranked(*_preranked(spark, sf_dir)).select("claim_id", "ref_id", "prerank_rank", "rerank")


def claim_gate(spark, sf_dir):
    return gate(reranked(*_preranked(spark, sf_dir))).select("claim_id", "ref_id", "rerank", "rerank_rank")


def mock_verdicts(spark, sf_dir):
    near = retrieval.vector_topk(claims(spark, sf_dir), papers(spark, sf_dir))
    rows = near.join(claims(spark, sf_dir).select("claim_id", "query"), "claim_id").join(papers(spark, sf_dir).select("ref_id", "abstract"), "ref_id")
    return rows.select("claim_id", "ref_id", scoring.rule_verdict(F.col("query"), F.col("abstract")).alias("verdict"))


def _stand_in(claim, context, candidates, fault):
    """A model that fails for some claims, answers some in a wrong form at first, leaves candidates out and invents one."""
    if len(claim) % 5 == 0:
        raise TimeoutError
    if len(claim) % 3 == 0 and fault is None:
        return [{"idx": 0, "verdict": "YES"}]
    sizes = [(i, len(c["abstract"])) for i, c in enumerate(candidates)]
    told = [{"idx": i, "verdict": list(scoring.VERDICT_SCORES)[n % 5], "evidence": f"{n} characters"} for i, n in sizes if n % 7]
    return [*told, {"idx": 99, "verdict": "SUPPORTED"}]


def _verified(spark, sf_dir):
    """The five nearest papers of each claim; every sixth paper's abstract is blank, every fourth pair is in the cache."""
    near = retrieval.vector_topk(claims(spark, sf_dir), papers(spark, sf_dir), 5)
    asked = claims(spark, sf_dir).select("claim_id", sentence_hash(F.col("query")).alias("claim_hash"), F.col("query").alias("claim_text"), F.lit("").alias("claim_context"))
    abstract = F.when(F.col("ref_id") % 6 == 0, " ").otherwise(F.col("abstract")).alias("abstract")
    texts = papers(spark, sf_dir).select("ref_id", "title", abstract, F.array("title").alias("keywords"))
    rows = near.join(asked, "claim_id").join(texts, "ref_id").withColumn("place", F.col("vector_rank"))
    told = [F.lit("held").alias("evidence"), F.lit("").alias("limitations"), F.lit("").alias("recommended_usage")]
    cache = near.where("(claim_id + ref_id) % 4 = 0").join(asked, "claim_id").select("claim_hash", "ref_id", F.lit("PARTIALLY_SUPPORTED").alias("verdict"), *told)
    return verified(rows, cache, _stand_in)


def verified_pairs(spark, sf_dir):
    return _verified(spark, sf_dir).outcomes.select("claim_id", "ref_id", "verdict", "support_score", "evidence", "recommended_usage", "from_cache")


def verdict_entries(spark, sf_dir):
    """What these calls add to the cache."""
    return _verified(spark, sf_dir).entries.select("claim_hash", "ref_id", "verdict", "evidence")


def recommend_pipeline(spark, sf_dir):
    out = recommend(claims(spark, sf_dir), papers(spark, sf_dir))
    return out.select("claim_id", "ref_id", "rank", rounded(F.col("semantic"), 4).alias("semantic"), rounded(F.col("lexical"), 4).alias("lexical"), rounded(F.col("keyword"), 4).alias("keyword"), rounded(F.col("rerank"), 4).alias("rerank"), "verdict", "percentage", "label")


def recommend_by_draft(spark, sf_dir):
    """Items as claims of three drafts, some without need or confidence, every fourth with a context: eight of each are asked, four verified."""
    c = F.col("claim_id")
    rows = claims(spark, sf_dir).select(
        "claim_id", (c % 3).alias("draft_id"), (c % 7 != 0).alias("needs_citation"), F.when(c % 6 != 0, c % 5 / 10).alias("confidence"), c.alias("char_start"),
        F.col("query").alias("claim_text"), F.when(c % 4 == 0, F.concat(F.lit("Claim: "), "query")).otherwise(" ").alias("local_context"), "vector",
    )
    return recommend_drafts(rows, papers(spark, sf_dir), most=8, verified=4).select("draft_id", "claim_id", "ref_id", "rank", "verdict", "percentage", "label")


def jaccard_overlap(spark, sf_dir):
    near = retrieval.vector_topk(claims(spark, sf_dir), papers(spark, sf_dir))
    rows = near.join(with_keywords(claims(spark, sf_dir)).select("claim_id", F.col("keywords").alias("k")), "claim_id").join(papers(spark, sf_dir).select("ref_id", tokens(F.col("title")).alias("w")), "ref_id")
    from ..functions.text import jaccard

    return rows.select("claim_id", "ref_id", rounded(jaccard(F.col("k"), F.col("w")), 6).alias("keyword"))


def item_key_phrases(spark, sf_dir):
    """The best phrases of each item, scored over all items."""
    return key_phrases(read(spark, sf_dir, "benchmark"), "item_id", "text").select("item_id", F.array_join("phrases", "|").alias("phrases"))


def fake_embed_sparse(spark, sf_dir):
    return hashed_embedding(read(spark, sf_dir, "documents"), "doc_id", "text").withColumn("weight", rounded(F.col("weight"), 6))


def _score_parts(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        (F.col("l_quantity") / 50).alias("s"), (F.col("l_discount") * 10).alias("l"), (F.col("l_tax") * 10).alias("k"), (F.col("l_quantity") / 60).alias("r"),
        F.element_at(F.array(*map(F.lit, [*scoring.VERDICT_SCORES, "SKIPPED"])), (F.col("l_linenumber") % 6 + 1).cast("int")).alias("verdict"),
        (F.col("l_returnflag") != "R").alias("has_abstract"),
    )


def _scored(spark, sf_dir):
    parts = _score_parts(spark, sf_dir).withColumn("final", scoring.final_score(*(F.col(c) for c in "slkr"), scoring.verdict_score(F.col("verdict"))))
    shown = parts.withColumn("percentage", scoring.percentage(rounded(F.col("final"), 9), F.col("verdict"), F.col("has_abstract")))
    return shown.withColumn("label", scoring.label(F.col("percentage"), F.col("verdict"), F.col("has_abstract")))


def score_blend(spark, sf_dir):
    return _scored(spark, sf_dir).where("verdict <> 'SKIPPED'").select("l_orderkey", "l_linenumber", rounded(F.col("final"), 6).alias("final_score"))


def score_skipped(spark, sf_dir):
    return _scored(spark, sf_dir).where("verdict = 'SKIPPED'").select("l_orderkey", "l_linenumber", rounded(F.col("final"), 6).alias("final_score"))


def score_caps(spark, sf_dir):
    return _scored(spark, sf_dir).select("l_orderkey", "l_linenumber", "verdict", "percentage")


def score_labels(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy("verdict", "has_abstract", "label").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (vector_topk, recency_filtered_topk, vector_topk_scan, tokenize_docs, bm25_topk, bm25_index_topk, jaccard_overlap, hybrid_prerank, fake_rerank, claim_gate, mock_verdicts, recommend_pipeline, recommend_by_draft, verified_pairs, verdict_entries, item_key_phrases, fake_embed_sparse, score_blend, score_skipped, score_caps, score_labels)}


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _tok(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[a-z][a-z0-9\\-]{{2,}}'), lambda t: NOT list_contains({_list(RETRIEVAL_STOPWORDS)}, t))"


def _vtok(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[a-z]{{3,}}'), lambda t: NOT list_contains({_list(VERIFIER_STOPWORDS)}, t)))"


def _round(x: str, digits: int) -> str:
    return f"(floor(({x}) * {10**digits}.0 + 0.5) / {10**digits}.0)"


TABLES = f"""claims AS (SELECT item_id AS claim_id, text AS query, CAST(embedding AS DOUBLE[]) AS v FROM benchmark JOIN embeddings ON vec_id = item_id),
papers AS (SELECT doc_id AS ref_id, array_to_string(regexp_extract_all(text, '[^ \\n]+')[1:8], ' ') AS title, text AS abstract, CAST(2017 + doc_id % 10 AS INTEGER) AS year, CAST(embedding AS DOUBLE[]) AS v
  FROM documents LEFT JOIN embeddings ON vec_id = doc_id)"""


def _near(where: str = "") -> str:
    return f"""near AS (SELECT * FROM (SELECT claim_id, ref_id, semantic, row_number() OVER (PARTITION BY claim_id ORDER BY semantic DESC, ref_id) AS vector_rank
  FROM (SELECT claim_id, ref_id, {_round("list_cosine_similarity(c.v, p.v)", 9)} AS semantic FROM claims c, papers p WHERE p.v IS NOT NULL {where})) WHERE vector_rank <= 20)"""


def _bm25(corpus_filter: str, pairs: str) -> str:
    return f"""corpus AS (SELECT ref_id, {_tok("concat_ws(' ', title, abstract)")} AS w FROM papers {corpus_filter}),
totals AS (SELECT count(*) AS n_docs, avg(len(w)) AS avgdl FROM corpus),
dfs AS (SELECT t, count(*) AS n FROM (SELECT unnest(list_distinct(w)) AS t FROM corpus) GROUP BY t),
raws AS (SELECT t, ln(n_docs - n + 0.5) - ln(n + 0.5) AS raw FROM dfs, totals),
idfs AS (SELECT t, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raws) ELSE raw END AS idf FROM raws),
asked AS (SELECT claim_id, t, count(*) AS times FROM (SELECT claim_id, unnest({_tok("query")}) AS t FROM claims_all) GROUP BY claim_id, t),
post AS (SELECT ref_id, dl, t, count(*) AS tf FROM (SELECT ref_id, len(w) AS dl, unnest(w) AS t FROM corpus) GROUP BY ref_id, dl, t),
bm AS (SELECT a.claim_id, p.ref_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS bm25
  FROM asked a JOIN post p ON a.t = p.t JOIN idfs i ON i.t = a.t, totals {pairs} GROUP BY a.claim_id, p.ref_id)"""


_ASKED = f"asked AS (SELECT claim_id, t, count(*) AS times FROM (SELECT claim_id, unnest({_tok('query')}) AS t FROM claims_all) GROUP BY claim_id, t)"
_ASKED_RAREST = f"""asked AS (SELECT claim_id, t, 1 AS times FROM (SELECT claim_id, t, row_number() OVER (PARTITION BY claim_id ORDER BY n, t) AS place
  FROM (SELECT DISTINCT claim_id, unnest({_tok("query")}) AS t FROM claims_all) JOIN dfs USING (t)) WHERE place <= 3)"""
assert _ASKED in _bm25("", "")


def _phrases(source: str, key: str, text: str) -> str:
    """CTEs up to kp (key, ps): the best phrases of each text of ``source``."""
    return f"""kt AS (SELECT {key} AS key, list_transform(regexp_extract_all(lower(coalesce({text}, '')), '\\p{{L}}+|[^\\p{{L}}\\s]+'), lambda t: CASE WHEN list_contains({_list(CUTTING)}, t) OR NOT regexp_matches(t, '^\\p{{L}}') THEN '|' ELSE t END) AS l FROM {source}),
kl AS (SELECT key, list_filter(list_transform(string_split(array_to_string(l, ' '), '|'), lambda p: trim(p)), lambda p: length(p) >= {LEAST_CHARACTERS}) AS l FROM kt),
ke AS (SELECT key, unnest(l) AS phrase, generate_subscripts(l, 1) AS "at" FROM kl),
kw AS (SELECT key, phrase, "at", unnest(string_split(phrase, ' ')) AS word, len(string_split(phrase, ' ')) AS size FROM ke),
kc AS (SELECT word, sum(size) / count(*) AS score FROM kw GROUP BY 1),
ks AS (SELECT key, phrase, min("at") AS "at", {_round("sum(score) / count(DISTINCT kw.at)", 6)} AS score FROM kw JOIN kc USING (word) GROUP BY 1, 2),
kp AS (SELECT key, list(phrase ORDER BY place) AS ps FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, "at") AS place FROM ks) WHERE place <= 12 GROUP BY 1)"""


#: The claims' keywords: kk (claim_id, k).
KEYWORDS = f"""{_phrases("claims", "claim_id", "query")},
kk AS (SELECT claim_id, coalesce(list_distinct({_tok("array_to_string(ps, ' ')")}), []) AS k FROM claims LEFT JOIN kp ON key = claim_id)"""
CLAIMS_ALL = "claims_all AS (SELECT item_id AS claim_id, text AS query FROM benchmark)"
_JACCARD = f"""CASE WHEN len(k) = 0 OR len(w) = 0 THEN 0.0 ELSE len(list_intersect(k, list_distinct(w))) / len(list_distinct(list_concat(k, w))) END"""
PRERANKED = f"""{TABLES}, {CLAIMS_ALL}, {KEYWORDS}, {_near()}, {_bm25("WHERE v IS NOT NULL", "")},
joined AS (SELECT n.*, {_round("coalesce(bm25, 0)", 6)} AS b, k, {_tok("title")} AS w
  FROM near n LEFT JOIN bm ON bm.claim_id = n.claim_id AND bm.ref_id = n.ref_id JOIN kk c ON c.claim_id = n.claim_id JOIN papers p ON p.ref_id = n.ref_id),
parts AS (SELECT *, CASE WHEN max(b) OVER g > min(b) OVER g THEN (b - min(b) OVER g) / (max(b) OVER g - min(b) OVER g) WHEN max(b) OVER g > 0 THEN 1.0 ELSE 0.0 END AS lexical, {_JACCARD} AS keyword
  FROM joined WINDOW g AS (PARTITION BY claim_id)),
pre AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY prerank DESC, vector_rank) AS prerank_rank
  FROM (SELECT *, {_round("0.55 * semantic + 0.20 * lexical + 0.15 * keyword", 6)} AS prerank FROM parts)) WHERE prerank_rank <= 10)"""
_QT = f"list_distinct({_tok('query')})"
RERANKED = f"""{PRERANKED},
re AS (SELECT pre.*, query, abstract, {_round(f"CASE WHEN len({_QT}) = 0 THEN 0.0 ELSE len(list_intersect({_QT}, list_distinct({_tok("concat_ws('. ', title, substring(abstract, 1, 1500))")}))) / len({_QT}) END", 6)} AS rerank
  FROM pre JOIN claims c ON c.claim_id = pre.claim_id JOIN papers p ON p.ref_id = pre.ref_id)"""
GATED = f"""{RERANKED},
best AS (SELECT claim_id FROM re GROUP BY claim_id ORDER BY max(rerank) DESC, claim_id LIMIT 20),
gated AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY rerank DESC, prerank_rank) AS rerank_rank FROM re) WHERE rerank_rank <= 3 AND claim_id IN (FROM best))"""
_RATIO = f"CASE WHEN len({_vtok('query')}) = 0 THEN 0.0 ELSE len(list_intersect({_vtok('query')}, {_vtok('abstract')})) / len({_vtok('query')}) END"
_CUES = "regexp_matches(lower(abstract), '" + "|".join(scoring.CONTRADICTION_CUES) + "')"
_VERDICT = f"""CASE WHEN trim(coalesce(abstract, '')) = '' THEN 'INSUFFICIENT_EVIDENCE' WHEN {_CUES} AND ratio >= 0.2 THEN 'CONTRADICTED' WHEN ratio >= 0.45 THEN 'SUPPORTED'
  WHEN ratio >= 0.30 THEN 'PARTIALLY_SUPPORTED' WHEN ratio >= 0.15 THEN 'TOPICALLY_RELATED_BUT_NOT_EVIDENCE' ELSE 'INSUFFICIENT_EVIDENCE' END"""
_VALUE = "CASE verdict " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in scoring.VERDICT_SCORES.items()) + " END"


def _final(s: str, l: str, k: str, r: str, v: str) -> str:  # noqa: E741
    weighted = f"(0.30 * {s} + 0.15 * {l} + 0.10 * {k} + 0.30 * {r})"
    return f"greatest(0.0, least(1.0, CASE WHEN {v} IS NULL THEN {weighted} / (0.30 + 0.15 + 0.10 + 0.30) ELSE {weighted} + 0.15 * {v} END))"


def _shown(final: str, has: str) -> str:
    shown = f"(CASE WHEN verdict = 'CONTRADICTED' THEN least({_round(final + ' * 100', 1)}, 20.0) ELSE {_round(final + ' * 100', 1)} END)"
    return f"CASE WHEN {has} THEN {shown} ELSE least({shown}, 45.0) END"


def _label(p: str, has: str) -> str:
    bands = " ".join(f"WHEN {p} >= {least} THEN '{name}'" for least, name in scoring.BANDS)
    return f"""CASE WHEN NOT ({has}) THEN 'Cannot verify' WHEN verdict = 'TOPICALLY_RELATED_BUT_NOT_EVIDENCE' AND {p} >= 85 THEN 'Recommended'
  WHEN verdict IN ('INSUFFICIENT_EVIDENCE', 'SKIPPED') AND {p} >= 70 THEN 'Possible reference' {bands} ELSE 'Do not recommend' END"""


_ITEMS = f"""parts AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS s, l_discount * 10 AS l, l_tax * 10 AS k, l_quantity / 60 AS r,
  {_list([*scoring.VERDICT_SCORES, "SKIPPED"])}[l_linenumber % 6 + 1] AS verdict, l_returnflag <> 'R' AS has_abstract FROM lineitem),
valued AS (SELECT *, {_VALUE} AS v FROM parts),
finals AS (SELECT *, {_final("s", "l", "k", "r", "v")} AS final FROM valued),
shown AS (SELECT *, {_shown(_round("final", 9), "has_abstract")} AS percentage FROM finals)"""
_TOKENS = _tok("text")
_SHOWN = f"""ratios AS (SELECT *, {_RATIO} AS ratio FROM gated), judged AS (SELECT *, {_VERDICT} AS verdict FROM ratios), valued AS (SELECT *, {_VALUE} AS v FROM judged),
finals AS (SELECT *, {_final("semantic", "lexical", "keyword", "rerank", "v")} AS final FROM valued),
shown AS (SELECT *, trim(coalesce(abstract, '')) <> '' AS has, {_shown("final", "trim(coalesce(abstract, '')) <> ''")} AS percentage FROM finals)"""
_OF_DRAFTS = {
    TABLES[: TABLES.index("papers AS")]: """claims AS (SELECT claim_id, query, v FROM (SELECT item_id AS claim_id, CASE WHEN item_id % 4 = 0 THEN 'Claim: ' || text ELSE text END AS query, CAST(embedding AS DOUBLE[]) AS v,
  row_number() OVER (PARTITION BY item_id % 3 ORDER BY CASE WHEN item_id % 6 = 0 THEN 0.0 ELSE (item_id % 5) / 10 END DESC, item_id) AS n FROM benchmark JOIN embeddings ON vec_id = item_id WHERE item_id % 7 <> 0) WHERE n <= 8),
""",
    CLAIMS_ALL: "claims_all AS (SELECT claim_id, query FROM claims)",
    "best AS (SELECT claim_id FROM re GROUP BY claim_id ORDER BY max(rerank) DESC, claim_id LIMIT 20)": "best AS (SELECT claim_id FROM (SELECT claim_id, row_number() OVER (PARTITION BY claim_id % 3 ORDER BY max(rerank) DESC, claim_id) AS n FROM re GROUP BY claim_id) WHERE n <= 4)",
}
_DRAFTS = GATED
for _whole, _each in _OF_DRAFTS.items():
    assert _whole in _DRAFTS
    _DRAFTS = _DRAFTS.replace(_whole, _each)

_VERIFIED = f"""WITH {TABLES}, {_near()},
q AS (SELECT n.claim_id, n.ref_id, query, (n.claim_id + n.ref_id) % 4 = 0 AS held, CASE WHEN n.ref_id % 6 = 0 THEN ' ' ELSE abstract END AS a FROM near n JOIN claims c ON c.claim_id = n.claim_id JOIN papers p ON p.ref_id = n.ref_id WHERE vector_rank <= 5),
v AS (SELECT *, trim(a) = '' AS blank, CASE WHEN held THEN 'PARTIALLY_SUPPORTED' WHEN trim(a) = '' THEN 'INSUFFICIENT_EVIDENCE' WHEN length(query) % 5 = 0 OR length(a) % 7 = 0 THEN 'SKIPPED'
  ELSE {_list(scoring.VERDICT_SCORES)}[length(a) % 5 + 1] END AS verdict FROM q)"""

SQL = {
    "vector_topk": f"WITH {TABLES}, {_near()} SELECT * FROM near",
    "vector_topk_scan": f"WITH {TABLES}, {_near()} SELECT * FROM near",
    "recency_filtered_topk": f"WITH {TABLES}, {_near(f'AND year >= {MIN_YEAR}')} SELECT * FROM near",
    "tokenize_docs": f"SELECT doc_id, len({_TOKENS}) AS n_tokens, sha256(array_to_string({_TOKENS}, ' ')) AS tokens_hash FROM documents",
    "bm25_topk": f"""WITH {TABLES}, {CLAIMS_ALL}, {_bm25("", "")}
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY bm25 DESC, ref_id) AS bm25_rank FROM (SELECT claim_id, ref_id, {_round("bm25", 6)} AS bm25 FROM bm)) WHERE bm25_rank <= 20""",
    "item_key_phrases": f"WITH {_phrases('benchmark', 'item_id', 'text')} SELECT key AS item_id, array_to_string(ps, '|') AS phrases FROM kp",
    "verified_pairs": f"""{_VERIFIED} SELECT claim_id, ref_id, verdict, coalesce({_VALUE}, 0.0) AS support_score, CASE WHEN held THEN 'held' WHEN blank OR verdict = 'SKIPPED' THEN '' ELSE length(a) || ' characters' END AS evidence,
  CASE WHEN held THEN '' WHEN blank THEN '{NO_ABSTRACT[2]}' WHEN verdict = 'SKIPPED' THEN '{UNAVAILABLE[2]}' ELSE '' END AS recommended_usage, held AS from_cache FROM v""",
    "verdict_entries": f"""{_VERIFIED} SELECT DISTINCT sha256(regexp_replace(lower(trim(query)), '\\s+', ' ', 'g')) AS claim_hash, ref_id, verdict, length(a) || ' characters' AS evidence FROM v WHERE NOT held AND NOT blank AND verdict <> 'SKIPPED'""",
    "bm25_index_topk": f"""WITH {TABLES}, {CLAIMS_ALL}, {_bm25("", "").replace(_ASKED, _ASKED_RAREST)}
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY bm25 DESC, ref_id) AS bm25_rank FROM (SELECT claim_id, ref_id, {_round("bm25", 6)} AS bm25 FROM bm)) WHERE bm25_rank <= 5""",
    "jaccard_overlap": f"WITH {TABLES}, {KEYWORDS}, {_near()}, j AS (SELECT n.claim_id, n.ref_id, k, {_tok('title')} AS w FROM near n JOIN kk c ON c.claim_id = n.claim_id JOIN papers p ON p.ref_id = n.ref_id) SELECT claim_id, ref_id, {_round(_JACCARD, 6)} AS keyword FROM j",
    "hybrid_prerank": f"WITH {PRERANKED} SELECT claim_id, ref_id, vector_rank, {_round('lexical', 6)} AS lexical, {_round('keyword', 6)} AS keyword, prerank, prerank_rank FROM pre",
    "fake_rerank": f"WITH {RERANKED} SELECT claim_id, ref_id, prerank_rank, rerank FROM re",
    "claim_gate": f"WITH {GATED} SELECT claim_id, ref_id, rerank, rerank_rank FROM gated",
    "mock_verdicts": f"WITH {TABLES}, {_near()}, q AS (SELECT n.claim_id, n.ref_id, query, abstract FROM near n JOIN claims c ON c.claim_id = n.claim_id JOIN papers p ON p.ref_id = n.ref_id), ratios AS (SELECT *, {_RATIO} AS ratio FROM q) SELECT claim_id, ref_id, {_VERDICT} AS verdict FROM ratios",
    "recommend_by_draft": f"""WITH {_DRAFTS}, {_SHOWN} SELECT claim_id % 3 AS draft_id, claim_id, ref_id, row_number() OVER (PARTITION BY claim_id ORDER BY percentage DESC, rerank_rank) AS rank, verdict, percentage, {_label("percentage", "has")} AS label FROM shown""",
    "recommend_pipeline": f"""WITH {GATED}, {_SHOWN}
SELECT claim_id, ref_id, row_number() OVER (PARTITION BY claim_id ORDER BY percentage DESC, rerank_rank) AS rank, {_round("semantic", 4)} AS semantic, {_round("lexical", 4)} AS lexical,
  {_round("keyword", 4)} AS keyword, {_round("rerank", 4)} AS rerank, verdict, percentage, {_label("percentage", "has")} AS label FROM shown""",
    "fake_embed_sparse": """WITH w AS (SELECT doc_id, regexp_replace(lower(t), '[^\\p{L}\\p{N}]', '', 'g') AS t FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\n\\t\\r]+')) AS t FROM documents)),
h AS (SELECT doc_id, md5(t) AS m FROM w WHERE t <> ''),
d AS (SELECT doc_id, list_reduce([0, CAST('0x' || m[1:8] AS BIGINT), CAST('0x' || m[9:16] AS BIGINT), CAST('0x' || m[17:24] AS BIGINT), CAST('0x' || m[25:32] AS BIGINT)], lambda a, x: (a * (4294967296 % 768) + x) % 768) AS dim FROM h),
c AS (SELECT doc_id, dim, count(*) AS n FROM d GROUP BY doc_id, dim)
SELECT doc_id, dim, n, floor(n / sqrt(CAST(sum(n * n) OVER (PARTITION BY doc_id) AS DOUBLE)) * 1000000.0 + 0.5) / 1000000.0 AS weight FROM c""",
    "score_blend": f"WITH {_ITEMS} SELECT l_orderkey, l_linenumber, {_round('final', 6)} AS final_score FROM finals WHERE verdict <> 'SKIPPED'",
    "score_skipped": f"WITH {_ITEMS} SELECT l_orderkey, l_linenumber, {_round('final', 6)} AS final_score FROM finals WHERE verdict = 'SKIPPED'",
    "score_caps": f"WITH {_ITEMS} SELECT l_orderkey, l_linenumber, verdict, percentage FROM shown",
    "score_labels": f"WITH {_ITEMS} SELECT verdict, has_abstract, {_label('percentage', 'has_abstract')} AS label, count(*) AS n FROM shown GROUP BY ALL",
}
