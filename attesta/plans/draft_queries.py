"""Queries of drafts: blocks, sentences, claims, goals."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import claims
from ..functions.offsets import normalized_with_map, source_span
from ..functions.text import sentence_hash
from ..operators import drafts, sdg
from ..operators import sentences as sentence_ends
from ..operators.staging import computed_once, ensure_shared_dir
from .retrieval_queries import read


def _raw(spark, sf_dir):
    """Documents as drafts: lines are paragraphs, every third line with at least one is a heading."""
    lines = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("draft_id"), F.posexplode(F.split("text", "\n")).alias("paragraph_index", "text"))
    return lines.withColumn("is_heading", F.col("paragraph_index") % 3 == 0)


def block_offsets(spark, sf_dir):
    blocks = drafts.assembled(_raw(spark, sf_dir))
    return blocks.select("draft_id", "paragraph_index", "char_start", "char_end", F.sha2("text", 256).alias("text_hash"))


def section_titles(spark, sf_dir):
    return drafts.assembled(_raw(spark, sf_dir)).select("draft_id", "paragraph_index", F.sha2("section_title", 256).alias("section_hash"))


def local_context(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("draft_id"), F.col("turn").alias("paragraph_index"), F.lit(0).alias("sentence_index"), "text")
    return drafts.with_context(turns).select("draft_id", "paragraph_index", F.sha2("local_context", 256).alias("context_hash"))


def sentence_offsets(spark, sf_dir):
    """Every sentence stands in its draft's text where its offsets say."""
    blocks = drafts.assembled(_raw(spark, sf_dir))
    whole = blocks.groupBy("draft_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph_index", "text"))), lambda b: b["text"]), "\n\n").alias("raw_text"))
    found = drafts.sentences(blocks).join(whole, "draft_id")
    there = F.substr("raw_text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")) == F.col("text")
    return found.groupBy("draft_id").agg(F.count(F.lit(1)).alias("sentences"), F.count_if(~there).alias("misplaced"))


SENTENCES = (
    "concat('Smith et al. (20', 10 + s_nationkey, ') and (Doe, 2019; Lee, 2020b) report [', s_suppkey, ', 3-5] that method ', s_suppkey, ' improves recall by ', s_nationkey, '.5%.')",
    "concat('Previous studies show that ', s_name, ' has higher accuracy than all of the others (see Section ', s_nationkey, ').')",
    "concat('In this paper we propose a model for ', s_name, ' and we evaluate it on data (Kim and Park, 2021).')",
    "concat('Table ', s_suppkey, ' presents the results of all of the methods we have compared here.')",
    "concat('Is it known that ', s_name, ' leads to a better result than the old one?')",
    "concat('Jones (2018) and Brown and Green (2020a) found p < 0.05 with n = ', s_suppkey, ' in several studies according to the literature.')",
    "concat('The ', s_name, ' is blue and the sky is wide and the sea is deep and calm.')",
    "concat('Short one ', s_suppkey)",
)


def _sentence(k: str = "s_suppkey") -> str:
    cases = " ".join(f"when {i} then {x}" for i, x in enumerate(SENTENCES))
    return f"case {k} % {len(SENTENCES)} {cases} end"


def _sentences(spark, sf_dir):
    section = F.expr("case s_nationkey % 5 when 0 then ' References' when 1 then 'Methods' end")
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.expr(_sentence()).alias("text"), section.alias("section"))


def find_citations(spark, sf_dir):
    found = claims.citations(F.col("text"))
    return _sentences(spark, sf_dir).select("s_suppkey", F.array_join(found, "|").alias("citations"), F.size(found).cast("long").alias("n"))


def _filtered(spark, sf_dir):
    rows = _sentences(spark, sf_dir)
    return rows.select("s_suppkey", "text", *[c.alias(k) for k, c in claims.prefilter(F.col("text"), F.col("section")).items()])


def prefilter_signals(spark, sf_dir):
    return _filtered(spark, sf_dir).select("s_suppkey", "verdict", "score", "signals")


def mock_classify(spark, sf_dir):
    return _filtered(spark, sf_dir).select("s_suppkey", *[c.alias(k) for k, c in claims.rule_decision(F.col("verdict"), F.col("score"), F.col("signals")).items()])


def claims_of_documents(spark, sf_dir):
    """The prefilter over every line of the documents."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("text"))
    return lines.select("doc_id", *[c.alias(k) for k, c in claims.prefilter(F.col("text"), F.lit(None).cast("string")).items()]).groupBy("doc_id", "verdict").agg(F.count(F.lit(1)).alias("n"))


def resolved_claims(spark, sf_dir):
    """Kept sentences: a cached answer for every third one, else the rules; those without need or citation go."""
    rows = _filtered(spark, sf_dir)
    known = F.col("s_suppkey") % 3 == 0
    answer = claims.resolved(F.when(known, F.col("s_suppkey") % 2 == 0), F.when(known, F.lit("EMPIRICAL_RESULT")), F.when(known, F.lit(" ")), F.col("verdict"), F.col("text"))
    out = rows.select("s_suppkey", F.size(claims.citations(F.col("text"))).alias("c"), *[c.alias(k) for k, c in answer.items()], sentence_hash(F.col("text")).alias("claim_hash"))
    return out.where("needs_citation or c > 0").drop("c")


def gated_claims(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("draft_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("char_start"), (F.col("l_returnflag") != "A").alias("needs_citation"), F.when(F.col("l_linenumber") % 5 != 0, F.col("l_discount")).alias("confidence"))
    return drafts.gated(rows).select("draft_id", "char_start", "gate_rank")


TEXTS = "concat(p_name, ' on ', case p_partkey % 6 when 0 then 'vaccination and public HEALTH of marine life under coral reef bleaching' when 1 then 'fertilizer and fertiliser for food security' when 2 then 'innovation' when 3 then 'an innovation in industrial technology and solar energy with efficiency' when 4 then 'urban climate and city planning' else 'nothing' end)"


def _texts(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("text_id"), F.expr(TEXTS).alias("text"))


def sdg_match(spark, sf_dir):
    return sdg.matched_goals(_texts(spark, sf_dir)).select("text_id", "goal", "goal_name", F.col("hits").cast("long").alias("hits"), F.array_join("phrases", "|").alias("phrases"), "goal_rank")


def sdg_pick(spark, sf_dir):
    return sdg.pick(sdg.matched_goals(_texts(spark, sf_dir)))


def learned_abbreviations(spark, sf_dir):
    """Words of the documents whose period ends no sentence, by their counts."""
    scores = sentence_ends.abbreviation_scores(sentence_ends._tokens(read(spark, sf_dir, "documents")))
    return scores.where(F.col("score") >= sentence_ends.LEAST_ABBREVIATION)


def learned_sentences(spark, sf_dir):
    """Sentences of every draft, cut by the model of all of them: how many stand in the draft's text where their offsets don't say."""
    blocks = computed_once(drafts.assembled(_raw(spark, sf_dir)))
    found = sentence_ends.learned_sentences(blocks, sentence_ends.learned(blocks))
    placed = found.join(blocks.select("draft_id", "paragraph_index", F.col("text").alias("block"), F.col("char_start").alias("from")), ["draft_id", "paragraph_index"])
    there = F.substr("block", (F.col("char_start") - F.col("from") + 1).cast("int"), (F.col("char_end") - F.col("char_start")).cast("int")) == F.col("text")
    return placed.groupBy("draft_id").agg(F.count(F.lit(1)).alias("sentences"), F.count_if(~there).alias("misplaced"))


#: Documents with white space of all kinds.
RAW = "concat(' ', chr(13), chr(10), chr(9), replace(replace(replace(text, '. ', concat('.', chr(9), ' ', chr(13), ' ')), ', ', concat(',', chr(160), chr(160))), chr(10), concat(chr(13), chr(10))), ' ', chr(13), chr(10))"


def offset_map(spark, sf_dir):
    """Where the characters of each normalised document came from, and the source of its middle third."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.expr(RAW).alias("raw"))
    mapped = docs.select("doc_id", "raw", normalized_with_map("raw").alias("m")).select("doc_id", "raw", "m.normalized", "m.runs")
    n = F.char_length("normalized")
    mapped = mapped.withColumn("span", source_span(F.col("runs"), F.floor(n / 3).cast("int"), F.floor(2 * n / 3).cast("int")))
    long_ = lambda r: [r[c].cast("long") for c in ("start", "source", "length")]

    def total(r):
        start, source, size = long_(r)
        return size * source + F.shiftright(size * (size - 1), 1)

    def weighted(r):
        start, source, size = long_(r)
        return size * start * source + (start + source) * F.shiftright(size * (size - 1), 1) + F.floor((size - 1) * size * (2 * size - 1) / 6)

    added = lambda f: F.aggregate("runs", F.lit(0).cast("long"), lambda acc, r: acc + f(r).cast("long"))
    return mapped.select(
        "doc_id", n.cast("long").alias("n_chars"), F.size("runs").cast("long").alias("n_runs"), added(total).alias("source_sum"), added(weighted).alias("weighted_sum"),
        F.col("span.start").cast("long").alias("span_start"), F.col("span.end").cast("long").alias("span_end"),
        F.sha2("normalized", 256).alias("normalized_hash"), F.sha2(F.substr("raw", F.col("span.start") + 1, F.col("span.end") - F.col("span.start")), 256).alias("span_hash"),
    )


#: Phrases of all kinds that the items' words make, as goals; the same expressions in both dialects.
WORDS = "regexp_extract_all(lower(text), '[a-z]{{3,}}'{group})"
PHRASE = "case i % 4 when 0 then concat(a, ' ', b) when 1 then concat(a, ' and ', c) when 2 then concat(a, '*', b) else concat(substr(a, 1, 2), '?', substr(a, 4), ' ', b) end"
PATTERN = "case i % 4 when 2 then concat(a, '.*', b) else concat(substr(a, 1, 2), '.', substr(a, 4), ' ', b) end"


def sdg_match_list(spark, sf_dir):
    """Goals of all documents by a JSON list of phrases that has thousands: every second word of the items starts one."""
    words = read(spark, sf_dir, "benchmark").select("item_id", F.expr(WORDS.format(group=", 0")).alias("w"))
    each = words.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - 4, F.lit(1)), F.lit(2))).alias("i")).where("i + 3 <= size(w)")
    phrases = each.selectExpr("item_id", "i div 2 as i", "w[i - 1] as a", "w[i] as b", "w[i + 2] as c").selectExpr("cast(item_id % 17 + 1 as int) as number", f"{PHRASE} as phrase").distinct()
    goals = phrases.groupBy("number").agg(F.sort_array(F.collect_list("phrase")).alias("keywords")).select("number", F.concat(F.lit("Goal "), "number").alias("name"), "keywords")
    path = f"{ensure_shared_dir(spark)}/goals-{uuid.uuid4().hex}"
    listed = goals.agg(F.to_json(F.sort_array(F.collect_list(F.struct("number", "name", "keywords")))).alias("value"))
    listed.coalesce(1).write.text(path)
    texts = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    found = sdg.matched_goals(texts, goals=sdg.goals_from_json(spark, path))
    return found.select("text_id", "goal", F.col("hits").cast("long").alias("hits"), F.sha2(F.array_join("phrases", "|"), 256).alias("phrases_hash"), "goal_rank")


_ALL = (block_offsets, section_titles, local_context, sentence_offsets, find_citations, prefilter_signals, mock_classify, claims_of_documents, resolved_claims, gated_claims, sdg_match, sdg_pick, sdg_match_list, offset_map, learned_abbreviations, learned_sentences)
QUERIES = {f.__name__: f for f in _ALL}

_NORM = "trim(regexp_replace(replace(replace(t, chr(160), ' '), chr(13), ''), '[ \\t]+', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12))"
_BLOCKS = f"""raw AS (SELECT doc_id AS draft_id, unnest(ls) AS t, generate_subscripts(ls, 1) - 1 AS paragraph_index FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
blocks AS (SELECT * FROM (SELECT draft_id, CAST(paragraph_index AS INTEGER) AS paragraph_index, {_NORM} AS text, paragraph_index % 3 = 0 AS is_heading FROM raw) WHERE text <> '')"""


def _flag(p: str) -> str:
    return f"regexp_matches(text, '{p}')"


_S = f"""s AS (SELECT s_suppkey, {_sentence()} AS text, CASE s_nationkey % 5 WHEN 0 THEN ' References' WHEN 1 THEN 'Methods' END AS section FROM supplier)"""
_SEEN = "concat_ws(',', " + ", ".join(f"CASE WHEN {_flag(p)} THEN '{n}' END" for n, (_, p) in claims.SIGNALS.items()) + f", CASE WHEN {_flag(claims.OWN_WORK)} THEN 'author_contribution' END)"
_SUM = " + ".join(f"CASE WHEN {_flag(p)} THEN {w} ELSE 0 END" for w, p in claims.SIGNALS.values())


def _filter_sql(source: str, keys: str) -> str:
    return f"""e AS (SELECT {keys}, text, CASE WHEN lower(trim(section)) IN ('references', 'acknowledgments', 'acknowledgements', 'bibliography') THEN 'non_claim_section'
  WHEN len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) < 8 THEN 'too_short' WHEN rtrim(text) LIKE '%?' THEN 'question' WHEN regexp_matches(trim(text), '{claims.STRUCTURAL}') THEN 'structural_reference' END AS x FROM {source}),
f AS (SELECT {keys}, text, CASE WHEN x IS NOT NULL OR {_flag(claims.OWN_WORK)} THEN 0.0 ELSE least(1.0, floor(({_SUM}) * 100.0 + 0.5) / 100.0) END AS score, coalesce(x, {_SEEN}) AS signals, x IS NOT NULL OR {_flag(claims.OWN_WORK)} AS skip FROM e),
p AS (SELECT *, CASE WHEN skip THEN 'SKIP' WHEN score >= 0.6 THEN 'STRONG' ELSE 'SEND_TO_LLM' END AS verdict FROM f)"""


_FILTER = f"{_S}, {_filter_sql('s', 's_suppkey')}"


def _extract(x: str, pattern: str) -> str:
    return "regexp_extract_all(" + x + ", '" + pattern.replace("'", "''") + "')"


_MASKED = "regexp_replace(t, '" + claims.NARRATIVE_MANY.replace("'", "''") + "', ' ', 'g')"
_CITED = f"list_concat({_extract('t', claims.BRACKET)}, {_extract('t', claims.PARENTHESIS)}, {_extract('t', claims.NARRATIVE_MANY)}, {_extract(_MASKED, claims.NARRATIVE_ONE)})"
_CROSS = "regexp_replace(text, '" + claims.CROSS_REFERENCE + "', '(', 'g')"


def _phrase(phrase: str) -> str:
    written = lambda p: p.replace("*", ".*").replace("?", ".")
    return "(" + " AND ".join(f"regexp_matches(text, '(?i){written(p)}')" for p in phrase.split(" and ")) + ")"


_GOALS = " UNION ALL ".join(f"SELECT text_id, {g} AS goal, '{name}' AS goal_name, '{p}' AS phrase FROM t WHERE {_phrase(p)}" for g, name, phrases in sdg.GOALS for p in phrases)
_MATCHED = f"""t AS (SELECT p_partkey AS text_id, {TEXTS} AS text FROM part), h AS ({_GOALS}),
g AS (SELECT text_id, CAST(goal AS INTEGER) AS goal, goal_name, count(*) AS hits, list(phrase ORDER BY length(phrase) DESC, phrase) AS ps FROM h GROUP BY ALL),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY hits DESC, goal) AS goal_rank FROM g) WHERE goal_rank <= 3)"""
_GENERIC = "('" + "', '".join(sdg.GENERIC) + "')"

SQL = {
    "block_offsets": f"""WITH {_BLOCKS}, o AS (SELECT *, coalesce(sum(length(text) + 2) OVER (PARTITION BY draft_id ORDER BY paragraph_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM blocks)
SELECT draft_id, paragraph_index, CAST(a AS BIGINT) AS char_start, CAST(a + length(text) AS BIGINT) AS char_end, sha256(text) AS text_hash FROM o""",
    "section_titles": f"WITH {_BLOCKS} SELECT draft_id, paragraph_index, sha256(last_value(CASE WHEN is_heading THEN text END IGNORE NULLS) OVER (PARTITION BY draft_id ORDER BY paragraph_index ROWS UNBOUNDED PRECEDING)) AS section_hash FROM blocks",
    "local_context": "SELECT conv_id AS draft_id, turn AS paragraph_index, sha256(concat_ws(' ', lag(text) OVER w, text, lead(text) OVER w)) AS context_hash FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "find_citations": f"WITH {_S}, c AS (SELECT s_suppkey, {_CITED} AS c FROM (SELECT s_suppkey, {_CROSS} AS t FROM s)) SELECT s_suppkey, array_to_string(c, '|') AS citations, len(c) AS n FROM c",
    "prefilter_signals": f"WITH {_FILTER} SELECT s_suppkey, verdict, score, signals FROM p",
    "mock_classify": f"""WITH {_FILTER}, n AS (SELECT *, verdict <> 'SKIP' AND score >= 0.20 AS needs, string_split(signals, ',') AS l FROM p)
SELECT s_suppkey, needs AS needs_citation, CASE WHEN NOT needs THEN 'NO_CITATION_NEEDED' WHEN list_contains(l, 'statistic') THEN 'STATISTICAL_CLAIM' WHEN list_contains(l, 'comparative') THEN 'COMPARATIVE_CLAIM'
  WHEN list_contains(l, 'consensus_phrase') THEN 'PREVIOUS_RESEARCH' WHEN list_contains(l, 'effect_verb') THEN 'CAUSAL_CLAIM' ELSE 'EMPIRICAL_RESULT' END AS claim_type, floor(least(0.95, 0.5 + score / 2) * 100.0 + 0.5) / 100.0 AS confidence FROM n""",
    "claims_of_documents": f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, CAST(NULL AS VARCHAR) AS section FROM documents), {_filter_sql('l', 'doc_id')} SELECT doc_id, verdict, count(*) AS n FROM p GROUP BY ALL",
    "resolved_claims": f"""WITH {_FILTER}, q AS (SELECT *, {_CROSS} AS t, s_suppkey % 3 = 0 AS known FROM p),
r AS (SELECT s_suppkey, CASE WHEN known THEN s_suppkey % 2 = 0 ELSE verdict = 'STRONG' END AS needs_citation, CASE WHEN known THEN 'EMPIRICAL_RESULT' WHEN verdict = 'STRONG' THEN 'GENERAL_BACKGROUND' ELSE 'NO_CITATION_NEEDED' END AS claim_type,
  text AS claim_text, CASE WHEN known THEN 'LLM' ELSE 'RULE' END AS detection_method, sha256(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g')) AS claim_hash, len({_CITED}) AS c FROM q)
SELECT * EXCLUDE (c) FROM r WHERE needs_citation OR c > 0""",
    "gated_claims": "SELECT * FROM (SELECT l_suppkey AS draft_id, l_orderkey * 10 + l_linenumber AS char_start, row_number() OVER (PARTITION BY l_suppkey ORDER BY CASE WHEN l_linenumber % 5 <> 0 THEN l_discount ELSE 0 END DESC, l_orderkey * 10 + l_linenumber) AS gate_rank FROM lineitem WHERE l_returnflag <> 'A') WHERE gate_rank <= 40",
    "learned_abbreviations": """WITH t AS (SELECT unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda t: t <> '')) AS raw FROM documents),
b AS (SELECT regexp_replace(regexp_replace(raw, '^["''“‘(\\[]+', ''), '[)\\]"''”’,;:]+$', '') AS w FROM t),
c AS (SELECT lower(regexp_replace(w, '[.!?]+$', '')) AS word, regexp_matches(w, '[^.]\\.$') AS dot FROM b),
n AS (SELECT word, count(*) AS n, count(*) FILTER (dot) AS dots FROM c WHERE word <> '' GROUP BY 1),
s AS (SELECT sum(dots) / sum(n) AS p FROM n),
l AS (SELECT word, n - dots AS without, dots, length(word) - length(replace(word, '.', '')) + 1 AS periods, least(p, 0.999) AS p FROM n, s WHERE dots > 0 AND regexp_matches(word, '\\p{L}') AND NOT regexp_matches(word, '[^\\p{L}\\p{N}.]')),
k AS (SELECT *, length(word) - periods + 1 AS letters, dots * (ln(0.99) - ln(p)) + CASE WHEN without > 0 THEN without * (ln(1 - 0.99) - ln(1 - p)) ELSE 0 END AS d FROM l)
SELECT * FROM (SELECT word, floor(2 * d * exp(-letters) * periods * pow(letters, -without) * 1000000.0 + 0.5) / 1000000.0 AS score FROM k) WHERE score >= 0.3""",
    "offset_map": f"""WITH r AS (SELECT doc_id, raw, regexp_extract_all(raw, '(?s).') AS l FROM (SELECT doc_id, {RAW} AS raw FROM documents)),
c AS (SELECT doc_id, unnest(l) AS c, generate_subscripts(l, 1) - 1 AS pos FROM r),
b AS (SELECT *, c IN (' ', chr(9), chr(160)) AS blank FROM c WHERE c <> chr(13)),
k AS (SELECT *, coalesce(lag(blank) OVER (PARTITION BY doc_id ORDER BY pos), false) AS after_blank FROM b),
o AS (SELECT doc_id, pos, CASE WHEN blank THEN ' ' ELSE c END AS c FROM k WHERE NOT (blank AND after_blank)),
e AS (SELECT doc_id, min(pos) AS first, max(pos) AS last FROM o WHERE c NOT IN (' ', chr(10), chr(9)) GROUP BY 1),
n AS (SELECT doc_id, pos, c, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS size FROM o JOIN e USING (doc_id) WHERE pos BETWEEN first AND last),
s AS (SELECT doc_id, count(*) AS n_chars, count(DISTINCT pos - i) AS n_runs, sum(pos) AS source_sum, sum(i * pos) AS weighted_sum, min(pos) FILTER (i = size // 3 AND 2 * size // 3 > size // 3) AS span_start,
  max(pos) FILTER (i = 2 * size // 3 - 1 AND 2 * size // 3 > size // 3) + 1 AS span_end, string_agg(c, '' ORDER BY i) AS normalized FROM n GROUP BY 1)
SELECT doc_id, coalesce(n_chars, 0) AS n_chars, coalesce(n_runs, 0) AS n_runs, CAST(coalesce(source_sum, 0) AS BIGINT) AS source_sum, CAST(coalesce(weighted_sum, 0) AS BIGINT) AS weighted_sum, span_start, span_end,
  sha256(coalesce(normalized, '')) AS normalized_hash, sha256(array_to_string(l[span_start + 1:span_end], '')) AS span_hash FROM r LEFT JOIN s USING (doc_id)""",
    "sdg_match_list": f"""WITH w AS (SELECT item_id, {WORDS.format(group="")} AS w FROM benchmark),
e AS (SELECT item_id, i // 2 AS i, w[i] AS a, w[i + 1] AS b, w[i + 3] AS c FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1, 2)) AS i FROM w) WHERE i + 3 <= len(w)),
p AS (SELECT CAST(item_id % 17 + 1 AS INTEGER) AS goal, {PHRASE} AS phrase, any_value(i % 4) AS kind, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, any_value({PATTERN}) AS pattern FROM e GROUP BY 1, 2),
d AS (SELECT doc_id AS text_id, lower(text) AS text FROM documents),
h AS (SELECT text_id, goal, phrase FROM d, p WHERE CASE kind WHEN 0 THEN contains(text, phrase) WHEN 1 THEN contains(text, a) AND contains(text, c) ELSE contains(text, substr(a, 1, 2)) AND contains(text, b) AND regexp_matches(text, pattern) END),
g AS (SELECT text_id, goal, count(*) AS hits, list(phrase ORDER BY length(phrase) DESC, phrase) AS ps FROM h GROUP BY 1, 2)
SELECT * FROM (SELECT text_id, goal, hits, sha256(array_to_string(ps[1:10], '|')) AS phrases_hash, row_number() OVER (PARTITION BY text_id ORDER BY hits DESC, goal) AS goal_rank FROM g) WHERE goal_rank <= 3""",
    "sdg_match": f"WITH {_MATCHED} SELECT text_id, goal, goal_name, hits, array_to_string(ps[1:10], '|') AS phrases, goal_rank FROM m",
    "sdg_pick": f"""WITH {_MATCHED}, k AS (SELECT text_id, goal, ps[1] AS first, list_filter(ps[1:10], lambda p: p NOT IN {_GENERIC})[1] AS other FROM m WHERE goal_rank = 1)
SELECT text_id, goal, CASE WHEN first IN {_GENERIC} AND other IS NULL THEN NULL ELSE first END AS keyword, first IN {_GENERIC} AND other IS NULL AS declined FROM k""",
}
