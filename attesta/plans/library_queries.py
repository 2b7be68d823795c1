"""Queries of the library: identifiers, import, duplicates, enrichment, caches, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identifiers as ids
from ..functions.text import clean_value, content_text, first_int, normalized_title, sentence_hash, split_authors, split_keywords
from ..operators import importing, lookup
from ..operators.staging import computed_once
from .retrieval_queries import read

# Strings of the shapes that links, cells and names have, built alike on either side.
LINKS = {
    "doi": "concat('https://doi.org/10.1016/J.X.', o_orderkey, ').')",
    "scopus": "concat('https://www.scopus.com/record?eid=2-S2.0-', o_orderkey, '&scp=', o_custkey)",
    "s2": "concat('https://www.semanticscholar.org/paper/T/', sha1(cast(o_orderkey as {string})))",
    "coded": "concat('http://publisher.org/x?doi=10.1234%2Fabc+d', o_orderkey, '%')",
    "bare": "concat('10.5555/k', o_orderkey, ';')",
    "web": "concat('https://example.org/', o_orderkey)",
    "none": "concat('see ', o_orderkey)",
}


def _links(string: str) -> str:
    cases = " ".join(f"when {i} then {x.format(string=string)}" for i, x in enumerate(LINKS.values()))
    return f"case o_orderkey % {len(LINKS)} {cases} end"


def extract_identifiers(spark, sf_dir):
    found = read(spark, sf_dir, "orders").select("o_orderkey", F.expr(_links("string")).alias("link"))
    cols = ids.identifiers(F.col("link"))
    return found.select("o_orderkey", *[c.alias(k) for k, c in cols.items()], ids.has_any(cols).alias("has_any"))


def page_links(spark, sf_dir):
    cols = ids.identifiers(F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", cols["link_kind"].alias("link_kind"), ids.has_any(cols).alias("has_any"))


_CELL = "case p_size % 7 when 0 then ' N/A ' when 1 then '-' when 2 then concat('No. ', p_partkey) when 3 then concat('x', p_size, ',', p_partkey) when 4 then 'nan' when 5 then concat(' ', p_name, ' ') else concat(p_partkey, '12345') end"


def clean_cells(spark, sf_dir):
    cells = read(spark, sf_dir, "part").select("p_partkey", F.expr(_CELL).alias("cell"))
    return cells.select("p_partkey", clean_value(F.col("cell")).alias("cleaned"), first_int(F.col("cell")).alias("number"))


_KEYWORDS = "concat(p_brand, '; ', p_type, ' | ;', p_name)"


def split_lists(spark, sf_dir):
    k = split_keywords(F.expr(_KEYWORDS))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(k, "/").alias("keywords"), F.size(k).cast("long").alias("n"))


_AUTHORS = "case c_custkey % 4 when 0 then concat('Smith, J.; Doe', c_custkey, ', A.') when 1 then concat('Smith, John, Lee', c_custkey, ', K.') when 2 then concat(c_name, ';', c_mktsegment) else '-' end"


def split_author_cells(spark, sf_dir):
    a = split_authors(F.expr(_AUTHORS))
    return read(spark, sf_dir, "customer").select("c_custkey", F.array_join(a, "/").alias("authors"))


def normalized_titles(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(normalized_title(F.col("text")), 256).alias("title_hash"))


def content_hash(spark, sf_dir):
    text = content_text(F.element_at(F.split("text", "\n"), 1), F.col("text"), F.array("lang", "source"), F.array().cast("array<string>"))
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(text, 256).alias("content_hash"), sentence_hash(F.element_at(F.split("text", "\n"), 1)).alias("claim_hash"))


def stale_rows(spark, sf_dir):
    """Papers whose text is not the one that was embedded, or that were never embedded."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("now"))
    held = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")).join(docs, "doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left_semi").select("doc_id", F.col("now").alias("held"))
    return docs.join(held, "doc_id", "left").where("held is null or held <> now").select("doc_id")


def _import_rows(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_no"),
        F.expr("case when o_orderkey % 3 = 0 then concat('10.1/', o_custkey) end").alias("doi"),
        F.expr("case when o_orderkey % 3 = 1 then concat('2-s2.0-', o_custkey) end").alias("eid"),
        F.expr("concat(o_orderpriority, ' ', o_custkey % 500)").alias("title"),
    )
    return rows.withColumn("has_id", F.col("doi").isNotNull() | F.col("eid").isNotNull())


def dedupe_import(spark, sf_dir):
    return importing.mark_duplicates(_import_rows(spark, sf_dir)).select("row_no", "duplicate")


def dedupe_import_chains(spark, sf_dir):
    """As dedupe_import, with rows that have two identifiers: an earlier duplicate's second one does not count."""
    rows = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_no"),
        F.expr("case when o_orderkey % 4 < 2 then concat('10.1/', o_custkey) end").alias("doi"),
        F.expr("case when o_orderkey % 4 in (1, 2) then concat('2-s2.0-', o_custkey) end").alias("eid"),
        F.expr("concat('t', o_orderkey)").alias("title"),
        (F.col("o_orderkey") % 4 < 3).alias("has_id"),
    )
    return importing.mark_duplicates(rows).select("row_no", "duplicate")


def import_summary(spark, sf_dir):
    rows = importing.mark_duplicates(_import_rows(spark, sf_dir)).withColumn("valid", F.col("row_no") % 11 != 0)
    return importing.import_summary(rows)


def import_report(spark, sf_dir):
    """Documents imported again, by DOI or by title, into a library of every second one, some without an abstract."""
    docs = read(spark, sf_dir, "documents")
    n, doi = F.col("doc_id"), F.concat(F.lit("10.1/"), F.col("doc_id") % 400)
    library = docs.where("doc_id % 2 = 0").select(n.alias("ref_id"), F.concat(F.lit("10.1/"), "doc_id").alias("doi"), F.when(n % 3 > 0, F.col("text")).alias("abstract"))
    rows = docs.select(n.alias("row_no"), F.when(n % 5 > 0, doi).alias("doi"), F.col("text").alias("abstract"), F.lit(None).cast("string").alias("eid"), F.concat(F.lit("t"), "doc_id").alias("title"), (n % 5 > 0).alias("has_id"), (n % 11 > 0).alias("valid"))
    held = library.select((-F.col("ref_id") - 1).alias("row_no"), "doi", F.lit(None).cast("string").alias("eid"), F.lit(None).cast("string").alias("title"), F.lit(True).alias("has_id"))
    marked = importing.mark_duplicates(held.unionByName(rows.where("valid").select(*held.columns)))
    whole = rows.join(marked.select("row_no", "duplicate"), "row_no", "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(False)))
    out = importing.import_report(importing.with_backfills(computed_once(whole), library))
    return out.withColumn("warnings", F.array_join("warnings", "|"))


def provider_lookup(spark, sf_dir):
    """Documents as papers at a provider whose full view is refused after a while, and whose default view has few abstracts."""
    n = F.col("doc_id")
    papers = read(spark, sf_dir, "documents").select(n.alias("position"), F.when(n % 3 > 0, F.concat(F.lit("e"), "doc_id")).alias("eid"), F.when(n % 7 > 0, F.concat(F.lit("d"), "doc_id")).alias("doi"))
    docs = read(spark, sf_dir, "documents")

    def told(view, kind, status, abstract):
        note = F.when((n % 50 == 49) & F.lit(view == "full"), "AUTHORIZATION_ERROR")
        return docs.select(F.lit(view).alias("view"), F.lit(kind).alias("kind"), F.concat(F.lit(kind[0]), "doc_id").alias("id"), status.alias("status"), note.alias("note"), abstract.alias("abstract"), F.concat(F.lit(f"{view} {kind} "), "doc_id").alias("title"))

    bare = F.when(n % 40 != 7, F.col("lang"))
    answers = told("full", "eid", F.when(n % 50 == 49, 403).when(n % 5 == 0, 404).otherwise(200), F.col("source"))
    answers = answers.unionByName(told("full", "doi", F.when(n % 2 == 0, 200).otherwise(404), F.col("source")))
    answers = answers.unionByName(told("default", "eid", F.when(n % 4 > 0, 200).otherwise(500), bare)).unionByName(told("default", "doi", F.lit(200), bare))
    found = lookup.looked_up_in_order(papers, answers, ["eid", "doi"])
    return found.select("position", "asked_view", "answer.abstract", "answer.title")


def provider_batches(spark, sf_dir):
    """DOIs in requests of 50, some of which fail or are blocked for long."""
    n = F.col("doc_id")
    papers = read(spark, sf_dir, "documents").select(F.when(n % 9 > 0, F.concat(F.lit("10.1/"), n % 700)).alias("doi"))
    wait = F.when(n % 331 == 250, 500.0).when(n % 83 == 11, 60.0)
    answers = read(spark, sf_dir, "documents").where("doc_id < 700 and doc_id % 2 = 0").select(F.concat(F.lit("10.1/"), "doc_id").alias("doi"), wait.alias("retry_after"), (n % 59 == 3).alias("failed"), F.concat(F.lit("t"), "doc_id").alias("title"))
    return lookup.prefetched(papers, answers).select("doi", F.col("grouped").alias("request"), "answer.title")


def abstract_backfill(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    library = docs.select(F.col("doc_id").alias("ref_id"), F.concat(F.lit("10.1/"), "doc_id").alias("doi"), F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("abstract"), F.lit("PENDING").alias("status"))
    incoming = docs.select(F.col("doc_id").alias("row_no"), F.concat(F.lit("10.1/"), F.col("doc_id") % 300).alias("doi"), F.col("text").alias("abstract"))
    return importing.backfilled(library, incoming).select("ref_id", F.sha2("abstract", 256).alias("abstract_hash"), "status", "provider", "stale")


def library_dedupe(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("e")), "doc_id", "left")
    library = docs.select(F.col("doc_id").alias("ref_id"), F.coalesce("e", F.lit(False)).alias("embedded"), (F.length("text") >= 200).alias("has_abstract"), (F.col("doc_id") % 97).alias("created_at"), "text")
    return importing.library_winners(library, F.sha2("text", 256))


#: Which papers a provider knows, and of which it has an abstract.
KNOWN = {2: ("lang = 'en'", "n_chars > 2000"), 3: ("lang in ('en', 'fr', 'de')", "n_chars > 1500"), 5: ("source < 'src5'", "false")}


def enrichment_chain(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    own = docs.select(F.col("doc_id").alias("ref_id"), F.lit(None).cast("string").alias("abstract"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("source_title"), F.lit(None).cast("int").alias("year"), F.lit(None).cast("long").alias("citation_count"), F.lit(None).cast("string").alias("doi"))

    def provider(k: int):
        known, with_abstract = KNOWN[k]
        return docs.where(known).select(
            F.col("doc_id").alias("ref_id"),
            F.when(F.expr(with_abstract), F.concat(F.lit(f"p{k}:"), "lang")).alias("abstract"),
            F.lit(f"s{k}").alias("source_title"), F.lit(2000 + k).cast("int").alias("year"), F.col("n_chars").alias("citation_count"), F.concat(F.lit("10.1/"), "doc_id").alias("doi"),
        )

    failing = provider(3).withColumn("failed", F.col("ref_id") % 13 == 1)
    return importing.enriched(own, [("SCOPUS", provider(2)), ("OPENALEX", failing), ("CROSSREF", provider(5))], ("CROSSREF",))


def _cache(spark, sf_dir):
    """Answers for the texts of the labelled documents."""
    return read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left_semi").select(F.sha2("text", 256).alias("sentence_hash"), "doc_id").groupBy("sentence_hash").agg(F.min("doc_id").alias("answer"))


def cache_probe(spark, sf_dir):
    asked = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sentence_hash"))
    return asked.join(_cache(spark, sf_dir), "sentence_hash", "left").select("doc_id", F.col("answer").isNotNull().alias("hit"), "answer")


def insert_ignore(spark, sf_dir):
    new = read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sentence_hash"), "doc_id").groupBy("sentence_hash").agg((-F.min("doc_id")).alias("answer"))
    return importing.upsert_ignore(_cache(spark, sf_dir), new, ["sentence_hash"])


def mock_provider(spark, sf_dir):
    """A made-up provider answer from the hash of an identifier."""
    h = F.sha2(F.concat(F.lit("10.1016/"), "p_partkey"), 256)
    part = lambda at: F.conv(F.substring(h, at, 2), 16, 10).cast("int")
    words = F.filter(F.split("p_name", " "), lambda w: F.length(w) > 5)
    return read(spark, sf_dir, "part").select("p_partkey", (2015 + part(1) % 10).alias("year"), part(3).alias("citations"), F.array_join(F.slice(words, 1, 4), ";").alias("keywords"))


def inverted_abstract(spark, sf_dir):
    words = read(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("ref_id"), F.posexplode(F.filter(F.split("text", r"[ \n]+"), lambda w: w != "")).alias("at", "word"))
    positions = words.groupBy("ref_id", "word").agg(F.array_sort(F.collect_list("at")).alias("at")).groupBy("ref_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "at"))).alias("positions"))
    return importing.inverted_abstract(positions).select("ref_id", F.sha2("abstract", 256).alias("abstract_hash"))


def status_counts(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") > 200000).alias("embedded"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("missing_abstract"), F.countDistinct("o_custkey").alias("customers")
    )


def missing_by_year(spark, sf_dir):
    missing = F.sum(F.when(F.col("o_totalprice") < 60000, 1).otherwise(0))
    return read(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(missing.alias("missing"), F.count(F.lit(1)).alias("total")).where("missing > 0")


def latest_runs(spark, sf_dir):
    """The last run of each draft."""
    runs = read(spark, sf_dir, "events").select(F.col("user_id").alias("draft_id"), F.col("ts"), "event_id", F.col("event_type").alias("status"))
    last = runs.groupBy("draft_id").agg(F.max(F.struct("ts", "event_id", "status")).alias("last"), F.count(F.lit(1)).alias("runs"))
    return last.select("draft_id", F.col("last.event_id").alias("run_id"), F.col("last.status").alias("status"), "runs")


def paginate(spark, sf_dir):
    return read(spark, sf_dir, "orders").where("o_orderstatus = 'O'").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(100).limit(50).select("o_orderkey", "o_custkey")


def in_flight(spark, sf_dir):
    """Customers with an open order of the highest priority, and those without any."""
    orders = read(spark, sf_dir, "orders").where("o_orderstatus = 'O' and o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    busy = customers.join(orders, "c_custkey", "left_semi").withColumn("in_flight", F.lit(True))
    return busy.unionByName(customers.join(orders, "c_custkey", "left_anti").withColumn("in_flight", F.lit(False)))


def provider_json(spark, sf_dir):
    """Tolerant reading of provider answers: objects or lists, wrapped values, two places for an abstract."""
    body = F.concat(
        F.lit('{"coredata":{"dc:title":"T'), F.col("l_orderkey"), F.lit('","prism:coverDate":"'), F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit('","citedby-count":"'), F.col("l_linenumber"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit('","dc:description":"D'), F.col("l_partkey"))).otherwise(F.lit("")),
        F.lit('"},"bib":{"para":'), F.when(F.col("l_linenumber") % 3 == 0, F.lit('["a","b"]')).otherwise(F.lit('"c"')), F.lit('},"keywords":[{"$":"k'), F.col("l_suppkey"), F.lit('"},{"$":"z"}]}'),
    )
    v = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.parse_json(body).alias("v"))
    get = lambda path, kind="string": F.try_variant_get("v", path, kind)
    return v.select(
        "l_orderkey", "l_linenumber", get("$.coredata['dc:title']").alias("title"), F.substring(get("$.coredata['prism:coverDate']"), 1, 4).try_cast("int").alias("year"), get("$.coredata['citedby-count']").try_cast("int").alias("citations"),
        F.coalesce(get("$.coredata['dc:description']"), F.array_join(get("$.bib.para", "array<string>"), " "), get("$.bib.para")).alias("abstract"),
        F.concat_ws(";", get("$.keywords[0]['$']"), get("$.keywords[1]['$']")).alias("keywords"),
    )


_ALL = (extract_identifiers, page_links, clean_cells, split_lists, split_author_cells, normalized_titles, content_hash, stale_rows, dedupe_import, dedupe_import_chains, import_summary, import_report, provider_lookup, provider_batches, abstract_backfill, library_dedupe, enrichment_chain, cache_probe, insert_ignore, mock_provider, inverted_abstract, status_counts, missing_by_year, latest_runs, paginate, in_flight, provider_json)
QUERIES = {f.__name__: f for f in _ALL}


def _unquoted(x: str) -> str:
    return f"coalesce(try(url_decode({x})), {x})"


def _ids(link: str, source: str, key: str, columns: str) -> str:
    return f"""WITH l AS (SELECT {key}, {link} AS link FROM {source}),
u AS (SELECT {key}, coalesce(try(url_decode(link)), link, '') AS t FROM l),
i AS (SELECT *, nullif(lower(regexp_replace(regexp_extract(t, '(?i)10\\.\\d{{4,9}}/[^\\s"''<>&]+'), '[.,;:)\\]}}>"'']+$', '')), '') AS doi, lower(nullif(regexp_extract(t, '(?i)2-s2\\.0-\\d+'), '')) AS scopus_eid,
  nullif(regexp_extract(t, '(?i)[?&]scp=(\\d+)', 1), '') AS scopus_id, lower(nullif(regexp_extract(t, '(?i)semanticscholar\\.org/paper/(?:[^/\\s]+/)?([0-9a-f]{{40}})', 1), '')) AS semantic_scholar_id FROM u)
SELECT {key}, {columns} CASE WHEN scopus_eid IS NOT NULL OR contains(lower(t), 'scopus.com') THEN 'SCOPUS' WHEN semantic_scholar_id IS NOT NULL THEN 'SEMANTIC_SCHOLAR' WHEN contains(lower(t), 'doi.org') THEN 'DOI'
  WHEN doi IS NOT NULL AND starts_with(t, 'http') THEN 'PUBLISHER' WHEN doi IS NOT NULL THEN 'DOI' WHEN starts_with(t, 'http') THEN 'PUBLISHER' ELSE 'UNKNOWN' END AS link_kind,
  coalesce(doi, scopus_eid, scopus_id, semantic_scholar_id) IS NOT NULL AS has_any FROM i"""


_CLEAN = "CASE WHEN lower(trim(cell)) IN ('', 'nan', 'none', 'n/a', '-') THEN NULL ELSE trim(cell) END"
_SPLIT = "list_filter(list_transform(regexp_split_to_array({x}, '{p}'), lambda s: trim(s)), lambda s: s <> '')"
_IMPORT = """r AS (SELECT o_orderkey AS row_no, CASE WHEN o_orderkey % 3 = 0 THEN '10.1/' || o_custkey END AS doi, CASE WHEN o_orderkey % 3 = 1 THEN '2-s2.0-' || o_custkey END AS eid,
  trim(regexp_replace(lower(concat(o_orderpriority, ' ', o_custkey % 500)), '[^a-z0-9]+', ' ', 'g')) AS title FROM orders),
f AS (SELECT *, CASE WHEN doi IS NOT NULL THEN row_number() OVER (PARTITION BY doi ORDER BY row_no) = 1 WHEN eid IS NOT NULL THEN row_number() OVER (PARTITION BY eid ORDER BY row_no) = 1 ELSE true END AS fresh FROM r),
d AS (SELECT row_no, NOT fresh OR (doi IS NULL AND eid IS NULL AND coalesce(bool_or(fresh) OVER (PARTITION BY title ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)) AS duplicate FROM f)"""
_CACHE = "cache AS (SELECT sha256(text) AS sentence_hash, min(doc_id) AS answer FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1)"


def _provider(k: int) -> str:
    known, with_abstract = KNOWN[k]
    return f"p{k} AS (SELECT doc_id AS ref_id, CASE WHEN {with_abstract} THEN 'p{k}:' || lang END AS abstract, n_chars FROM documents WHERE {known})"


SQL = {
    "extract_identifiers": _ids(_links("varchar"), "orders", "o_orderkey", "doi, scopus_eid, scopus_id, semantic_scholar_id,"),
    "page_links": _ids("url", "pages", "page_id", ""),
    "clean_cells": f"WITH c AS (SELECT p_partkey, {_CELL} AS cell FROM part), k AS (SELECT p_partkey, {_CLEAN} AS cleaned FROM c) SELECT p_partkey, cleaned, TRY_CAST(regexp_extract(cleaned, '\\d{{1,4}}') AS INTEGER) AS number FROM k",
    "split_lists": f"SELECT p_partkey, array_to_string(k, '/') AS keywords, len(k) AS n FROM (SELECT p_partkey, {_SPLIT.format(x=_KEYWORDS, p='[;|]')} AS k FROM part)",
    "split_author_cells": f"WITH c AS (SELECT c_custkey, {_AUTHORS} AS cell FROM customer), k AS (SELECT c_custkey, regexp_replace({_CLEAN}, ',\\s([A-Z][a-z])', ';\\1', 'g') AS cell FROM c) SELECT c_custkey, array_to_string({_SPLIT.format(x='cell', p=';')}, '/') AS authors FROM k",
    "normalized_titles": "SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS title_hash FROM documents",
    "content_hash": "SELECT doc_id, sha256(split_part(text, chr(10), 1) || ' [SEP] ' || text || ' Keywords: ' || lang || '; ' || source) AS content_hash, sha256(regexp_replace(lower(trim(split_part(text, chr(10), 1))), '\\s+', ' ', 'g')) AS claim_hash FROM documents",
    "stale_rows": "SELECT doc_id FROM documents WHERE NOT (doc_id IN (SELECT vec_id FROM embeddings) AND doc_id IN (SELECT doc_id FROM labels))",
    "dedupe_import": f"WITH {_IMPORT} SELECT row_no, duplicate FROM d",
    "dedupe_import_chains": """WITH RECURSIVE r AS (SELECT o_orderkey AS row_no, o_orderkey % 4 < 3 AS has_id, CASE WHEN o_orderkey % 4 < 2 THEN o_custkey END AS doi, CASE WHEN o_orderkey % 4 IN (1, 2) THEN o_custkey END AS eid FROM orders),
s AS (SELECT 0 AS round, row_no, doi, eid, 'open' AS state FROM r WHERE has_id
UNION ALL SELECT round + 1, row_no, doi, eid, CASE WHEN state <> 'open' THEN state WHEN doi IS NOT NULL AND doi_taken OR eid IS NOT NULL AND eid_taken THEN 'refused'
  WHEN (doi IS NULL OR row_no = doi_first) AND (eid IS NULL OR row_no = eid_first) THEN 'accepted' ELSE 'open' END
  FROM (SELECT *, bool_or(state = 'open') OVER () AS any_open, bool_or(state = 'accepted') OVER d AS doi_taken, min(CASE WHEN state = 'open' THEN row_no END) OVER d AS doi_first,
    bool_or(state = 'accepted') OVER e AS eid_taken, min(CASE WHEN state = 'open' THEN row_no END) OVER e AS eid_first FROM s WINDOW d AS (PARTITION BY doi), e AS (PARTITION BY eid)) WHERE any_open)
SELECT row_no, has_id AND row_no NOT IN (SELECT row_no FROM s WHERE state = 'accepted') AS duplicate FROM r""",
    "import_summary": f"WITH {_IMPORT} SELECT count(*) FILTER (WHERE row_no % 11 <> 0 AND NOT duplicate) AS imported, count(*) FILTER (WHERE row_no % 11 <> 0 AND duplicate) AS duplicates, count(*) FILTER (WHERE row_no % 11 = 0) AS invalid FROM d",
    "import_report": """WITH lib AS (SELECT doc_id AS ref_id, '10.1/' || doc_id AS doi, doc_id % 3 = 0 AS bare FROM documents WHERE doc_id % 2 = 0),
r AS (SELECT doc_id AS row_no, doc_id % 5 > 0 AS has_id, doc_id % 11 > 0 AS valid, CASE WHEN doc_id % 5 > 0 THEN '10.1/' || doc_id % 400 END AS doi, text FROM documents),
k AS (SELECT r.*, lib.ref_id, bare, valid AND has_id AND (lib.ref_id IS NOT NULL OR row_number() OVER (PARTITION BY valid, r.doi ORDER BY row_no) > 1) AS duplicate FROM r LEFT JOIN lib ON lib.doi = r.doi),
b AS (SELECT ref_id, min(row_no) AS row_no FROM k WHERE valid AND duplicate AND bare AND length(text) >= 200 GROUP BY 1),
w AS (SELECT row_no, row_number() OVER (ORDER BY row_no) AS i, count(*) OVER () AS n FROM k WHERE valid AND NOT duplicate AND NOT has_id)
SELECT count(*) FILTER (valid AND NOT duplicate) AS imported, count(*) FILTER (valid AND duplicate) - (SELECT count(*) FROM b) AS duplicates, count(*) FILTER (NOT valid) AS invalid, (SELECT count(*) FROM b) AS backfilled,
  coalesce((SELECT string_agg('Row ' || row_no || ': no DOI/EID found in LINK; enrichment will likely be incomplete', '|' ORDER BY i) || CASE WHEN max(n) > 10 THEN '|...and ' || max(n) - 10 || ' more rows without identifiers' ELSE '' END FROM w WHERE i <= 10), '') AS warnings FROM k""",
    "provider_lookup": """WITH p AS (SELECT doc_id AS n, lang, source, doc_id % 3 > 0 AS e, doc_id % 7 > 0 AS d FROM documents),
f AS (SELECT *, CASE WHEN e AND n % 50 = 49 THEN 'view' WHEN e AND n % 5 > 0 THEN 'eid' WHEN d AND n % 2 = 0 THEN 'doi' END AS in_full, CASE WHEN e AND n % 4 > 0 THEN 'eid' WHEN d THEN 'doi' END AS in_default FROM p),
s AS (SELECT coalesce(min(n), 9223372036854775807) AS switch FROM f WHERE in_full = 'view'),
t AS (SELECT coalesce(max(n) FILTER (i = 3), 9223372036854775807) AS last FROM (SELECT n, row_number() OVER (ORDER BY n) AS i FROM f, s WHERE n >= switch AND in_default IS NOT NULL AND n % 40 = 7))
SELECT n AS position, CASE WHEN n < switch THEN 'full' WHEN n <= last THEN 'default' END AS asked_view, CASE WHEN n < switch THEN CASE WHEN in_full IS NOT NULL THEN source END WHEN n <= last AND in_default IS NOT NULL AND n % 40 <> 7 THEN lang END AS abstract,
  CASE WHEN n < switch THEN 'full ' || in_full || ' ' || n WHEN n <= last THEN 'default ' || in_default || ' ' || n END AS title FROM f, s, t""",
    "provider_batches": """WITH i AS (SELECT doi, (row_number() OVER (ORDER BY doi) - 1) // 50 AS request FROM (SELECT DISTINCT '10.1/' || doc_id % 700 AS doi FROM documents WHERE doc_id % 9 > 0)),
a AS (SELECT '10.1/' || doc_id AS doi, CASE WHEN doc_id % 331 = 250 THEN 500.0 WHEN doc_id % 83 = 11 THEN 60.0 END AS wait, doc_id % 59 = 3 AS failed, 't' || doc_id AS title FROM documents WHERE doc_id < 700 AND doc_id % 2 = 0),
g AS (SELECT request, max(wait) AS wait, coalesce(bool_or(failed), false) AS failed FROM i LEFT JOIN a USING (doi) GROUP BY 1),
e AS (SELECT coalesce(min(request), 9223372036854775807) AS stop FROM g WHERE wait > 120)
SELECT doi, request, title FROM i JOIN g USING (request) LEFT JOIN a USING (doi), e WHERE g.wait IS NULL AND NOT g.failed AND request < stop""",
    "abstract_backfill": """WITH offer AS (SELECT '10.1/' || doc_id % 300 AS doi, arg_min(text, doc_id) AS a FROM documents WHERE length(text) >= 200 GROUP BY 1),
l AS (SELECT doc_id AS ref_id, '10.1/' || doc_id AS doi, CASE WHEN doc_id % 2 = 0 THEN text END AS abstract FROM documents),
j AS (SELECT ref_id, abstract, a, abstract IS NULL AND a IS NOT NULL AS fills FROM l LEFT JOIN offer USING (doi))
SELECT ref_id, sha256(coalesce(abstract, a)) AS abstract_hash, CASE WHEN fills THEN 'ENRICHED' ELSE 'PENDING' END AS status, CASE WHEN fills THEN 'DATASET' END AS provider, fills AS stale FROM j""",
    "library_dedupe": """SELECT doc_id AS ref_id, first_value(doc_id) OVER (PARTITION BY text ORDER BY (doc_id IN (SELECT vec_id FROM embeddings)) DESC, (length(text) >= 200) DESC, doc_id % 97, doc_id) AS winner_id FROM documents""",
    "enrichment_chain": f"""WITH {_provider(2)}, {_provider(3)}, {_provider(5)},
j AS (SELECT doc_id AS ref_id, CASE WHEN doc_id % 2 = 0 THEN source END AS own, p2.ref_id IS NOT NULL AS k2, p2.abstract AS a2, p3.ref_id IS NOT NULL AND doc_id % 13 = 1 AS bad, p3.ref_id IS NOT NULL AND doc_id % 13 <> 1 AND p2.abstract IS NULL AS k3,
  CASE WHEN doc_id % 13 <> 1 THEN p3.abstract END AS a3, p5.ref_id IS NOT NULL AS in5, d.n_chars FROM documents d LEFT JOIN p2 ON p2.ref_id = doc_id LEFT JOIN p3 ON p3.ref_id = doc_id LEFT JOIN p5 ON p5.ref_id = doc_id),
c AS (SELECT *, a2 IS NULL AND a3 IS NULL AND NOT (k2 OR k3) AS called5 FROM j),
o AS (SELECT *, called5 AND in5 AS k5, CASE WHEN a2 IS NOT NULL THEN 'SCOPUS' WHEN a3 IS NOT NULL THEN 'OPENALEX' END AS provider FROM c)
SELECT ref_id, coalesce(a2, a3) AS abstract, coalesce(own, CASE WHEN k2 THEN 's2' WHEN k3 THEN 's3' WHEN k5 THEN 's5' END) AS source_title, CAST(CASE WHEN k2 THEN 2002 WHEN k3 THEN 2003 WHEN k5 THEN 2005 END AS INTEGER) AS year,
  CASE WHEN k2 OR k3 OR k5 THEN n_chars END AS citation_count, CASE WHEN k2 OR k3 OR k5 THEN '10.1/' || ref_id END AS doi, provider,
  CASE WHEN provider IS NOT NULL THEN 'ENRICHED' WHEN k2 OR k3 OR k5 THEN 'INCOMPLETE' ELSE 'FAILED' END AS status,
  CASE WHEN provider IS NULL THEN 'No abstract retrieved (tried: SCOPUS, OPENALEX' || CASE WHEN bad THEN ':error' ELSE '' END || CASE WHEN called5 THEN ', CROSSREF' ELSE '' END || ')' END AS message FROM o""",
    "cache_probe": f"WITH {_CACHE} SELECT doc_id, answer IS NOT NULL AS hit, answer FROM documents LEFT JOIN cache ON sentence_hash = sha256(text)",
    "insert_ignore": f"WITH {_CACHE} SELECT sentence_hash, answer FROM cache UNION ALL SELECT h, -min(doc_id) FROM (SELECT sha256(text) AS h, doc_id FROM documents) WHERE h NOT IN (SELECT sentence_hash FROM cache) GROUP BY h",
    "mock_provider": """WITH h AS (SELECT p_partkey, p_name, sha256('10.1016/' || p_partkey) AS h FROM part)
SELECT p_partkey, 2015 + CAST('0x' || h[1:2] AS INTEGER) % 10 AS year, CAST('0x' || h[3:4] AS INTEGER) AS citations, array_to_string(list_filter(string_split(p_name, ' '), lambda w: length(w) > 5)[1:4], ';') AS keywords FROM h""",
    "inverted_abstract": "SELECT concat_ws(':', conv_id, turn) AS ref_id, sha256(array_to_string(w, ' ')) AS abstract_hash FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda w: w <> '') AS w FROM conversations) WHERE len(w) > 0",
    "status_counts": "SELECT o_orderstatus, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 200000) AS embedded, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS missing_abstract, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1",
    "missing_by_year": "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(sum(CASE WHEN o_totalprice < 60000 THEN 1 ELSE 0 END) AS BIGINT) AS missing, count(*) AS total FROM orders GROUP BY 1 HAVING missing > 0",
    "latest_runs": "SELECT user_id AS draft_id, arg_max(event_id, (ts, event_id)) AS run_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS runs FROM events GROUP BY 1",
    "paginate": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100",
    "in_flight": "SELECT c_custkey, c_mktsegment, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT') AS in_flight FROM customer",
    "provider_json": """SELECT l_orderkey, l_linenumber, 'T' || l_orderkey AS title, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(l_linenumber AS INTEGER) AS citations,
  CASE WHEN l_linenumber % 2 = 0 THEN 'D' || l_partkey WHEN l_linenumber % 3 = 0 THEN 'a b' ELSE 'c' END AS abstract, concat('k', l_suppkey, ';z') AS keywords FROM lineitem""",
}
