from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from attesta.functions import citations, claims, identifiers, scoring, text
from attesta.operators import drafts, models


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(
    ("raw", "family", "initials"),
    [
        ("Smith, J. A.", "Smith", "J. A."),
        ("J. A. Smith", "Smith", "J. A."),
        ("Jane A. Smith", "Smith", "J. A."),
        ("Smith", "Smith", ""),
        ("Zegarra Rodríguez D.", "Zegarra Rodríguez", "D."),
        ("Kleinschmidt J.H.", "Kleinschmidt", "J. H."),
        ("Wei Wu", "Wu", "W."),
        ("Smith, James Alan", "Smith", "J. A."),
    ],
)
def test_author_names(spark, raw, family, initials):
    a = one(spark, citations.author(F.lit(raw)).alias("a")).a
    assert (a.family, a.initials) == (family, initials)


def test_blank_authors_are_none(spark):
    assert one(spark, citations.author(F.lit("  ")).alias("a")).a is None
    assert one(spark, F.size(citations.authors(F.array(F.lit(" "), F.lit("Wu")))).alias("n")).n == 1


@pytest.mark.parametrize(
    ("sentence", "found"),
    [
        ("As shown [1, 2] and [3-5].", ["[1, 2]", "[3-5]"]),
        ("It holds (Smith et al., 2024; Lee, 2020).", ["(Smith et al., 2024; Lee, 2020)"]),
        ("Smith and Jones (2024) agree.", ["Smith and Jones (2024)"]),
        ("Jones (2024) agrees.", ["Jones (2024)"]),
        ("It holds (see Section 3).", []),
        ("In 2024 (a good year) nothing.", []),
    ],
)
def test_citations_in_sentences(spark, sentence, found):
    assert one(spark, claims.citations(F.lit(sentence)).alias("c")).c == found


@pytest.mark.parametrize(
    ("sentence", "section", "verdict", "score"),
    [
        ("Previous studies show that deep models improve accuracy by 12% on this task.", None, "STRONG", 1.0),
        ("Previous studies show that deep models improve accuracy by 12% on this task.", "References", "SKIP", 0.0),
        ("Too short to be one.", None, "SKIP", 0.0),
        ("Is it true that the model improves accuracy on the task?", None, "SKIP", 0.0),
        ("Table 2 presents the accuracy of the models on the whole task.", None, "SKIP", 0.0),
        ("In this paper we propose a model that improves the accuracy a lot.", None, "SKIP", 0.0),
        ("Accuracy is misleading when the class of interest is very rare.", None, "SEND_TO_LLM", 0.0),
    ],
)
def test_prefilter(spark, sentence, section, verdict, score):
    out = claims.prefilter(F.lit(sentence), F.lit(section).cast("string"))
    r = one(spark, *[c.alias(k) for k, c in out.items()])
    assert (r.verdict, round(r.score, 6)) == (verdict, score)


@pytest.mark.parametrize(
    ("link", "doi", "kind"),
    [
        ("https://doi.org/10.1016/J.X.2021.1).", "10.1016/j.x.2021.1", "DOI"),
        ("https://www.scopus.com/x?eid=2-s2.0-85&scp=99", None, "SCOPUS"),
        ("10.1000/xyz", "10.1000/xyz", "DOI"),
        ("https://pub.org/10.1000%2Fxyz", "10.1000/xyz", "PUBLISHER"),
        ("https://pub.org/", None, "PUBLISHER"),
        ("https://pub.org/100%", None, "PUBLISHER"),
        (None, None, "UNKNOWN"),
    ],
)
def test_identifiers(spark, link, doi, kind):
    r = one(spark, *[c.alias(k) for k, c in identifiers.identifiers(F.lit(link).cast("string")).items()])
    assert (r.doi, r.link_kind) == (doi, kind)


def test_columns_beat_links(spark):
    ids = identifiers.identifiers(F.lit("https://doi.org/10.1000/a"), F.lit("10.1000/B"), F.lit("2-S2.0-7"))
    r = one(spark, *[c.alias(k) for k, c in ids.items()])
    assert (r.doi, r.scopus_eid) == ("10.1000/b", "2-s2.0-7")


def score(spark, parts, verdict, has_abstract=True):
    final = scoring.final_score(*map(F.lit, parts), scoring.verdict_score(F.lit(verdict)))
    shown = scoring.percentage(final, F.lit(verdict), F.lit(has_abstract))
    r = one(spark, shown.alias("p"), scoring.label(shown, F.lit(verdict), F.lit(has_abstract)).alias("l"))
    return r.p, r.l


def test_scores_caps_and_labels(spark):
    assert score(spark, (1.0, 1.0, 1.0, 1.0), "SUPPORTED") == (100.0, "Strong recommendation")
    assert score(spark, (1.0, 1.0, 1.0, 1.0), "SKIPPED") == (100.0, "Possible reference")
    assert score(spark, (1.0, 1.0, 1.0, 1.0), "CONTRADICTED") == (20.0, "Do not recommend")
    assert score(spark, (1.0, 1.0, 1.0, 1.0), "SUPPORTED", False) == (45.0, "Cannot verify")
    assert score(spark, (1.0, 1.0, 1.0, 1.0), "TOPICALLY_RELATED_BUT_NOT_EVIDENCE") == (90.2, "Recommended")


def test_rule_verdicts(spark):
    v = lambda claim, abstract: one(spark, scoring.rule_verdict(F.lit(claim), F.lit(abstract).cast("string")).alias("v")).v
    assert v("vaccines reduce disease", "vaccines reduce disease strongly") == "SUPPORTED"
    assert v("vaccines reduce disease", "we find no evidence that vaccines reduce disease") == "CONTRADICTED"
    assert v("vaccines reduce disease", None) == "INSUFFICIENT_EVIDENCE"
    assert v("vaccines reduce disease", "nothing here") == "INSUFFICIENT_EVIDENCE"


def test_hash_dimension_is_the_md5_modulo(spark):
    import hashlib

    for w in ("alpha", "é", "x" * 40):
        assert one(spark, text.hash_dimension(F.lit(w)).alias("d")).d == int(hashlib.md5(w.encode()).hexdigest(), 16) % 768


def test_several_in_text_citations_share_brackets(spark):
    got = one(spark, citations.joined_in_text(F.array(F.lit("(Smith, 2023)"), F.lit("(Lee et al., 2024)"))).alias("c")).c
    assert got == "(Smith, 2023; Lee et al., 2024)"


def test_style_names():
    assert citations.style_of(" ieee ") == "IEEE"
    with pytest.raises(ValueError):
        citations.style_of("MLA")


def test_sections_and_offsets(spark):
    raw = spark.createDataFrame([("d", 0, "Title", True), ("d", 1, "  ", False), ("d", 2, "Smith et al. (2024) found it, e.g. here. It is 3.5 m. Fine!", False), ("d", 3, "1. Introduction", True), ("d", 4, "We go on.", False)], "draft_id string, paragraph_index int, text string, is_heading boolean")
    blocks = drafts.assembled(raw)
    rows = {r.paragraph_index: r for r in blocks.collect()}
    assert sorted(rows) == [0, 2, 3, 4] and rows[2].section_title == "Title" and rows[2].char_start == 7
    found = drafts.sentences(blocks)
    assert [r.text for r in found.orderBy("char_start").collect()] == ["Smith et al. (2024) found it, e.g. here.", "It is 3.5 m.", "Fine!", "We go on."]
    assert [r.text for r in drafts.in_body(found, blocks).collect()] == ["We go on."]


def test_model_hooks(spark):
    df = spark.createDataFrame([("a b",), (None,)], "t string").coalesce(1)
    encode = models.embedder(lambda: lambda texts: [[len(t), 1.0] for t in texts])
    assert [round(math.hypot(*r.v), 6) for r in df.select(encode("t").alias("v")).collect()] == [1.0, 1.0]
    rank = models.reranker(lambda: lambda pairs: [0.0 for _ in pairs])
    assert df.select(rank("t", "t").alias("s")).first().s == 0.5
    cache = spark.createDataFrame([(1, "old")], "k long, v string")
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k long, q string")
    out = models.answered(rows, cache, ["k"], lambda batch: [{"v": r["q"]} if r["k"] == 2 else None for r in batch], "v string")
    assert {(r.k, r.v) for r in out.collect()} == {(1, "old"), (2, "y"), (3, None)}
    assert one(spark, models.salvaged_json(F.lit('Here: ```{"a": 1}```'), "a int").alias("j")).j.a == 1


def test_vectors_without_a_direction_lose_no_others(spark):
    from attesta.operators.retrieval import vector_topk

    inf, nan = float("inf"), float("nan")
    bad = [(90 + k, v) for k, v in enumerate([None, [], [0.0, 0.0], [nan, 1.0], [inf, 1.0], [None, 1.0]])]
    claims = spark.createDataFrame([(1, [1.0, 0.0]), *bad], "claim_id int, vector array<double>")
    papers = spark.createDataFrame([(7, [1.0, 1.0]), (8, [0.0, 1.0]), *bad], "ref_id int, vector array<double>").coalesce(1)
    out = [(r.claim_id, r.ref_id, r.vector_rank) for r in vector_topk(claims, papers, k=3).collect()]
    assert sorted(out) == [(1, 7, 1), (1, 8, 2)]


def test_every_draft_keeps_claims_of_its_own(spark):
    from attesta.plans.recommend import gate

    rows = [(d, 100 * d + c, p, 1.0 / d + 0.001 * c, p) for d in (1, 2) for c in range(30) for p in range(5)]
    out = gate(spark.createDataFrame(rows, "draft_id long, claim_id long, ref_id long, rerank double, prerank_rank int"), 20, 3)
    assert {(r.draft_id, r.n) for r in out.groupBy("draft_id").agg(F.countDistinct("claim_id").alias("n")).collect()} == {(1, 20), (2, 20)}
    assert out.count() == 120 and out.where("draft_id = 2 and claim_id < 210").count() == 0


def test_identifiers_in_capitals_and_headers_of_one_column(spark):
    from attesta.functions import identifiers
    from attesta.sources import spreadsheets

    hex40 = "ABCDEF0123" * 4
    df = spark.createDataFrame([("https://www.semanticscholar.org/paper/T/" + hex40, "https://doi.org/10.1/AB"), ("x", "https://doi.org/")], "link string, doi string")
    out = df.select(identifiers.identifiers(F.col("link"))["semantic_scholar_id"].alias("s2"), identifiers.openalex_doi(F.col("doi")).alias("doi")).collect()
    assert [(r.s2, r.doi) for r in out] == [(hex40.lower(), "10.1/ab"), (None, None)]
    aliases = next(a for a in spreadsheets.COLUMN_ALIASES.values() if len(a) > 1)
    title, link = (spreadsheets.COLUMN_ALIASES[c][0] for c in ("title", "source_link"))
    assert spreadsheets.header_row([list(aliases), [title, link]]) == 1 or aliases[0] in (title, link)


def test_one_claim_alone_gets_what_the_batch_gives(spark):
    from attesta.plans.recommend import recommend

    words = "solar wind turbine grid storage battery cell panel heat water soil crop".split()
    papers = spark.createDataFrame([(i, f"On {words[i % 12]} and {words[i * 5 % 12]}", f"{words[i % 12]} improves {words[i * 7 % 12]} by {i} percent", 2020, [1.0, i % 4 + 0.5, i % 3 - 1.0]) for i in range(30)], "ref_id long, title string, abstract string, year int, vector array<double>")
    claims = spark.createDataFrame([(i, f"{words[i]} improves {words[i + 3]} in the field", [1.0, i + 0.1, i / 3]) for i in range(4)], "claim_id long, query string, vector array<double>")
    rows = lambda c: sorted((r.claim_id, r.ref_id, r.rank, r.percentage, r.label) for r in recommend(c, papers).collect())
    together = rows(claims)
    assert rows(claims.where("claim_id = 2")) == [r for r in together if r[0] == 2] != []


@pytest.mark.parametrize("parts, year", [([[2021, 3, 1]], 2021), ([[2020], [2022]], 2020), ([[]], None), ([], None), (None, None), ([[None]], None)])
def test_issue_years(spark, parts, year):
    from attesta.functions.providers import issued_year

    row = spark.createDataFrame([(parts,)], "d array<array<int>>").select(issued_year(F.col("d")).alias("y")).first()
    assert row.y == year


def test_chains_tell_what_was_tried(spark):
    from attesta.operators.importing import enriched

    kind = "ref_id int, abstract string, source_title string, year int, citation_count long, doi string"
    papers = spark.createDataFrame([(1, None, None, None, None, None), (2, "", "J", 2000, None, None), (3, "own", None, None, None, None)], kind)
    broken = spark.createDataFrame([(1, None, None, None, None, None, True)], kind + ", failed boolean")
    plain = spark.createDataFrame([(1, None, "K", 1999, 5, "10.1/x"), (2, None, "K", 1999, 5, "10.1/y")], kind)
    rows = {r.ref_id: r for r in enriched(papers, [("A", broken), ("B", plain)], ("B",)).collect()}
    assert rows[1].message == "No abstract retrieved (tried: A:error, B)" and rows[1].status == "INCOMPLETE" and rows[1].year == 1999
    assert rows[2].message == "No abstract retrieved (tried: A)" and rows[2].status == "FAILED" and rows[2].citation_count is None
    assert rows[3].message is None and rows[3].status == "ENRICHED"
    assert {r.message for r in enriched(papers, [("B", plain)], ("B",)).collect()} == {"No abstract retrieved (tried: B)", "No abstract retrieved (tried: none)", None}
