"""Text expressions against hand-written cases."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirelight.functions import text as X
from quirelight.operators import contexts as C


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(make(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize("raw,expected", [
    (" design   PATTERNS ", ["Design patterns"]), ("Design theory; design  rules|own words , ", ["Design theory", "Design rules", "own words"]), ("nan", []), ("", []), (None, [])])
def test_keywords(spark, raw, expected):
    assert one(spark, raw, X.keyword_list) == expected


@pytest.mark.parametrize("raw,expected", [
    ("https://doi.org/10.1/AB", "10.1/ab"), ("doi:10.1/x", "10.1/x"), ("DOI:https://doi.org/10.1/y ", "10.1/y"), (None, ""), ("doi:http://doi.org/10.2/z", "10.2/z"), ("https://doi.org/doi:10.2/z", "doi:10.2/z")])
def test_doi(spark, raw, expected):
    assert one(spark, raw, X.doi) == expected


def test_names_and_links(spark):
    assert one(spark, "A New-Title: 2nd!", X.slug) == "a_new_title_2nd"
    assert one(spark, "..", X.safe_name) == "paper"
    assert one(spark, "x/y.PDF?dl=1", X.is_direct_pdf) is True
    assert one(spark, None, X.is_direct_pdf) is False


@pytest.mark.parametrize(("doi", "url", "expected"), [
    ("10.48550/arXiv.2101.01234", None, "https://arxiv.org/pdf/2101.01234.pdf"), (None, "https://www.arxiv.org/pdf/2101.01234.pdf?x", "https://arxiv.org/pdf/2101.01234.pdf"),
    ("10.1/x", "https://arxiv.org/abs/cs.HC1", "https://arxiv.org/pdf/cs.HC1.pdf"), (None, "https://evil.example/arxiv.org/abs/2101.01234", ""), (None, None, "")])
def test_arxiv(spark, doi, url, expected):
    df = spark.createDataFrame([(doi, url)], "d string, u string")
    assert df.select(X.arxiv_pdf(F.col("d"), F.col("u"))).first()[0] == expected


def test_spaces_and_blocks(spark):
    assert one(spark, "a\x00b\t c\n\n\n\nd ", X.clean_space) == "a b c\n\nd"
    assert one(spark, "one\n \ntwo\nlines\n\n\n", X.blocks) == ["one", "two\nlines"]
    assert one(spark, "", X.blocks) == []


def test_boundaries_and_relevance(spark):
    text = "Design patterns, pattern; patterned design\tpatterns"
    assert one(spark, text, lambda c: X.boundary_count(X.phrase(c), "pattern")) == 1
    assert one(spark, text, lambda c: X.relevance(c, ("design patterns", "pattern"))) == 9


def test_sentences_roots_and_citations(spark):
    assert one(spark, 'It works. Really? "Yes." ok', X.sentences) == ["It works.", "Really?", '"Yes." ok']
    assert sorted(one(spark, "Studies of classes and boxes by users", X.roots)) == ["and", "box", "classe"]
    assert one(spark, "as shown [1] by Foo et al. and (Bar, 2020)", X.citation_density) > 20


def test_distinct_terms_keep_first_spelling(spark):
    assert one(spark, "Loom, loom , , nan,Wall", lambda c: X.distinct_terms(X.terms(c))) == ["Loom", "Wall"]


@settings(max_examples=25, deadline=None)
@given(st.text(max_size=40))
def test_squeeze_is_idempotent(spark, value):
    once = one(spark, value, X.squeeze)
    assert one(spark, once, X.squeeze) == once


def test_discussion_and_leads(spark):
    text = "Intro text here.\n\n4.2 Findings and Discussion\n\nWhat follows is long enough to be a lead sentence. Second."
    found = one(spark, text, lambda c: C.discussion(X.blocks(c), 2)[0])
    parts = one(spark, text, lambda c: C.discussion(X.blocks(c), 2)[1])
    assert found and len(parts) == 2 and parts[0].startswith("4.2")
    assert one(spark, "no heading", lambda c: C.discussion(X.blocks(c), 2)[1]) == []
    assert one(spark, text, lambda c: C.lead_summary(X.blocks(c))) == "- What follows is long enough to be a lead sentence."


def test_context_falls_back_to_first_paragraphs(spark):
    df = spark.createDataFrame([("a", "x y\n\nz"), ("b", "none\n\ndesign theory here\n\ndesign theory, design rules"), ("c", None)], "paper_id string, t string")
    got = {r["paper_id"]: (r["context"], r["matched"]) for r in C.top_context(df, "t", C.CONTEXT_TERMS, 1).collect()}
    assert got == {"a": ("x y", 0), "b": ("design theory, design rules", 2), "c": ("", 0)}


@pytest.mark.parametrize("text,most,n", [("", 10, 0), ("One two. Three four. Five.", 12, 3), ("x" * 50, 10, 1), ("a\n\nb", 10, 2)])
def test_packing(text, most, n):
    chunks = C.pack(text, most)
    assert len(chunks) == n and "".join("".join(chunks).split()) == "".join(text.split())
