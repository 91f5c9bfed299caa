"""Every dealt operator on empty tables, null columns, repeated rows and a very long text."""

import pytest
from pyspark.sql import functions as F

from quirelight.llm import distinctive, leakage, mixing, near_dup, sentences, spam, subjects, themes, topn

PAPER = "input_row long, paper_id string, title string, abstract string, keyword string, doi string, authors string, venue string"
CLUSTER = "run_id string, text_view string, cluster_method string, cluster int, paper_id string, representative_rank int, medoid_rank int, distinguishing_evidence_terms string"
DOC = "doc_id long, text string, source string, lang string"
CONTEXT = "paper_id string, pdf_extract_method string, extracted_context string, discussion_full string"
ITEM = "id string, sentences string"
AREA = "paper_id string, area string"
TARGET = "source string, target_share double, max_repeats int"
EVAL = "item_id long, text string"


def run(name, make):
    papers, clusters, docs, contexts = make(PAPER), make(CLUSTER), make(DOC), make(CONTEXT)
    if name == "distinctive":
        return distinctive.distinctive_terms(papers, clusters)
    if name == "sentences":
        return sentences.passage_sentences(contexts, make(ITEM))
    if name == "near_dup":
        return near_dup.versions_of_works(papers)
    if name == "themes":
        return themes.themes(papers)
    if name == "subjects":
        return subjects.subject_areas(papers, make(AREA))
    if name == "topn":
        return topn.leading_papers(clusters)
    if name == "leakage":
        return leakage.leaked_items(docs, make(EVAL))
    if name == "mixing":
        return mixing.reached_shares(mixing.mix(docs, make(TARGET)), make(TARGET))
    return spam.stuffed_pages(docs)


NAMES = ["distinctive", "sentences", "near_dup", "themes", "subjects", "topn", "leakage", "mixing", "spam"]


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, name):
    assert run(name, lambda schema: spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_null_rows_written_twice(spark, name):
    def make(schema):
        n = len(schema.split(","))
        return spark.createDataFrame([tuple([None] * n)] * 2, schema).withColumn("paper_id_extra", F.lit(None).cast("string"))

    assert run(name, make).count() == 0


def test_a_very_long_text_is_whole(spark):
    body = "The lamp keeps the room, and Dr. Foo sorts maps. " * 9000  # 440,000 characters
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma"
    docs = spark.createDataFrame([(1, body + passage + ". End.", "s", "en")], DOC)
    items = spark.createDataFrame([(7, passage)], EVAL)
    assert [(r["item_id"], r["doc_id"]) for r in leakage.leaked_items(docs, items).collect()] == [(7, 1)]
    c = spark.createDataFrame([("p", "pypdf", body + "Last one.", None)], CONTEXT)
    got = sentences.passage_sentences(c, spark.createDataFrame([], ITEM))
    assert got.count() == 9001 and got.agg(F.max("end_pos")).first()[0] == len(body) + 9
    assert spam.redundancy(docs, "doc_id", "text").count() == 1
    p = spark.createDataFrame([(1, "a", "t", body, "k", "d", "x", "v"), (2, "b", "t", body + "More words here.", "k", "d", "x", "v"), (3, "c", "t", body, "k", "d", "x", "v")], PAPER)
    assert {(r[0], r[1]) for r in near_dup.versions_of_works(p).collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
