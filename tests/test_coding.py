"""Rule coding, labels, evidence and topics on hand-written fixtures."""

import pytest
from pyspark.sql import functions as F

from quirelight.operators import coding as Y
from quirelight.operators import evidence as E
from quirelight.operators import labels as L
from quirelight.operators import relational as R
from quirelight.operators import topics as T

SENTENCES = {
    "theoretical": "we argue that rooms matter. we argue that walls do.", "methodological": "this paper sorts the pile through a walkthrough. using a protocol.", "artifact": "the contribution is a lamp with keys.",
    "empirical": "findings from 12 rooms. the results show it.", "survey": "prior studies of it, yet few accounts. prior studies again.", "opinion": "it remains open whether. we discuss how. we discuss how.", "dataset": "data: 40 records of it.",
}


def papers(spark, rows):
    return spark.createDataFrame(rows, "g string, paper_id string, low string")


@pytest.mark.parametrize("key", sorted(SENTENCES))
def test_each_contribution(spark, key):
    got = Y.contribution(papers(spark, [("a", "1", SENTENCES[key])]), "g", "paper_id", "low").first()
    assert got["contribution"] == key and got["support"] == 1


def test_support_needs_more_in_large_groups(spark):
    rows = [("a", str(i), SENTENCES["artifact"] if i == 0 else "nothing") for i in range(20)]
    assert Y.contribution(papers(spark, rows), "g", "paper_id", "low").first()["contribution"] == "unclear"
    rows = [("a", str(i), list(SENTENCES.values())[i] if i < 3 else "nothing") for i in range(40)]
    assert Y.contribution(papers(spark, rows), "g", "paper_id", "low").first()["contribution"] == "mixed"


def test_domains_and_generic(spark):
    got = {r["g"]: r["domain"] for r in Y.domains(papers(spark, [("a", "1", "in hospital wards"), ("b", "1", "nothing")]), "g", "paper_id", "low").collect()}
    assert got == {"a": "healthcare", "b": "generic"}


def test_move_is_unclear_on_ties(spark):
    tie = papers(spark, [("a", "1", "we call this x. the effect on y"), ("b", "1", "the effect on y. the effect on z")])
    assert {r["g"]: r["move"] for r in Y.theory_move(tie, "g", "paper_id", "low").collect()} == {"a": "unclear", "b": "tests"}


def test_labels_of_siblings_differ(spark):
    df = spark.createDataFrame([("r", 0, "L", "x"), ("r", 1, "L", "y"), ("r", 2, "L", "x"), ("r", 3, "M", "x")], "run string, c int, label string, extra string")
    got = [r["final_label"] for r in L.distinct_labels(df, ["run"], "c", "label", "extra").orderBy("c").collect()]
    assert got == ["L around x", "L around y", "L", "M"]


def test_unique_phrases(spark):
    df = spark.createDataFrame([("r", 0, ["wall maps", "looms"]), ("r", 1, ["map rooms"]), ("r", -1, ["wall"]), ("s", 0, ["x"])], "run string, c int, p array<string>")
    got = {(r["run"], r["c"]): r["unique"] for r in L.unique_phrases(df, ["run"], "c", "p").collect()}
    assert got == {("r", 0): ["looms", "wall maps"], ("r", 1): ["map rooms"]}


def test_evidence_greedy_and_slices(spark, monkeypatch):
    long = "a sentence about %s that is long enough to count as a passage of evidence, surely, with %s and more words"
    rows = [("g", f"p{i % 4}", i, long % (f"thing{i}", f"stuff{i}"), f"s{i}", float(30 - i)) for i in range(12)] + [("g", "q", 0, long % ("thing0", "stuff0"), "dup", 29.5), ("g", "z", 0, "short", "short", 99.0)]
    df = spark.createDataFrame(rows, "g string, paper_id string, paragraph_index int, paragraph string, sentences string, score double")
    whole = [tuple(r) for r in E.select_evidence(df, "g", alike=0.95).orderBy("place").collect()]
    monkeypatch.setattr(E, "SLICE", 3)
    assert [tuple(r) for r in E.select_evidence(df, "g", alike=0.95).orderBy("place").collect()] == whole
    assert len(whole) == 6 and whole[0][3] == "p0" and all(sum(w[3] == p for w in whole) <= 2 for p in "p0 p1 p2 p3 q".split())


def test_claim_support(spark):
    c = spark.createDataFrame([("g", "lamp posts glow"), ("g", "unrelated matters entirely"), ("g", "of")], "g string, claim string")
    e = spark.createDataFrame([("g", "the lamp glows"), ("g", "posts")], "g string, passage string")
    got = {r["claim"]: r["supported"] for r in E.claim_support(c, e, "g", "claim", "passage").collect()}
    assert got == {"lamp posts glow": True, "unrelated matters entirely": False, "of": True}


def test_label_cleaning(spark):
    df = spark.createDataFrame([(["looms", "design", "loom walls", "view of", "wall", "maps"],)], "r array<string>")
    assert df.select(T.clean_labels(F.col("r"), 3).alias("x")).first()["x"] == ["looms", "wall", "maps"]


@pytest.mark.parametrize("n,cap", [(1, 0), (3, 2), (4, 2), (9, 2), (10, 3), (19, 3), (20, 4), (34, 4), (35, 5), (59, 5), (60, 6), (89, 6), (90, 8)])
def test_caps(spark, n, cap):
    assert spark.range(1).select(R.most_clusters(F.lit(n)).alias("k")).first()["k"] == cap


def test_relational_edges(spark):
    df = spark.createDataFrame([(2, "a", "B", None, None), (1, "a", "A", "x", "design rules"), (3, None, "C", "", "")], "input_row long, paper_id string, title string, abstract string, keyword string")
    assert [(r["paper_id"], r["title"], r["abstract"]) for r in R.prepare(df).collect()] == [("a", "A", "x")]
    with pytest.raises(ValueError, match="title"):
        R.prepare(df.drop("title"))
    up = R.update_where(df.select("paper_id", "title"), df.where("input_row = 1").select("paper_id", F.lit("new").alias("note")), ["paper_id"], ["note"])
    assert sorted((r["title"], r["note"]) for r in up.collect()) == [("A", "new"), ("B", "new"), ("C", "")]
