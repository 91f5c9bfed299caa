"""Sources, sinks, the pipeline and the stream."""

import json

from pyspark.sql import functions as F

from quirelight.plans import pipeline as P
from quirelight.sources import readers as S
from quirelight.sources import writers as O
from quirelight.streaming import stateless as Z

DIR = "/root/testdata/sf0.001"


def test_csv_with_quotes_and_line_breaks(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "quoted"\nline, too', ["x"]), ("2", None, None)], "paper_id string, title string, tags array<string>")
    O.write_csv(df, str(tmp_path / "t"))
    got = {r["paper_id"]: r["title"] for r in S.read_csv(spark, str(tmp_path / "t"), None).collect()}
    assert got == {"1": 'a "quoted"\nline, too', "2": ""}


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.html").write_bytes(b"<p>One &amp; two</p><script>no()</script><p>Three</p>")
    assert [r[0] for r in S.listed_ids(spark, str(tmp_path)).collect()] == ["a"]
    got = {r["paper_id"]: r["text"] for r in S.read_texts(spark, str(tmp_path), glob="*.html").collect()}
    assert got["b"].split() == ["One", "&", "two", "Three"]
    bad = S.read_texts(spark, str(tmp_path), extract=lambda b: 1 / 0, glob="*.html").first()
    assert bad["method"] == "failed" and bad["text"] is None
    raw = spark.read.format("binaryFile").load(str(tmp_path))
    assert sorted(r["p"] for r in raw.select(S.is_pdf(F.col("content")).alias("p")).collect()) == [False, True]


def test_embedded_json_and_services(spark):
    page = O.page(json.dumps({"title": "t</x>", "n": 1}), "page")
    df = spark.createDataFrame([(page,), ("<p>none</p>",)], "html string")
    assert [r["v"] and r["v"]["n"] for r in df.select(S.embedded_json(F.col("html"), "payload", "title string, n int").alias("v")).collect()] == [1, None]
    answers = spark.createDataFrame([("1", '{"a": "https://x.org/1.pdf", "b": [{"u": "https://y.org"}, {"u": "https://x.org/1.pdf"}]}'), ("2", "broken {")], "paper_id string, body string")
    assert [(r["paper_id"], r["link"]) for r in S.service_candidates(answers, "s", "paper_id", "body").orderBy("place").collect()] == [("1", "https://x.org/1.pdf"), ("1", "https://y.org")]


def test_cache_and_embedding(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return S.embed(spark.createDataFrame([("a", "xx"), ("b", None)], "k string, t string"), "k", "t", lambda ts: [[float(len(t))] for t in ts])

    for _ in range(2):
        got = {r["k"]: r["vector"] for r in S.cached(spark, str(tmp_path / "e"), make).collect()}
    assert got == {"a": [2.0], "b": [0.0]} and len(calls) == 1


def test_pipeline_end_to_end(spark, tmp_path):
    o = P.run(spark, spark.read.parquet(f"{DIR}/final_advancing_list.parquet"), spark.read.parquet(f"{DIR}/build_fulltext_context.parquet"), P.Options(min_papers=14, features=150, dims=10, k_max=3, starts=2))
    P.write(o, str(tmp_path / "out"))
    read = lambda name: spark.read.parquet(str(tmp_path / "out" / name))
    assert read("neighbours").where("place > 5 or query = neighbour").count() == 0 and read("neighbours").count() > 0
    assert {"clusters", "average_silhouette", "selected"} <= set(read("selection").columns) and read("selection").where("selected").count() >= 1
    assert read("evidence").columns == ["g", "place", "id", "paper_id", "paragraph_index", "sentences", "score"]
    report = [r[0] for r in spark.read.text(str(tmp_path / "out" / "report")).collect()]
    assert report[0].startswith("# Clusters") and any("too_few_papers" in x for x in report) and any("Read first" in x for x in report)
    assert spark.read.json(str(tmp_path / "out" / "metadata")).first()["min_papers_to_cluster"] == 14
    fresh = P.refresh_payload(read("payload"), spark.createDataFrame([(read("payload").first()["part"], 0, "New label", 7)], "part string, cluster int, label string, n int"))
    assert fresh.where("payload like '%New label%'").count() >= 1 and fresh.count() == read("payload").count()
    rows = spark.read.parquet(str(tmp_path / "out" / "papers"))
    assert {r[0] for r in rows.select("cluster_status").distinct().collect()} == {"clustered", "too_few_papers"}
    assert rows.where("cluster = -1 and is_representative_top3").count() == 0
    labels = spark.read.parquet(str(tmp_path / "out" / "clusters"))
    assert labels.where("label is null or summary is null").count() == 0 and labels.count() >= 2
    assert labels.where("cluster >= 0 and distinguishing_evidence_terms = ''").count() == 0
    assert labels.where("cluster >= 0 and (faithfulness is null or faithfulness < 0 or faithfulness > 1)").count() == 0
    assert rows.where("cluster >= 0 and (umap_x is null or lda_topic is null)").count() == 0
    assert P.refresh(rows.select("keyword", "cluster_method", "cluster", "paper_id"), labels).count() == rows.count()


def test_reports(spark):
    assert "Failures" in O.extraction_report({"papers": 2, "found": 1}, spark.createDataFrame([("x",)], "paper_id string"))
    lines = spark.createDataFrame([("k", "m", 1, "b"), ("k", "m", 0, "a")], "keyword string, cluster_method string, cluster int, line string")
    assert O.markdown(lines, "T", ["keyword", "cluster"]).splitlines() == ["# T", "", "a", "b"]


def test_stream_equals_batch(spark, tmp_path):
    src = spark.read.parquet(f"{DIR}/final_advancing_list.parquet").select("paper_id", "title", "abstract", "keyword", "loaded_at")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = Z.coded(stream).writeStream.format("memory").queryName("coded").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("coded").count() == Z.coded(src).count()
    q = Z.arrivals(stream).writeStream.format("memory").queryName("arrivals").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("arrivals").agg(F.sum("n")).first()[0] == Z.arrivals(src).agg(F.sum("n")).first()[0]
