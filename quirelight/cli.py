"""Command line: ``python -m quirelight.cli papers.csv contexts.parquet out``."""

from __future__ import annotations

import argparse

from quirelight.plans.pipeline import Options, run, write
from quirelight.session import build_session, ship
from quirelight.sources.readers import read_csv
from quirelight.sources.writers import write_json


def main(argv: list[str] | None = None) -> None:
    a = argparse.ArgumentParser(description="Cluster papers per keyword and explain the clusters.")
    a.add_argument("papers", help="CSV file or Parquet folder with paper_id, title, abstract, keyword")
    a.add_argument("contexts", help="Parquet folder of full-text contexts")
    a.add_argument("output")
    a.add_argument("--methods", nargs="+", default=["kmeans", "hdbscan"], choices=["kmeans", "hdbscan", "dbscan"])
    a.add_argument("--text-view", default="overall", choices=["overall", "context", "knowledge-type", "method", "target-user", "purpose"])
    a.add_argument("--focus-keyword")
    for name, default in (("min-papers", 10), ("k-min", 2), ("k-max", 8), ("min-samples", 4), ("min-cluster-size", 5), ("context-paragraphs", 6)):
        a.add_argument(f"--{name}", type=int, default=default)
    a.add_argument("--k", type=int)
    a.add_argument("--no-select-k", action="store_true", help="six clusters in every group instead of the best number")
    a.add_argument("--lda-topics", type=int, default=6)
    a.add_argument("--embedding", default="tfidf-svd", choices=["tfidf-svd"])
    a.add_argument("--summary-output", help="also write the Markdown report to this folder")
    a.add_argument("--run-metadata", help="also write the run's metadata to this folder")
    a.add_argument("--eps", type=float)
    x = a.parse_args(argv)
    spark = build_session()
    ship(spark)
    papers = read_csv(spark, x.papers, None) if x.papers.endswith(".csv") else spark.read.parquet(x.papers)
    if "input_row" not in papers.columns:
        from pyspark.sql import functions as F

        papers = papers.withColumn("input_row", F.monotonically_increasing_id())
    o = Options(methods=tuple(x.methods), view=x.text_view, focus=x.focus_keyword, min_papers=x.min_papers, k=x.k, select_k=not x.no_select_k, k_min=x.k_min, k_max=x.k_max,
                min_samples=x.min_samples, min_cluster_size=x.min_cluster_size, eps=x.eps, context_paragraphs=x.context_paragraphs, topics=x.lda_topics, embedding=x.embedding)
    out = run(spark, papers, spark.read.parquet(x.contexts), o)
    write(out, x.output)
    if x.run_metadata:
        write_json(out["metadata"], x.run_metadata)
    if x.summary_output:
        spark.read.text(f"{x.output}/report").coalesce(1).write.mode("overwrite").text(x.summary_output)


if __name__ == "__main__":
    main()
