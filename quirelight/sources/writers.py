"""Sinks: tables, metadata, Markdown reports and the explorer payload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """A CSV folder with header; nested columns as JSON text."""
    flat = df.withColumns({c: F.to_json(c) for c, t in df.dtypes if t.startswith(("array", "struct", "map"))})
    flat.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def write_table(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    """Parquet, the primary result format, partitioned for later pruning."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition) if partition else w).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def run_metadata(keywords: DataFrame, methods: list[str], view: str, embedding: str, least: int) -> DataFrame:
    """One row: counts and parameters of a batch run, keyword counts as a map."""
    n = keywords.groupBy("keyword").agg(F.countDistinct("paper_id").alias("n"))
    papers = keywords.select("paper_id").distinct().count()
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("keyword", "n"))))  # one entry per keyword group
    return n.agg(F.count(F.lit(1)).alias("keyword_count"), entries.alias("keyword_counts")).withColumns(
        {"paper_count": F.lit(papers), "methods": F.array(*[F.lit(m) for m in methods]), "text_view": F.lit(view), "embedding": F.lit(embedding), "min_papers_to_cluster": F.lit(least)})


def cluster_lines(rows: DataFrame) -> DataFrame:
    """(``keyword, cluster_method, cluster, line``): one Markdown line per cluster with its size,
    theme and leading papers. ``rows`` has keyword, cluster_method, cluster, paper_id, title,
    rank, theme."""
    lead = F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("rank").between(1, 3), F.struct("rank", "paper_id", "title")))), 1, 3), lambda x: x["title"])
    g = rows.groupBy("keyword", "cluster_method", "cluster").agg(F.countDistinct("paper_id").alias("n"), F.max("theme").alias("theme"), lead.alias("lead"))
    line = F.concat(F.lit("- **"), F.col("keyword"), F.lit(" / "), F.col("cluster_method"), F.lit(" / "), F.col("cluster").cast("string"), F.lit("** ("), F.col("n").cast("string"), F.lit(" papers): "), F.coalesce("theme", F.lit("")),
                    F.when(F.size("lead") > 0, F.concat(F.lit(". Read first: "), F.array_join("lead", "; "))).otherwise(""))
    return g.select("keyword", "cluster_method", "cluster", line.alias("line"))


def markdown(lines: DataFrame, title: str, order: list[str]) -> str:
    """The report as one text; the lines are one per cluster, read in order."""
    return "\n".join([f"# {title}", "", *[r["line"] for r in lines.orderBy(*order).toLocalIterator()], ""])


def explorer_payload(title: str, papers: DataFrame, clusters: DataFrame, part: str, most: int = 5000) -> DataFrame:
    """(part, ``bucket, payload``): the explorer's JSON by a part of the data (a keyword, a
    run) in buckets of about ``most`` papers, so that no task builds one text of a large
    part. Every bucket carries the part's cluster list."""
    n = papers.groupBy(part).agg(F.ceil(F.count(F.lit(1)) / most).alias("_b"))
    p = papers.join(n, part).withColumn("bucket", F.pmod(F.xxhash64("paper_id"), F.col("_b")).cast("int"))
    body = p.groupBy(part, "bucket").agg(F.array_sort(F.collect_list(F.struct("paper_id", "title", "cluster", "x", "y"))).alias("papers"))
    head = clusters.groupBy(part).agg(F.array_sort(F.collect_list(F.struct("cluster", "label", "n"))).alias("clusters"))
    return body.join(head, part, "left").select(part, "bucket", F.to_json(F.struct(F.lit(title).alias("title"), "papers", "clusters")).alias("payload"))


def page(payload: str, title: str) -> str:
    """A static page that carries a payload where :func:`readers.embedded_json` finds it."""
    safe = payload.replace("</", "<\\/")
    return f'<!doctype html><meta charset="utf-8"><title>{title}</title><h1>{title}</h1><script type="application/json" id="payload">{safe}</script>'


def extraction_report(coverage: dict[str, int], failures: DataFrame, most: int = 50) -> str:
    """Markdown on what was extracted, with at most ``most`` failures named."""
    rows = failures.orderBy("paper_id").limit(most).collect()
    n = max(1, coverage.get("papers", 0))
    out = ["# Full-text extraction", ""] + [f"- {k}: {v} of {coverage.get('papers', 0)} ({100 * v / n:.1f} %)" for k, v in coverage.items() if k not in ("papers", "characters")]
    return "\n".join([*out, "", "## Failures", "", *[f"- {r['paper_id']}" for r in rows], ""])
