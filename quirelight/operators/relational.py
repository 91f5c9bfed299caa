"""Preparation, lookups, gates and reports over paper tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirelight.functions import text as X

REQUIRED = ("paper_id", "title", "abstract", "keyword")


def require_columns(df: DataFrame, names: tuple[str, ...] = REQUIRED) -> DataFrame:
    """The frame itself, or a ValueError that lists the missing columns."""
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the row first in ``order``; a partial aggregate, so a key with a third of
    all rows is reduced before the shuffle. Rows with a null key are dropped."""
    rest = [c for c in df.columns if c != key]
    pick = F.min_by(F.struct(*rest), F.col(order))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(pick.alias("_r")).select(key, *[F.col(f"_r.`{c}`").alias(c) for c in rest])


def prepare(df: DataFrame) -> DataFrame:
    """Required columns checked, their text squeezed, one row per ``paper_id``, the first."""
    one = first_per_key(require_columns(df), "paper_id", "input_row")
    return one.withColumns({c: X.squeeze(X.text(c)) for c in ("title", "abstract", "keyword")})


def latest_contexts(df: DataFrame) -> DataFrame:
    """One row per ``paper_id``: the one built last."""
    rest = [c for c in df.columns if c != "paper_id"]
    pick = F.max_by(F.struct(*rest), F.struct("built_at", F.coalesce("extracted_context", F.lit(""))))
    return df.where("paper_id is not null").groupBy("paper_id").agg(pick.alias("_r")).select("paper_id", *[F.col(f"_r.{c}").alias(c) for c in rest])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def paper_keywords(papers: DataFrame) -> DataFrame:
    """(``paper_id, position, keyword``): every canonical keyword of every paper once."""
    ks = X.distinct_terms(X.keyword_list(F.col("keyword")))
    return papers.select("paper_id", F.posexplode(ks).alias("position", "keyword")).withColumn("position", F.col("position") + 1)


def group_sizes(keywords: DataFrame) -> DataFrame:
    """(``keyword, n, place``): groups from the largest, equal sizes by name."""
    n = keywords.groupBy("keyword").agg(F.countDistinct("paper_id").alias("n"))
    # one row per keyword group: the table of groups, not of papers, is ranked
    return n.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), F.lower("keyword"), "keyword")))


def size_gate(keywords: DataFrame, least: int = 10) -> DataFrame:
    """(``keyword, n, status``): ``clustered`` from ``least`` papers on, else ``too_few_papers``."""
    n = keywords.groupBy("keyword").agg(F.countDistinct("paper_id").alias("n"))
    return n.withColumn("status", F.when(F.col("n") < least, "too_few_papers").otherwise("clustered"))


def most_clusters(n: Column) -> Column:
    """How many clusters a group of ``n`` papers may have."""
    return (F.when(n < 4, F.greatest(F.lit(0), n - 1)).when(n < 10, 2).when(n < 20, 3).when(n < 35, 4).when(n < 60, 5).when(n < 90, 6).otherwise(8)).cast("int")


def cluster_bounds(n: Column, k_min: int = 2, k_max: int = 8) -> tuple[Column, Column]:
    upper = F.least(F.lit(k_max), most_clusters(n), n - 1).cast("int")
    return F.greatest(F.lit(2), F.least(F.lit(k_min), upper)).cast("int"), upper


def density_parameters(n: Column, min_cluster_size: int = 5, min_samples: int = 4, topics: int = 6) -> dict[str, Column]:
    """Parameters of density clustering and topics, scaled down for small groups."""
    return {
        "min_cluster_size": F.least(F.lit(min_cluster_size), F.greatest(F.lit(2), F.floor(n / 3))).cast("int"),
        "min_samples": F.least(F.lit(min_samples), F.greatest(F.lit(2), F.floor(n / 4))).cast("int"),
        "topics": F.least(F.lit(topics), F.greatest(F.lit(2), n - 1)).cast("int"),
    }


def confirmed(papers: DataFrame, ids: DataFrame) -> DataFrame:
    """Papers whose id is listed; the list is broadcast only under Spark's size limit."""
    return papers.join(ids.select("paper_id").distinct(), "paper_id", "left_semi")


def missing_files(papers: DataFrame, contexts: DataFrame) -> DataFrame:
    """Papers without a usable full text: the failure list."""
    return papers.join(contexts.where("pdf_found and pdf_extract_method != 'failed'").select("paper_id"), "paper_id", "left_anti")


def with_context(papers: DataFrame, contexts: DataFrame) -> DataFrame:
    """Every paper with its context columns, defaults where there is no file."""
    c = contexts.select("paper_id", "pdf_found", "pdf_extract_method", "full_text_chars", "paragraph_count", "matched_paragraph_count", "discussion_found", "extracted_context", "discussion_summary", "discussion_excerpt")
    j = papers.join(c, "paper_id", "left")
    blank = {k: F.coalesce(k, F.lit("")) for k in ("extracted_context", "discussion_summary", "discussion_excerpt")}
    zero = {k: F.coalesce(k, F.lit(0)) for k in ("full_text_chars", "paragraph_count", "matched_paragraph_count")}
    return j.withColumns({**blank, **zero, "pdf_found": F.coalesce("pdf_found", F.lit(False)), "discussion_found": F.coalesce("discussion_found", F.lit(False)), "pdf_extract_method": F.coalesce("pdf_extract_method", F.lit("missing"))})


def update_where(df: DataFrame, changes: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """``columns`` of the matching rows replaced by the non-null values of ``changes``; absent
    columns are added as ''."""
    have = [c for c in columns if c in df.columns]
    base = df.withColumns({c: F.lit("") for c in columns if c not in have})
    new = changes.select(*key, *[F.col(c).alias(f"_n_{c}") for c in columns])
    out = base.join(new, key, "left").withColumns({c: F.coalesce(f"_n_{c}", c) for c in columns})
    return out.drop(*[f"_n_{c}" for c in columns])


def rows_between(df: DataFrame, order: str, start: int, limit: int) -> DataFrame:
    """``limit`` rows from the ``start``-th (1-based) in ``order``."""
    return df.orderBy(order).offset(start - 1).limit(limit)


def first_candidates(candidates: DataFrame, key: str, value: str, priority: str) -> DataFrame:
    """Each key's values in order of priority, a repeated value only where it comes first."""
    best = candidates.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(key, value).agg(F.min(priority).alias(priority))
    place = F.row_number().over(W.partitionBy(key).orderBy(priority, value))
    return best.withColumn("place", place)


def coverage(contexts: DataFrame) -> DataFrame:
    """One row: papers, with file, with matched paragraphs, with a discussion."""
    n = lambda c: F.count_if(c)
    return contexts.agg(F.count(F.lit(1)).alias("papers"), n(F.coalesce("pdf_found", F.lit(False))).alias("found"), n(F.coalesce(F.col("matched_paragraph_count"), F.lit(0)) > 0).alias("matched"),
                        n(F.coalesce("discussion_found", F.lit(False))).alias("discussed"), F.sum(F.coalesce(F.col("full_text_chars"), F.lit(0)).cast("long")).alias("characters"))
