"""Row-wise operators over unbounded input. The analysis itself is a batch; preparation,
coding and relevance need no state and run unchanged on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelight.functions import text as X
from quirelight.operators import coding as Y
from quirelight.operators import contexts as C


def coded(papers: DataFrame) -> DataFrame:
    """Cleaned papers with canonical keywords, relevance and matching contribution rules."""
    low = F.lower(F.concat_ws(" ", X.text("title"), X.text("abstract")))
    rules = F.array_compact(F.array(*[F.when(Y.hits(F.col("low"), r.pattern) > 0, F.lit(f"{r.key}: {r.name}")) for r in Y.CONTRIBUTION.rules]))
    return papers.withColumn("low", low).select("paper_id", X.keyword_list(F.col("keyword")).alias("keywords"), X.relevance(F.col("low"), C.CONTEXT_TERMS).alias("relevance"), rules.alias("rules"), "loaded_at")


def first_seen(papers: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each ``paper_id`` once within the watermark: late repeats inside it are dropped."""
    return papers.withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(["paper_id"])


def arrivals(papers: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """(``day, keyword, n``): papers per time window and keyword, with a watermark."""
    k = papers.withWatermark("loaded_at", late).select("loaded_at", F.explode(X.keyword_list(F.col("keyword"))).alias("keyword"))
    return k.groupBy(F.window("loaded_at", window).alias("w"), "keyword").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("day"), "keyword", "n")
