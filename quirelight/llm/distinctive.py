"""Problem 1: how characteristic a term is of a record against all other records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelight.llm.papers import one_row_per_paper, with_text
from quirelight.session import materialise

#: At most this many terms can each hold more than 1/HEAVY of all (record, term) pairs.
HEAVY = 1000


def _xlx(c: Column) -> Column:
    return F.when(c > 0, c * F.log(c)).otherwise(F.lit(0.0))


def log_likelihood_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Dunning's G2 of the table [[a, b], [c, d]]; zero cells count as nothing."""
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    cells = _xlx(a) + _xlx(b) + _xlx(c) + _xlx(d) + _xlx(a + b + c + d)
    margins = _xlx(a + b) + _xlx(c + d) + _xlx(a + c) + _xlx(b + d)
    return F.lit(2.0) * (cells - margins)


def score_terms(counts: DataFrame, record: list[str], *, min_count: int = 1, min_records: int = 1,
                max_records: int | None = None) -> DataFrame:
    """Score every (record, term) of ``counts`` against the remaining collection.

    ``counts`` has the ``record`` columns, ``term`` and ``n`` (one row per record and term).
    Result: the record columns, ``term``, ``n``, ``n_records`` (records that hold the term)
    and ``g2``, positive when the term is commoner in the record than elsewhere and negative
    when rarer. ``min_count``, ``min_records`` and ``max_records`` restrict the rows returned;
    the totals always cover all rows. An empty input gives an empty result.

    Term totals are a partial aggregate. Terms that hold more than 1/1000 of all pairs
    (hence at most 1000 of them, whatever the size) take a broadcast join, so no reducer
    receives the rows of a stop word; all others a shuffle join.
    """
    counts = counts.where(F.col("term").isNotNull() & (F.col("n") > 0))
    stats = counts.groupBy("term").agg(F.count(F.lit(1)).alias("n_records"), F.sum("n").alias("_tt"))
    stats = materialise(stats, "terms")
    whole = stats.agg(F.sum("n_records"), F.sum("_tt")).first()
    pairs, total = whole[0] or 0, whole[1] or 0
    totals = counts.groupBy(*record).agg(F.sum("n").alias("_rt"))
    wanted = stats.where(F.col("n_records") >= min_records)
    if max_records is not None:
        wanted = wanted.where(F.col("n_records") <= max_records)
    heavy = F.col("n_records") > pairs / HEAVY
    left = counts.where(F.col("n") >= min_count)
    heavy_terms = F.broadcast(stats.where(heavy).select("term"))
    light = left.join(heavy_terms, "term", "left_anti").join(wanted.where(~heavy), "term")
    joined = light
    if max_records is None or max_records > pairs / HEAVY:
        joined = light.unionByName(left.join(F.broadcast(wanted.where(heavy)), "term"))
    joined = joined.join(totals, record)
    a = F.col("n")
    b, c = F.col("_rt") - a, F.col("_tt") - a
    d = F.lit(total) - F.col("_rt") - c
    g2 = log_likelihood_ratio(a, b, c, d)
    over = a * (c + d) >= c * (a + b)
    return joined.select(*record, "term", "n", "n_records", F.when(over, g2).otherwise(-g2).alias("g2"))


def letter_runs(text: Column) -> Column:
    """Maximal runs of three or more letters of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}{3,})"), 1)


def paper_term_counts(papers: DataFrame) -> DataFrame:
    """(record_kind, record_key, term, n) of the abstracts; blank abstracts have none.

    The rows arrive hashed by ``paper_id``, which also serves the count: one shuffle.
    """
    one = with_text(one_row_per_paper(papers, "abstract"), "abstract")
    words = one.select("paper_id", F.explode(letter_runs(F.col("abstract"))).alias("term"))
    counted = words.groupBy("paper_id", "term").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.lit("paper").alias("record_kind"), F.col("paper_id").alias("record_key"), "term", "n")


def cluster_term_counts(clusters: DataFrame) -> DataFrame:
    """(record_kind, record_key, term, n = 1) of the clusters 0 and up.

    Equal (cluster, list) rows are reduced before the shuffle, so a cluster that holds a
    third of all rows costs one row per distinct list. Null key parts count as ''.
    """
    keys = ["run_id", "text_view", "cluster_method", "cluster"]
    key = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    lists = clusters.where(F.col("cluster") >= 0).select(key.alias("record_key"), F.col("distinguishing_evidence_terms").alias("_l")).where("_l is not null").distinct()
    entry = F.trim(F.regexp_replace(F.lower(F.col("_e")), r"[\s\x{a0}]+", " "))
    terms = lists.select("record_key", F.explode(F.split("_l", ",")).alias("_e")).select("record_key", entry.alias("term"))
    terms = terms.where((F.col("term") != "") & (F.col("term") != "n/a")).distinct()
    return terms.select(F.lit("cluster").alias("record_kind"), "record_key", "term", F.lit(1).cast("long").alias("n"))


def distinctive_terms(papers: DataFrame, clusters: DataFrame, *, low: int = 2, high: int = 8, paper_count: int = 2) -> DataFrame:
    """Terms shared by ``low`` to ``high`` records, with their log-likelihood ratio.

    Papers: terms occurring at least ``paper_count`` times in the abstract.
    """
    p = score_terms(materialise(paper_term_counts(papers), "paper-terms"), ["record_kind", "record_key"], min_count=paper_count, min_records=low, max_records=high)
    c = score_terms(materialise(cluster_term_counts(clusters), "cluster-terms"), ["record_kind", "record_key"], min_records=low, max_records=high)
    # written with the scores, so that every reader of the terms takes them from the scored table
    return materialise(p.unionByName(c), "scored-terms")
