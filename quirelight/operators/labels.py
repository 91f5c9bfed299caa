"""Labels and summaries of clusters, made different from their siblings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirelight.operators.topics import phrase_roots

NOISE_LABEL = "Papers outside the clusters"


def hierarchical_label(form: str, contribution: str, secondary: str, subtype: str, move: str, domain: str) -> Column:
    """``Form: Contribution + Secondary - Subtype - Move | Primary Domain: Domain``; the
    subtype is left out for theoretical contributions, the move where not applicable."""
    cap = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 10_000))
    sec = F.when(F.coalesce(F.col(secondary), F.lit("")) != "", F.concat(F.lit(" + "), cap(F.col(secondary)))).otherwise("")
    sub = F.when((F.col(contribution) != "theoretical") & (F.coalesce(F.col(subtype), F.lit("")) != ""), F.concat(F.lit(" — "), F.col(subtype))).otherwise("")
    mov = F.when(~F.coalesce(F.col(move), F.lit("not_applicable")).isin("not_applicable", ""), F.concat(F.lit(" — "), cap(F.col(move)))).otherwise("")
    return F.concat(cap(F.col(form)), F.lit(": "), cap(F.col(contribution)), sec, sub, mov, F.lit(" | Primary Domain: "), cap(F.col(domain)))


def base_summary(n: str, contribution: str, domain: str, titles: str) -> Column:
    """Template sentences with the leading titles (an array)."""
    t = F.slice(titles, 1, 2)
    lead = F.when(F.size(t) > 0, F.concat(F.lit(" Representative papers: "), F.array_join(t, "; "), F.lit("."))).otherwise("")
    return F.concat(F.lit("This cluster holds "), F.col(n).cast("string"), F.when(F.col(n) == 1, " paper").otherwise(" papers"), F.lit(" with a mainly "), F.col(contribution), F.lit(" contribution in "), F.col(domain), F.lit("."), lead)


def unique_phrases(clusters: DataFrame, siblings: list[str], cluster: str, phrases: str) -> DataFrame:
    """(siblings, cluster, ``unique``): the phrases none of whose roots occurs in a sibling
    cluster's phrases. Only where there are two real clusters (0 and up) or more.

    A root's spread is a count per sibling set and root: clusters are never compared in pairs.
    """
    real = clusters.where(F.col(cluster) >= 0)
    many = real.groupBy(*siblings).agg(F.countDistinct(cluster).alias("_k")).where("_k >= 2").drop("_k")
    p = real.join(many, siblings, "left_semi").select(*siblings, cluster, F.explode(phrases).alias("phrase")).distinct()
    r = p.select(*siblings, cluster, "phrase", F.explode(phrase_roots(F.col("phrase"))).alias("root"))
    spread = r.groupBy(*siblings, "root").agg(F.countDistinct(cluster).alias("_n"))
    shared = r.join(spread, [*siblings, "root"]).groupBy(*siblings, cluster, "phrase").agg(F.max("_n").alias("_n"))
    return shared.groupBy(*siblings, cluster).agg(F.array_sort(F.collect_set(F.when(F.col("_n") == 1, F.col("phrase")))).alias("unique"))


def contrastive_summary(summary: Column, unique: Column, contribution: Column, majority: Column) -> Column:
    """The summary with what sets the cluster apart; unchanged if nothing does."""
    own = F.when(F.size(unique) > 0, F.concat(F.lit(" Unlike its siblings it treats "), F.array_join(F.slice(unique, 1, 3), ", "), F.lit("."))).otherwise("")
    kind = F.when(contribution != majority, F.concat(F.lit(" Most siblings are "), majority, F.lit("."))).otherwise("")
    return F.concat(summary, own, kind)


def suffix(domain: Column, terms: Column, generic: tuple[str, ...] = ("generic", "n/a", "")) -> Column:
    """What tells equal labels apart: the domain if it says something, else the first term."""
    return F.when(~F.coalesce(domain, F.lit("")).isin(*generic), domain).otherwise(F.coalesce(F.try_element_at(F.filter(terms, lambda t: F.trim(t) != ""), F.lit(1)), F.lit("")))


def facet_suffix(facets: list[Column], terms: Column, generic: tuple[str, ...] = ("generic", "n/a", "")) -> Column:
    """The first of ``facets`` (in their order: artifact, context, method) that says something;
    else the first evidence term of several words, else any."""
    usable = lambda c: F.when(~F.lower(F.trim(F.coalesce(c, F.lit("")))).isin(*generic), F.trim(c))
    named = F.filter(terms, lambda t: F.trim(t) != "")
    several = F.try_element_at(F.filter(named, lambda t: F.trim(t).contains(" ")), F.lit(1))
    return F.coalesce(*[usable(c) for c in facets], several, F.try_element_at(named, F.lit(1)), F.lit(""))


def qualified(df: DataFrame, siblings: list[str], label: str, action: str) -> Column:
    """Equal labels of siblings qualified by what their papers do: ``Label (action)``."""
    n = F.count(F.lit(1)).over(W.partitionBy(*siblings, label))
    return F.when((n > 1) & (F.coalesce(F.col(action), F.lit("")) != ""), F.concat(F.col(label), F.lit(" ("), F.col(action), F.lit(")"))).otherwise(F.col(label))


def noise_record(df: DataFrame, columns: list[str]) -> DataFrame:
    """The record of papers outside the clusters: a fixed label, ``n/a`` in all other texts."""
    return df.withColumns({c: F.lit(NOISE_LABEL if c == "label" else "n/a") for c in columns})


def distinct_labels(df: DataFrame, siblings: list[str], cluster: str, label: str, extra: str) -> DataFrame:
    """Adds ``final_label``: equal labels of siblings get `` around <suffix>``, each suffix
    once; a later cluster with the same suffix keeps the plain label."""
    n = F.count(F.lit(1)).over(W.partitionBy(*siblings, label))
    first = F.row_number().over(W.partitionBy(*siblings, label, extra).orderBy(cluster)) == 1
    return df.withColumn("final_label", F.when((n > 1) & first & (F.col(extra) != ""), F.concat(F.col(label), F.lit(" around "), F.col(extra))).otherwise(F.col(label)))


def numbered(cluster: Column, label: Column) -> Column:
    """``Cluster n: label``; noise has its own record."""
    return F.when(cluster == -1, F.lit(NOISE_LABEL)).otherwise(F.concat(F.lit("Cluster "), cluster.cast("string"), F.lit(": "), label))
