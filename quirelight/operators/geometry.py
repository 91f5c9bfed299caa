"""Cluster geometry: centroids, distances, ranks, silhouettes, without pairwise tables.

On unit vectors the mean cosine distance to a set is one minus the product with the set's
mean, so medoids and silhouettes need one sum vector per cluster instead of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirelight.operators.vectors import BROADCAST_CELLS, dot, mean_by_group, unit
from quirelight.session import materialise


def _small(df: DataFrame, cells: int) -> DataFrame:
    """Broadcast a table of clusters only while it is small; else Spark chooses."""
    return F.broadcast(df) if cells <= BROADCAST_CELLS else df


#: Rows of a group that one task may sort for their ranks.
RANK_LIMIT = 2_000_000


def ranks(df: DataFrame, group: str, orders: dict[str, list], largest: int) -> DataFrame:
    """Adds, for each name of ``orders``, the 1-based position within the group.

    Groups up to ``RANK_LIMIT`` rows are ranked by a window. A larger one is spread by range
    over many tasks: rows are numbered within their range and the counts of the ranges
    before are added, so no task sorts a whole group.
    """
    if largest <= RANK_LIMIT:
        return df.withColumns({k: F.row_number().over(W.partitionBy(group).orderBy(*o)) for k, o in orders.items()})
    for k, o in orders.items():
        parts = materialise(df.repartitionByRange(F.col(group), *[F.col(c) if isinstance(c, str) else c for c in o]).withColumn("_p", F.spark_partition_id()), "ranges")
        n = parts.groupBy("_p", group).agg(F.count(F.lit(1)).alias("_n"))
        before = n.select("_p", group, (F.sum("_n").over(W.partitionBy(group).orderBy("_p")) - F.col("_n")).alias("_b"))
        own = parts.withColumn("_r", F.row_number().over(W.partitionBy("_p", group).orderBy(*o)))
        df = own.join(before, ["_p", group]).withColumn(k, (F.col("_r") + F.col("_b")).cast("int")).drop("_p", "_r", "_b")
    return df


def cluster_sizes(df: DataFrame, cluster: str) -> DataFrame:
    n = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy(F.lit(0)))
    return n.withColumn("ratio", F.col("n") / total)


def centroids(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """(cluster, ``centroid`` of unit length, ``mean`` of the unit vectors, ``n``); noise (-1)
    and null clusters have none."""
    u = df.where(F.col(cluster).isNotNull() & (F.col(cluster).cast("string") != "-1")).select(cluster, unit(F.col(vector)).alias("u"))
    return mean_by_group(u, cluster, "u").withColumn("centroid", unit(F.col("mean")))


def with_geometry(df: DataFrame, key: str, cluster: str, vector: str) -> DataFrame:
    """(key, cluster, ``distance_to_centroid``, ``representative_rank``, ``medoid_rank``,
    ``is_representative_top3``).

    Ranks count from 1 by distance, equal distances by key; the top-3 flag holds for ranks 1
    to 3. Noise has rank -1, no distance and no flag; null clusters are left out. Medoid
    distances are means over the cluster, oneself included.
    """
    c = centroids(df, cluster, vector)
    known = df.where(F.col(cluster).isNotNull())
    held = c.agg(F.count(F.lit(1)), F.max("n")).first()
    cells = held[0] * 128
    j = known.select(key, cluster, unit(F.col(vector)).alias("u")).join(_small(c, cells), cluster, "left")
    dist = F.when(F.col("centroid").isNotNull(), 1 - dot(F.col("u"), F.col("centroid")))
    mean = F.when(F.col("mean").isNotNull(), 1 - dot(F.col("u"), F.col("mean")))
    d = j.select(key, cluster, dist.alias("distance_to_centroid"), F.round(dist, 9).alias("_d"), F.round(mean, 9).alias("_m"))
    noise = F.col(cluster).cast("string") == "-1"
    # noise has no ranks and is not sorted with the rest
    r = ranks(d.where(~noise), cluster, {"representative_rank": ["_d", key], "medoid_rank": ["_m", key]}, held[1] or 0)
    out = [key, cluster, "distance_to_centroid", "representative_rank", "medoid_rank"]
    none = d.where(noise).withColumns({"representative_rank": F.lit(-1), "medoid_rank": F.lit(-1)})
    return r.select(*out).unionByName(none.select(*out)).withColumn("is_representative_top3", F.col("representative_rank").between(1, 3))


def top_representatives(df: DataFrame, cluster: str, key: str, n: int) -> DataFrame:
    """The first ``n`` of each cluster by representative rank, then medoid rank, then key."""
    place = F.row_number().over(W.partitionBy(cluster).orderBy("representative_rank", "medoid_rank", key))
    return df.where(F.col("representative_rank") >= 1).withColumn("place", place).where(F.col("place") <= n)


def _means(c: DataFrame, cluster: str) -> tuple[list, np.ndarray, np.ndarray]:
    """The clusters' means on the driver: one row per cluster, checked against the limit."""
    rows = c.select(F.col(cluster).alias("_c"), "mean", "n").orderBy("_c").limit(BROADCAST_CELLS // 64 + 1).collect()
    if rows and len(rows) * len(rows[0]["mean"]) > BROADCAST_CELLS:
        raise ValueError("too many clusters to compare every row with all of them")
    return [r["_c"] for r in rows], np.array([r["mean"] for r in rows]), np.array([r["n"] for r in rows], float)


def silhouettes(df: DataFrame, key: str, cluster: str, vector: str) -> DataFrame:
    """(key, cluster, ``silhouette``) with cosine distance; a cluster of one has 0.

    One pass against the table of cluster means: a(i) and every b(i) are products with sums.
    With fewer than two clusters there are no rows.
    """
    schema = df.select(key, cluster).withColumn("silhouette", F.lit(0.0)).schema
    names, mean, n = _means(centroids(df, cluster, vector), cluster)
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], schema)
    held = df.sparkSession.sparkContext.broadcast(({c: i for i, c in enumerate(names)}, mean, n))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, m, size = held.value
        for pdf in batches:
            if len(pdf) == 0:
                continue
            u = np.stack(pdf["u"].to_numpy())
            own = pdf[cluster].map(at).to_numpy()
            d = 1.0 - u @ m.T
            rows = np.arange(len(u))
            k = size[own]
            a = (k * d[rows, own] - (1.0 - (u * u).sum(1))) / np.maximum(k - 1, 1)
            d[rows, own] = np.inf
            b = d.min(1)
            yield pd.DataFrame({key: pdf[key], cluster: pdf[cluster], "silhouette": np.where(k == 1, 0.0, (b - a) / np.maximum(a, b))})

    rows = df.where(F.col(cluster).isNotNull() & (F.col(cluster).cast("string") != "-1")).select(key, cluster, unit(F.col(vector)).alias("u"))
    return rows.mapInPandas(run, schema)


def selection_row(sil: DataFrame, cluster: str) -> DataFrame:
    """One row of the selection table: average, sizes, largest share, negative silhouettes."""
    per = sil.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.sum("silhouette").alias("s"), F.count_if(F.col("silhouette") < 0).alias("neg"))
    sizes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(cluster).alias("c"), F.col("n").alias("n")))), lambda x: F.concat(x["c"].cast("string"), F.lit(":"), x["n"].cast("string"))), "; ")
    total = F.sum("n")
    return per.agg(F.count(F.lit(1)).cast("int").alias("k"), (F.sum("s") / total).alias("average_silhouette"), F.min("n").alias("min_cluster_size"), F.max("n").alias("max_cluster_size"), (F.max("n") / total).alias("max_cluster_ratio"),
                   sizes.alias("cluster_sizes"), F.sum("neg").alias("negative_silhouette_count"), (F.sum("neg") / total).alias("negative_silhouette_ratio"))


def near_ties(table: DataFrame, absolute: float = 0.002, relative: float = 0.02) -> DataFrame:
    """Adds ``close_to_best`` and ``selected``: of all k close to the best score the smallest."""
    best = F.max("average_silhouette").over(W.partitionBy(F.lit(0)))
    close = F.col("average_silhouette") >= best - F.greatest(F.lit(absolute), F.lit(relative) * F.abs(best))
    t = table.withColumn("close_to_best", close)
    return t.withColumn("selected", F.col("k") == F.min(F.when(F.col("close_to_best"), F.col("k"))).over(W.partitionBy(F.lit(0))))


def nearest_cluster(df: DataFrame, key: str, cluster: str, vector: str) -> DataFrame:
    """(key, ``cluster``, ``peripheral``): noise moves to the cluster of the nearest mean by
    Euclidean distance, equal distances to the least cluster; without clusters all stays."""
    c = df.where(F.col(cluster).isNotNull() & (F.col(cluster).cast("string") != "-1")).select(cluster, F.col(vector).cast("array<double>").alias("v"))
    names, mean, _ = _means(mean_by_group(c, cluster, "v"), cluster)
    rows = df.where(F.col(cluster).isNotNull()).select(key, F.col(cluster).cast("int").alias("c"), F.col(vector).cast("array<double>").alias("v"))
    held = df.sparkSession.sparkContext.broadcast((np.array(names, int), mean))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, m = held.value
        for pdf in batches:
            out = pdf["c"].to_numpy().copy()
            far = out == -1
            if far.any() and len(ids):
                x = np.stack(pdf["v"].to_numpy()[far])
                d = np.stack([((x - row) ** 2).sum(1) for row in m], 1)
                out[far] = ids[np.round(d, 9).argmin(1)]
            yield pd.DataFrame({key: pdf[key], "cluster": out.astype(np.int32), "peripheral": far})

    return rows.mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, cluster int, peripheral boolean")
