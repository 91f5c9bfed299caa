"""k-means, DBSCAN, HDBSCAN, reduction and the choice among them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirelight.operators import geometry as G
from quirelight.operators.vectors import BROADCAST_CELLS, unit
from quirelight.session import materialise

#: Rows one task clusters whole; of larger groups HDBSCAN is fitted on this many rows by
#: hash, and every row is then assigned.
GROUP_LIMIT = 4000
#: Rows of a block of a larger group, whose pairs of blocks DBSCAN compares.
BLOCK = 1000


def kmeans_steps(df: DataFrame, key: str, vector: str, k: int, rounds: int = 5) -> DataFrame:
    """(key, ``cluster``): Lloyd's rounds from the ``k`` rows of least key; deterministic.

    A round sends k centres to the tasks and sums vectors per cluster with partial
    aggregation; equal distances go to the lower cluster.
    """
    rows = df.select(F.col(key), unit(F.col(vector)).alias("u"))
    first = rows.orderBy(key).limit(k).collect()
    if not first:
        return rows.select(key, F.lit(0).alias("cluster"))
    if k * len(first[0]["u"]) > BROADCAST_CELLS:
        raise ValueError("too many centres for this method")
    centres = np.array([r["u"] for r in first])
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()

    def assign(held) -> Callable:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            c = held.value
            for pdf in batches:
                x = np.stack(pdf["u"].to_numpy())
                d = ((x[:, None, :] - c[None]) ** 2).sum(2) if x.size * len(c) < 4_000_000 else (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None]
                yield pd.DataFrame({key: pdf[key], "cluster": np.round(d, 9).argmin(1).astype(np.int32)})

        return run

    def sums(held) -> Callable:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            c = held.value
            total, n = np.zeros_like(c), np.zeros(len(c))
            for pdf in batches:
                x = np.stack(pdf["u"].to_numpy())
                a = np.round(((x[:, None, :] - c[None]) ** 2).sum(2), 9).argmin(1)
                np.add.at(total, a, x)
                np.add.at(n, a, 1)
            yield pd.DataFrame({"cluster": np.arange(len(c)), "total": list(total), "n": n})

        return run

    for _ in range(rounds):
        held = spark.sparkContext.broadcast(centres)
        parts = rows.select("u").mapInPandas(sums(held), "cluster int, total array<double>, n double").collect()  # k rows per task
        total, n = np.zeros_like(centres), np.zeros(len(centres))
        for r in parts:
            total[r["cluster"]] += r["total"]
            n[r["cluster"]] += r["n"]
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return rows.mapInPandas(assign(spark.sparkContext.broadcast(centres)), f"`{key}` {kind}, cluster int")


def kmeans(df: DataFrame, key: str, vector: str, k: int, seeds: tuple[int, ...] = (42, 43, 44), rounds: int = 30) -> DataFrame:
    """(key, ``cluster``) of the cheapest of several seeded runs on unit vectors; under two
    clusters everything is cluster 0. The distributed k-means|| of Spark ML."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.select(key, array_to_vector(unit(F.col(vector))).alias("features"))
    if k < 2:
        return rows.select(key, F.lit(0).alias("cluster"))
    rows = rows.persist()
    models = [KMeans(k=k, seed=s, maxIter=rounds).fit(rows) for s in seeds]
    best = min(models, key=lambda m: m.summary.trainingCost)
    out = materialise(best.transform(rows).select(key, F.col("prediction").alias("cluster")), "kmeans")
    rows.unpersist()
    return out


def selection_table(df: DataFrame, key: str, vector: str, ks: range, rounds: int = 5) -> DataFrame:
    """The silhouette table over candidate numbers of clusters, near ties marked."""
    out = None
    for k in ks:
        labels = materialise(kmeans_steps(df, key, vector, k, rounds), "labels")
        row = G.selection_row(G.silhouettes(df.join(labels, key), key, "cluster", vector), "cluster").withColumn("k", F.lit(k))
        out = row if out is None else out.unionByName(row)
    return G.near_ties(out)


# --- k-means in every group at once ---


def _with_table(rows: DataFrame, per_group: DataFrame, run: Callable[[pd.DataFrame, pd.Series], pd.DataFrame], schema: str) -> DataFrame:
    """``run`` on every slice of a group's rows (``g, s``) with the group's one row of
    ``per_group``. A group of any size is many slices, so no task receives a whole one."""
    names = [c for c in per_group.columns if c != "g"]
    table = rows.select("g", "s").distinct().join(per_group, "g").select(F.col("g").alias("_g"), F.col("s").alias("_s"), *names)

    def both(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return run(left, right.iloc[0]) if len(left) and len(right) else pd.DataFrame(columns=[c.split(" ")[0] for c in schema.split(", ")])

    return rows.groupBy("g", "s").cogroup(table.groupBy("_g", "_s")).applyInPandas(both, schema)


def _packed_sums(parts: DataFrame, gk: str) -> DataFrame:
    """Sums of the packed arrays ``x`` per group, added in each task before the shuffle."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            for g, x in zip(pdf["g"], pdf["x"]):
                v = np.frombuffer(x)
                held[g] = held[g] + v if g in held else v
        yield pd.DataFrame({"g": pd.Series(list(held), dtype=object), "x": pd.Series([v.tobytes() for v in held.values()], dtype=object)})

    schema = f"g {gk}, x binary"
    return parts.mapInPandas(add, schema).repartition("g").mapInPandas(add, schema)


def kmeans_groups(df: DataFrame, group: str, key: str, vector: str, bounds: DataFrame, *, starts: int = 10, rounds: int = 10, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """k-means on unit vectors in every group, for every ``low <= k <= high`` of ``bounds``
    (group, ``low``, ``high``), the cheapest of ``starts`` runs each.

    Returns (group, key, ``clusters``, ``cluster``, ``silhouette``), silhouettes by cosine distance
    (a single row in its cluster has 0), and the selection table (group, ``clusters,
    average_silhouette, cost, min_cluster_size, max_cluster_size, close_to_best, selected``):
    of all k close to a group's best score the smallest is selected. Groups with ``high`` under
    2, or a single row, have k = 1.

    All groups, numbers of clusters and starts run in the same passes: a group is a key, and
    a pass costs its rows times all centres. Start s takes the rows of least hash with s.
    """
    gk, kk = df.schema[group].dataType.simpleString(), df.schema[key].dataType.simpleString()
    sizes = df.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    lim = sizes.join(bounds.select(F.col(group).alias("g"), "low", "high"), "g").select("g", "n", F.least(F.col("high"), F.col("n") - 1).cast("int").alias("high"), "low")
    lim = lim.select("g", "n", F.greatest(F.lit(1), F.when(F.col("high") < 2, 1).otherwise(F.least("low", "high"))).cast("int").alias("low"), F.greatest(F.lit(1), "high").cast("int").alias("high"))
    rows = df.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(key).alias("k"), unit(F.col(vector)).alias("v")).join(sizes, "g")
    rows = materialise(rows.select("g", "k", "v", F.pmod(F.xxhash64("k"), F.ceil(F.col("n") / GROUP_LIMIT)).cast("int").alias("s")), "k-rows")
    hashes = F.array(*[F.xxhash64(F.col("k"), F.lit(seed + i)) for i in range(starts)])

    def runs_of(t: pd.Series) -> list[tuple[int, int, int]]:
        """(k, start, first centre) of every run; centres of all runs stand below each other."""
        out, at = [], 0
        for k in range(int(t["low"]), int(t["high"]) + 1):
            for i in range(starts):
                out.append((k, i, at))
                at += k
        return out

    # the rows of least hash: few per slice, then few per group
    first = rows.select("g", "k", "v", "s", F.posexplode(hashes).alias("i", "h"))
    least = W.partitionBy("g", "s", "i").orderBy("h", "k")
    lead = first.join(lim.select("g", "high"), "g").withColumn("_p", F.row_number().over(least)).where("_p <= high").withColumn("_q", F.row_number().over(W.partitionBy("g", "i").orderBy("h", "k"))).where("_q <= high")
    lead = lead.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("i", "_q", "v"))).alias("lead"))

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t in pdf.to_dict("records"):
                v = {(r["i"], r["_q"]): np.asarray(r["v"], float) for r in t["lead"]}
                c = np.stack([v[i, q + 1] for k, i, _ in runs_of(t) for q in range(k)])
                out.append((t["g"], t["n"], t["low"], t["high"], c.tobytes()))
            yield pd.DataFrame(out, columns=["g", "n", "low", "high", "c"])

    schema = f"g {gk}, n long, low int, high int, c binary"
    table = materialise(lim.join(lead, "g").mapInPandas(begin, schema), "k-start")

    def assigned(x: np.ndarray, c: np.ndarray, k: int, at: int) -> tuple[np.ndarray, float]:
        own = c[at : at + k]
        d = (own**2).sum(1)[None, :] - 2.0 * x @ own.T
        lab = np.round(d, 12).argmin(1)
        return lab, float(len(x) + d[np.arange(len(x)), lab].sum())

    def sums(pdf: pd.DataFrame, t: pd.Series) -> pd.DataFrame:
        x = np.stack(pdf["v"].to_numpy())
        c = np.frombuffer(t["c"]).reshape(-1, x.shape[1])
        out = np.zeros((len(c), x.shape[1] + 2))  # summed vectors, count, cost of the run at its first centre
        for k, _, at in runs_of(t):
            lab, cost = assigned(x, c, k, at)
            one = np.zeros((len(x), k))
            one[np.arange(len(x)), lab] = 1.0
            out[at : at + k, :-2] = one.T @ x
            out[at : at + k, -2] = one.sum(0)
            out[at, -1] = cost
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "x": [out.tobytes()]})

    def moved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            c = []
            for old, x in zip(pdf["c"], pdf["x"]):
                a = np.frombuffer(x)
                width = len(old) // 8
                m = len(a) - width  # two more columns per centre
                dims = 2 * width // m
                a, o = a.reshape(-1, dims + 2), np.frombuffer(old).reshape(-1, dims)
                c.append(np.where(a[:, -2:-1] > 0, a[:, :-2] / np.maximum(a[:, -2:-1], 1), o).tobytes())
            yield pd.DataFrame({"g": pdf["g"], "n": pdf["n"], "low": pdf["low"], "high": pdf["high"], "c": c})

    for _ in range(rounds):
        total = _packed_sums(_with_table(rows, table, sums, f"g {gk}, x binary"), gk)
        table = materialise(table.join(total, "g").mapInPandas(moved, schema), "k-centres")
    last = materialise(table.join(_packed_sums(_with_table(rows, table, sums, f"g {gk}, x binary"), gk), "g"), "k-last")

    def label(pdf: pd.DataFrame, t: pd.Series) -> pd.DataFrame:
        x = np.stack(pdf["v"].to_numpy())
        c, a = np.frombuffer(t["c"]).reshape(-1, x.shape[1]), np.frombuffer(t["x"]).reshape(-1, x.shape[1] + 2)
        best: dict[int, tuple[float, int]] = {}
        for k, i, at in runs_of(t):
            best[k] = min(best.get(k, (np.inf, 0)), (round(a[at, -1], 9), at))
        out = []
        for k, (cost, at) in best.items():
            lab, _ = assigned(x, c, k, at)
            total, n = a[at : at + k, :-2], a[at : at + k, -2]
            d = 1.0 - x @ (total / np.maximum(n, 1)[:, None]).T
            d[:, n == 0] = np.inf
            r = np.arange(len(x))
            size = n[lab]
            inner = (size * d[r, lab] - (1.0 - (x * x).sum(1))) / np.maximum(size - 1, 1)
            d[r, lab] = np.inf
            outer = d.min(1)
            sil = np.where((size == 1) | ~np.isfinite(outer), 0.0, (outer - inner) / np.maximum(np.maximum(inner, outer), 1e-12))
            out.append(pd.DataFrame({"g": pdf["g"].to_numpy(), "k": pdf["k"].to_numpy(), "clusters": k, "cluster": lab.astype(np.int32), "silhouette": sil, "cost": cost}))
        return pd.concat(out, ignore_index=True)

    done = materialise(_with_table(rows, last, label, f"g {gk}, k {kk}, clusters int, cluster int, silhouette double, cost double"), "k-labels")
    per = done.groupBy("g", "clusters", "cluster").agg(F.count(F.lit(1)).alias("m"), F.sum("silhouette").alias("s"), F.max("cost").alias("cost"))
    chosen = per.groupBy("g", "clusters").agg((F.sum("s") / F.sum("m")).alias("average_silhouette"), F.max("cost").alias("cost"), F.min("m").alias("min_cluster_size"), F.max("m").alias("max_cluster_size"))
    best = F.max("average_silhouette").over(W.partitionBy("g"))
    chosen = chosen.withColumn("close_to_best", F.col("average_silhouette") >= best - F.greatest(F.lit(0.002), 0.02 * F.abs(best)))
    chosen = chosen.withColumn("selected", F.col("clusters") == F.min(F.when(F.col("close_to_best"), F.col("clusters"))).over(W.partitionBy("g")))
    return (done.select(F.col("g").alias(group), F.col("k").alias(key), "clusters", "cluster", "silhouette"),
            chosen.select(F.col("g").alias(group), "clusters", "average_silhouette", "cost", "min_cluster_size", "max_cluster_size", "close_to_best", "selected"))


def soft_groups(df: DataFrame, group: str, key: str, cluster: str, vector: str) -> DataFrame:
    """(group, key, ``cluster``, ``peripheral``): in every group noise moves to the cluster of
    the nearest mean by Euclidean distance, equal distances to the least cluster; in a group
    without clusters all stays."""
    gk, kk = df.schema[group].dataType.simpleString(), df.schema[key].dataType.simpleString()
    rows = df.where(F.col(cluster).isNotNull()).select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(cluster).cast("int").alias("c"), F.col(vector).cast("array<double>").alias("v"))
    n = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(n, "g").select("g", "k", "c", "v", F.pmod(F.xxhash64("k"), F.ceil(F.col("n") / GROUP_LIMIT)).cast("int").alias("s"))
    named = rows.where("c >= 0").select(F.struct("g", "c").alias("gc"), "v")
    means = G.mean_by_group(named, "gc", "v").groupBy(F.col("gc.g").alias("g")).agg(F.sort_array(F.collect_list(F.struct(F.col("gc.c").alias("c"), "mean"))).alias("means"))

    def move(pdf: pd.DataFrame, t: pd.Series) -> pd.DataFrame:
        out = pdf["c"].to_numpy().copy()
        far = out == -1
        if far.any():
            ids, m = np.array([r["c"] for r in t["means"]], int), np.stack([np.asarray(r["mean"], float) for r in t["means"]])
            x = np.stack(pdf["v"].to_numpy()[far])
            out[far] = ids[np.round(np.stack([((x - row) ** 2).sum(1) for row in m], 1), 9).argmin(1)]
        return pd.DataFrame({"g": pdf["g"], "k": pdf["k"], "cluster": out.astype(np.int32), "peripheral": far})

    schema = f"g {gk}, k {kk}, cluster int, peripheral boolean"
    moved = _with_table(rows, means, move, schema)
    alone = rows.join(means.select("g"), "g", "left_anti").select("g", "k", F.col("c").alias("cluster"), (F.col("c") == -1).alias("peripheral"))
    return moved.unionByName(alone).select(F.col("g").alias(group), F.col("k").alias(key), "cluster", "peripheral")


# --- density ---


def _dbscan_labels(x: np.ndarray, eps: float, least: int) -> np.ndarray:
    """Labels of one group, by cosine distance; clusters numbered by their first core row,
    border rows to the lowest cluster in reach. Rows are visited in blocks."""
    n = len(x)
    near = [np.flatnonzero(1.0 - x[i] @ x.T <= eps + 1e-12) for i in range(n)]
    core = np.array([len(v) >= least for v in near])
    label = np.full(n, -1, np.int32)
    c = 0
    for i in range(n):
        if core[i] and label[i] == -1:
            label[i], stack = c, [i]
            while stack:
                for j in near[stack.pop()]:
                    if core[j] and label[j] == -1:
                        label[j] = c
                        stack.append(int(j))
            c += 1
    for i in range(n):
        if not core[i]:
            around = [label[j] for j in near[i] if core[j]]
            label[i] = min(around) if around else -1
    return label


def auto_eps(x: np.ndarray, least: int) -> float:
    """The radius among five quantiles of the k-th neighbour distance that gives 2 to 20
    clusters with noise near 15 %; the 0.55 quantile if none does."""
    n = len(x)
    d = 1.0 - x @ x.T
    kth = np.sort(d, axis=1)[:, min(least, n - 1)]
    best, chosen = -1.0, float(np.quantile(kth, 0.55))
    for q in (0.35, 0.45, 0.55, 0.65, 0.75):
        eps = float(np.quantile(kth, q))
        label = _dbscan_labels(x, eps, least)
        k = int(label.max()) + 1
        score = k - 4 * abs(float((label == -1).mean()) - 0.15)
        if 2 <= k <= 20 and score > best:
            best, chosen = score, eps
    return chosen


def _hdbscan_labels(x: np.ndarray, least_size: int, least: int) -> np.ndarray:
    """HDBSCAN: mutual reachability, its minimum spanning tree, the condensed tree and the
    clusters of greatest excess of mass; the root is never a cluster."""
    n = len(x)
    if n < 2 * least_size:
        return np.full(n, -1, np.int32)
    d = np.sqrt(np.maximum(((x[:, None, :] - x[None]) ** 2).sum(2) if n * n * x.shape[1] < 30_000_000 else (x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T, 0))
    core = np.sort(d, axis=1)[:, min(least, n) - 1]
    m = np.maximum(np.maximum(core[:, None], core[None]), d)
    gap, link, seen = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool)
    at, edges = 0, []
    for _ in range(n - 1):
        seen[at] = True
        better = (m[at] < gap) & ~seen
        gap[better], link[better] = m[at][better], at
        nxt = int(np.where(seen, np.inf, gap).argmin())
        edges.append((float(gap[nxt]), int(link[nxt]), nxt))
        at = nxt
    edges.sort()
    parent = list(range(2 * n - 1))
    size, children, height = [1] * n + [0] * (n - 1), {}, {}

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for i, (w, a, b) in enumerate(edges):
        ra, rb, new = find(a), find(b), n + i
        parent[ra] = parent[rb] = new
        size[new] = size[ra] + size[rb]
        children[new], height[new] = (ra, rb), w

    def leaves(node: int) -> list[int]:
        out, stack = [], [node]
        while stack:
            v = stack.pop()
            if v < n:
                out.append(v)
            else:
                stack += children[v]
        return out

    # condensed clusters: (birth level, total stability, child clusters, members)
    clusters: list[dict] = []

    def grow(node: int, birth: float) -> int:
        me = len(clusters)
        clusters.append({"stability": 0.0, "kids": [], "rows": leaves(node), "top": node})
        while True:
            if node < n:
                break
            lam = 1.0 / max(height[node], 1e-12)
            a, b = children[node]
            big = [v for v in (a, b) if size[v] >= least_size]
            if len(big) == 2:
                clusters[me]["stability"] += (lam - birth) * size[node]
                clusters[me]["kids"] = [grow(v, lam) for v in big]
                break
            if len(big) == 1:
                other = b if big[0] == a else a
                clusters[me]["stability"] += (lam - birth) * size[other]
                node = big[0]
            else:
                clusters[me]["stability"] += (lam - birth) * size[node]
                break
        return me

    import sys

    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
    grow(2 * n - 2, 0.0)
    chosen: set[int] = set()

    def best(i: int) -> float:
        kids = clusters[i]["kids"]
        below = sum(best(k) for k in kids)
        if i != 0 and (not kids or clusters[i]["stability"] >= below):
            drop = list(kids)
            while drop:
                k = drop.pop()
                chosen.discard(k)
                drop += clusters[k]["kids"]
            chosen.add(i)
            return clusters[i]["stability"]
        return below

    best(0)
    label = np.full(n, -1, np.int32)
    for c, i in enumerate(sorted(chosen, key=lambda i: min(clusters[i]["rows"]))):
        label[clusters[i]["rows"]] = c
    return label


def _reduce(x: np.ndarray, dims: int) -> np.ndarray:
    """Principal coordinates: the documented stand-in for a neighbour embedding, behind the
    same interface (deterministic, no extra package)."""
    if len(x) <= 10 or x.shape[1] <= dims:
        return x
    c = x - x.mean(0)
    _, _, v = np.linalg.svd(c, full_matrices=False)
    v = v[:dims] * np.sign(v[:dims][np.arange(min(dims, len(v))), np.abs(v[:dims]).argmax(1)])[:, None]
    return c @ v.T


def _method(name: str, eps: float | None, least: int, least_size: int, dims: int) -> Callable[[np.ndarray], np.ndarray]:
    if name == "dbscan":
        return lambda x: _dbscan_labels(x, auto_eps(x, least) if eps is None else eps, least)
    if name == "hdbscan":
        return lambda x: _hdbscan_labels(_reduce(x, dims), least_size, least)
    raise ValueError(f"unknown method {name!r}: dbscan, hdbscan or kmeans")


def _dbscan_large(rows: DataFrame, eps: float | None, least: int, limit: int) -> DataFrame:
    """(``g``, ``k``, ``cluster``): exact DBSCAN of groups of any size, numbered as by
    ``_dbscan_labels``. Pairs within the radius come from pairs of blocks of at most about
    ``BLOCK`` rows; connected core rows are found by least labels, spread over frames."""
    gk, kk = rows.schema["g"].dataType.simpleString(), rows.schema["k"].dataType.simpleString()
    if eps is None:
        radius = rows.where(F.col("_h") < limit).groupBy("g").applyInPandas(lambda p: pd.DataFrame({"g": p["g"].iloc[:1], "eps": [auto_eps(np.stack(p.sort_values("k")["v"].to_numpy()), least)]}), f"g {gk}, eps double")
        rows = rows.join(materialise(radius, "radius"), "g")
    else:
        rows = rows.withColumn("eps", F.lit(float(eps)))
    blocks = F.ceil(F.col("n") / F.lit(float(BLOCK)))
    rows = materialise(rows.withColumns({"bs": blocks.cast("int"), "b": F.pmod(F.xxhash64("k", F.lit(11)), blocks).cast("int")}), "blocked")
    # each row goes once to every pair of blocks that its block is in
    every = F.explode(F.sequence(F.lit(0), F.col("bs") - 1))
    sent = rows.select("g", "k", "v", "eps", "b", every.alias("o")).select("g", "k", "v", "eps", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["b"] == pdf["i"]], pdf[pdf["b"] == pdf["j"]]
        if len(left) == 0 or len(right) == 0:
            return pd.DataFrame({"g": pdf["g"].iloc[:0], "a": pdf["k"].iloc[:0], "b": pdf["k"].iloc[:0]})
        x, y = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
        at, to = np.nonzero(1.0 - x @ y.T <= pdf["eps"].iloc[0] + 1e-12)
        a, b = left["k"].to_numpy()[at], right["k"].to_numpy()[to]
        if pdf["i"].iloc[0] != pdf["j"].iloc[0]:
            a, b = np.concatenate([a, b]), np.concatenate([b, a])
        return pd.DataFrame({"g": pdf["g"].iloc[0], "a": a, "b": b})

    pairs = materialise(sent.groupBy("g", "i", "j").applyInPandas(near, f"g {gk}, a {kk}, b {kk}"), "near")
    core = materialise(pairs.groupBy("g", "a").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least).select("g", "a"), "core")
    inner = materialise(pairs.join(core, ["g", "a"], "left_semi").join(core.withColumnRenamed("a", "b"), ["g", "b"], "left_semi"), "core-pairs")
    label = materialise(core.select("g", "a", F.col("a").alias("root")), "roots")
    while True:
        step = inner.join(label.withColumnRenamed("a", "b"), ["g", "b"]).groupBy("g", "a").agg(F.min("root").alias("new")).join(label, ["g", "a"])
        up = label.select("g", F.col("a").alias("new"), F.col("root").alias("up"))
        nxt = materialise(step.join(up, ["g", "new"]).select("g", "a", F.col("root").alias("old"), F.least("new", "up").alias("root")), "roots")
        label = nxt.select("g", "a", "root")
        if nxt.where("old != root").limit(1).count() == 0:
            break
    # one row per cluster is ranked, in its group
    number = label.select("g", "root").distinct().withColumn("cluster", (F.row_number().over(W.partitionBy("g").orderBy("root")) - 1).cast("int"))
    of_core = label.join(number, ["g", "root"]).select("g", F.col("a").alias("k"), "cluster")
    border = pairs.join(core, ["g", "a"], "left_anti").join(of_core.withColumnRenamed("k", "b"), ["g", "b"]).groupBy("g", F.col("a").alias("k")).agg(F.min("cluster").alias("cluster"))
    return rows.select("g", "k").join(of_core.unionByName(border), ["g", "k"], "left").select("g", "k", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def density_clusters(df: DataFrame, group: str, key: str, vector: str, method: str, *, eps: float | None = None, min_samples: int = 4, min_cluster_size: int = 5, dims: int = 5, limit: int = GROUP_LIMIT) -> DataFrame:
    """(group, key, ``cluster``): DBSCAN or HDBSCAN in each group; noise is -1.

    A group of up to ``limit`` rows is one task's work. A larger one is clustered by DBSCAN
    over all its rows, in blocks; only a radius that is not given is chosen on ``limit`` rows,
    taken by hash. By HDBSCAN ``limit`` rows of it, taken by hash, are clustered, and its other
    rows take the cluster of the nearest of these if it is no farther than the cluster's own
    rows are from their ``min_samples``-th neighbours, at most; else they are noise. Groups are
    salted for that step.
    """
    run = _method(method, eps, min_samples, min_cluster_size, dims)
    gk, kk = df.schema[group].dataType.simpleString(), df.schema[key].dataType.simpleString()
    rows = df.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(key).alias("k"), unit(F.col(vector)).alias("v"))
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(sizes, "g").withColumn("_h", F.pmod(F.xxhash64("k"), F.lit(1 << 30)) / F.lit(float(1 << 30)) * F.col("n"))
    fit = rows.where(F.col("_h") < limit)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        return pd.DataFrame({"g": pdf["g"], "k": pdf["k"], "cluster": run(np.stack(pdf["v"].to_numpy())), "v": pdf["v"]})

    if method == "dbscan":  # large groups take another way, below
        fit = fit.where(F.col("n") <= limit)
    done = fit.select("g", "k", "v").groupBy("g").applyInPandas(one, f"g {gk}, k {kk}, cluster int, v array<double>")
    done = materialise(done, "density")
    rest = rows.where(F.col("_h") >= limit)
    if rest.limit(1).count() == 0:
        return done.select(F.col("g").alias(group), F.col("k").alias(key), "cluster")
    if method == "dbscan":
        whole = done.join(sizes.where(F.col("n") > limit), "g", "left_anti").select("g", "k", "cluster")
        more = _dbscan_large(rows.where(F.col("n") > limit).select("g", "k", "v", "n", "_h"), eps, min_samples, limit)
        return whole.unionByName(more).select(F.col("g").alias(group), F.col("k").alias(key), "cluster")
    salts = 16

    def assign(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) == 0 or len(right) == 0:
            return pd.DataFrame({"g": left["g"], "k": left["k"], "cluster": np.full(len(left), -1, np.int32)})
        y, lab = np.stack(right["v"].to_numpy()), right["cluster"].to_numpy()
        near = min(min_samples, len(y) - 1)
        core = np.concatenate([np.partition(1.0 - y[i : i + 1024] @ y.T, near, axis=1)[:, near] for i in range(0, len(y), 1024)])
        reach = np.array([core[lab == c].max() for c in range(lab.max() + 1)] + [np.inf])  # noise stays noise
        out = []
        for i in range(0, len(left), 1024):
            dist = 1.0 - np.stack(left["v"].iloc[i : i + 1024].to_numpy()) @ y.T
            j = dist.argmin(1)
            out.append(np.where(dist[np.arange(len(j)), j] <= reach[lab[j]] + 1e-12, lab[j], -1))
        return pd.DataFrame({"g": left["g"], "k": left["k"], "cluster": np.concatenate(out).astype(np.int32)})

    # fitted rows of large groups, at most ``limit`` each, are copied to every salt
    large = done.join(sizes.where(F.col("n") > limit).select("g"), "g", "left_semi").withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rest.select("g", "k", "v", F.pmod(F.xxhash64("k", F.lit(7)), F.lit(salts)).cast("int").alias("s"))
    more = salted.groupBy("g", "s").cogroup(large.groupBy("g", "s")).applyInPandas(assign, f"g {gk}, k {kk}, cluster int")
    return done.select("g", "k", "cluster").unionByName(more).select(F.col("g").alias(group), F.col("k").alias(key), "cluster")


def layout(df: DataFrame, key: str, vector: str, dims: int = 2) -> DataFrame:
    """(key, ``x``, ``y``): plane coordinates by the two leading principal axes, from Spark
    ML's distributed PCA."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.select(key, array_to_vector(unit(F.col(vector))).alias("f"))
    p = PCA(k=dims, inputCol="f", outputCol="p").fit(rows).transform(rows)
    return p.select(key, vector_to_array("p")[0].alias("x"), vector_to_array("p")[1].alias("y"))


def cluster(df: DataFrame, group: str, key: str, vector: str, method: str, k: int = 6, **options) -> DataFrame:
    """(group, key, ``cluster``) by ``kmeans`` with ``k`` clusters in every group, ``dbscan``, or
    ``hdbscan`` with noise moved to the nearest cluster."""
    if method == "kmeans":
        bounds = df.select(group).distinct().select(group, F.lit(k).alias("low"), F.lit(k).alias("high"))
        return kmeans_groups(df, group, key, vector, bounds)[0].select(group, key, "cluster")
    found = density_clusters(df, group, key, vector, method, **options)
    if method == "dbscan":
        return found
    found = materialise(found, "density")
    return soft_groups(df.select(group, key, vector).join(found, [group, key]), group, key, "cluster", vector).select(group, key, "cluster")
