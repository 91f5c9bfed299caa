"""Clustering and geometry on small vectors with known answers."""

import numpy as np
import pandas as pd
import pytest

from quirelight.operators import clustering as K
from quirelight.operators import geometry as G
from quirelight.operators import vectors as V


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(1)
    rows = []
    for c, mid in enumerate(np.eye(5)[:3]):
        rows += [(len(rows) + i, "g", [float(x) for x in mid + rng.normal(0, 0.05, 5)], c) for i in range(12)]
    rows += [(len(rows) + i, "g", [float(x) for x in v], -1) for i, v in enumerate(np.eye(5)[3:])]
    return spark.createDataFrame(rows, "id long, g string, v array<double>, label int")


def agree(pdf, a, b):
    """Same partition up to names, on rows whose truth is a cluster."""
    p = pdf[pdf[b] >= 0]
    return (p.groupby(b)[a].nunique() == 1).all() and p.groupby(b)[a].first().nunique() == p[b].nunique()


def test_dbscan_and_hdbscan_find_the_blobs(blobs):
    for method, o in (("dbscan", {"eps": 0.1}), ("hdbscan", {})):
        got = K.density_clusters(blobs, "g", "id", "v", method, **o).join(blobs.select("id", "label"), "id").toPandas()
        assert agree(got, "cluster", "label") and len(got) == blobs.count()
        if method == "dbscan":
            assert (got[got.label == -1].cluster == -1).all()


def test_auto_eps_and_large_groups(blobs):
    x = np.array([r["v"] for r in blobs.orderBy("id").collect()])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert 0 < K.auto_eps(x, 4) < 1
    got = K.density_clusters(blobs, "g", "id", "v", "dbscan", eps=0.1, limit=30).join(blobs.select("id", "label"), "id").toPandas()
    assert len(got) == 38 and agree(got[got.label >= 0], "cluster", "label")


def test_large_groups_are_clustered_whole(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 40)
    rng = np.random.default_rng(4)
    at = rng.normal(size=(4, 5))
    x = np.concatenate([at[i] + rng.normal(0, 0.03, (n, 5)) for i, n in enumerate((70, 60, 6, 5))] + [rng.normal(size=(15, 5))])
    df = spark.createDataFrame([("g", i, v.tolist()) for i, v in enumerate(x)], "g string, id long, v array<double>")
    want = K._dbscan_labels(x / np.linalg.norm(x, axis=1, keepdims=True), 0.01, 4)
    got = K.density_clusters(df, "g", "id", "v", "dbscan", eps=0.01, limit=50).orderBy("id").toPandas()
    assert want.max() >= 3 and (want == -1).any() and list(got.cluster) == list(want)


def test_kmeans_variants(blobs):
    real = blobs.where("label >= 0")
    for lab in (K.kmeans_steps(real.orderBy("label"), "id", "v", 3, 5), K.kmeans(real, "id", "v", 3)):
        assert lab.count() == 36
    assert agree(K.kmeans(real, "id", "v", 3).join(real.select("id", "label"), "id").toPandas(), "cluster", "label")
    assert K.kmeans(real, "id", "v", 1).select("cluster").distinct().count() == 1


def test_geometry_matches_brute_force(blobs):
    got = G.with_geometry(blobs, "id", "label", "v").toPandas().set_index("id").sort_index()
    pdf = blobs.toPandas().set_index("id").sort_index()
    u = np.stack(pdf.v)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for c in (0, 1, 2):
        rows = np.flatnonzero(pdf.label == c)
        mean = (1 - u[rows] @ u[rows].T).mean(1)
        order = np.argsort(np.round(mean, 9), kind="stable")
        assert got.iloc[rows].medoid_rank.tolist() == (np.argsort(order) + 1).tolist()
        assert sorted(got.iloc[rows].representative_rank) == list(range(1, 13))
    noise = got[pdf.label == -1]
    assert (noise.representative_rank == -1).all() and not noise.is_representative_top3.any() and noise.distance_to_centroid.isna().all()


def test_silhouettes_match_brute_force(blobs):
    real = blobs.where("label >= 0")
    got = G.silhouettes(real, "id", "label", "v").toPandas().set_index("id").silhouette.sort_index()
    pdf = real.toPandas().sort_values("id")
    u = np.stack(pdf.v)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    d, lab = 1 - u @ u.T, pdf.label.to_numpy()
    for i in range(len(d)):
        own = lab == lab[i]
        a = d[i][own].sum() / (own.sum() - 1)
        b = min(d[i][lab == k].mean() for k in set(lab) - {lab[i]})
        assert got.iloc[i] == pytest.approx((b - a) / max(a, b), abs=1e-9)


def test_near_ties_take_the_smallest(spark):
    t = spark.createDataFrame([(2, 0.099), (3, 0.1), (4, 0.05)], "k int, average_silhouette double")
    assert [r["k"] for r in G.near_ties(t).where("selected").collect()] == [2]


def test_noise_moves_to_nearest_and_all_noise_stays(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0], 0), (2, [1.0, 1.0], 1), (3, [0.9, 1.0], -1)], "id long, v array<double>, c int")
    assert {r["id"]: r["cluster"] for r in G.nearest_cluster(df, "id", "c", "v").collect()} == {1: 0, 2: 1, 3: 1}
    assert [r["cluster"] for r in G.nearest_cluster(df.where("c = -1"), "id", "c", "v").collect()] == [-1]


def test_nearest_against_brute_force(blobs):
    got = V.nearest(blobs.where("id % 10 = 0"), blobs, "id", "v", 3).toPandas()
    pdf = blobs.toPandas().sort_values("id")
    u = np.stack(pdf.v)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for q, part in got.groupby("query"):
        d = 1 - u @ u[q]
        d[q] = 9
        assert part.sort_values("place").neighbour.tolist() == np.argsort(np.round(d, 12), kind="stable")[:3].tolist()


def test_empty_inputs(spark, blobs):
    none = blobs.limit(0)
    assert G.with_geometry(none, "id", "label", "v").count() == 0
    assert G.silhouettes(none, "id", "label", "v").count() == 0
    assert V.nearest(none, blobs, "id", "v", 2).count() == 0
    assert K.density_clusters(none, "g", "id", "v", "dbscan", eps=0.1).count() == 0


def test_ranks_by_range_equal_ranks_by_window(spark, blobs, monkeypatch):
    want = sorted(map(tuple, G.with_geometry(blobs, "id", "label", "v").select("id", "representative_rank", "medoid_rank").collect()))
    monkeypatch.setattr(G, "RANK_LIMIT", 5)
    assert sorted(map(tuple, G.with_geometry(blobs, "id", "label", "v").select("id", "representative_rank", "medoid_rank").collect())) == want


def test_kmeans_in_every_group(spark, monkeypatch):
    monkeypatch.setattr(K, "GROUP_LIMIT", 25)  # several slices a group
    rng = np.random.default_rng(5)
    rows = []
    for g, n in (("a", 2), ("b", 3), ("c", 4)):
        for c in range(n):
            rows += [(g, f"{g}{c}-{i}", c, [float(x) for x in np.eye(6)[c] + rng.normal(0, 0.05, 6)]) for i in range(15)]
    rows += [("one", "x", 0, [1.0] * 6), ("two", "y", 0, [1.0] * 6), ("two", "z", 0, [1.0] + [0.0] * 5)]
    df = spark.createDataFrame(rows, "g string, id string, label int, v array<double>")
    bounds = spark.createDataFrame([(g, 2, 5) for g in ("a", "b", "c", "one", "two")], "g string, low int, high int")
    labels, table = K.kmeans_groups(df, "g", "id", "v", bounds, rounds=6)
    picked = {r["g"]: r["clusters"] for r in table.where("selected").collect()}
    assert picked == {"a": 2, "b": 3, "c": 4, "one": 1, "two": 1}
    got = labels.join(table.where("selected").select("g", "clusters"), ["g", "clusters"]).join(df.select("id", "label", "v"), "id").toPandas()
    for _, x in got.groupby("g"):
        assert x.groupby("label").cluster.nunique().max() == 1 and x.cluster.nunique() == x.label.nunique()
    one = got[got.g == "b"]
    want = {r["id"]: r["silhouette"] for r in G.silhouettes(spark.createDataFrame(one[["id", "cluster", "v"]]), "id", "cluster", "v").collect()}
    assert all(abs(want[i] - s) < 1e-9 for i, s in zip(one.id, one.silhouette))


def test_noise_moves_within_its_group(spark):
    rows = [("a", "1", 0, [0.0, 0.0]), ("a", "2", 1, [4.0, 0.0]), ("a", "3", -1, [3.0, 0.0]), ("b", "4", -1, [0.0, 1.0]), ("b", "5", -1, [0.0, 2.0]), ("c", "6", 2, [3.0, 0.0])]
    df = spark.createDataFrame(rows, "g string, id string, cluster int, v array<double>")
    got = {r["id"]: (r["cluster"], r["peripheral"]) for r in K.soft_groups(df, "g", "id", "cluster", "v").collect()}
    assert got == {"1": (0, False), "2": (1, False), "3": (1, True), "4": (-1, True), "5": (-1, True), "6": (2, False)}


def test_svd_of_eight_thousand_terms(spark):
    rng = np.random.default_rng(1)
    x = np.zeros((150, 8000))
    for i in range(150):
        x[i, rng.choice(8000, 80, replace=False)] = rng.random(80)
        x[i, (i % 5) * 40 : (i % 5) * 40 + 40] += 1.0
    x[0, x.sum(0) == 0] = 0.01  # every term occurs
    cells = [(f"r{i:03}", f"t{j:04}", float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    df = spark.createDataFrame(pd.DataFrame(cells, columns=["k", "term", "w"]))
    got = {r["k"]: np.array(r["vector"]) for r in V.svd_features(df, "k", 5).collect()}
    y = x @ np.linalg.svd(x, full_matrices=False)[2][:5].T
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    mine = np.stack([got[f"r{i:03}"] for i in range(150)])
    assert np.allclose(mine @ mine.T, y @ y.T, atol=1e-3)
