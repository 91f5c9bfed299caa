"""Vectors, clustering and geometry: V3-V8, C- and G-operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelight.operators import clustering as K
from quirelight.operators import geometry as G
from quirelight.operators import vectors as V
from quirelight.queries.base import PAPERS, papers
from quirelight.queries.texts import TOKENS
from quirelight.session import table


def _counts(s, d):
    p = papers(s, d).select("paper_id", F.concat_ws(" ", "title", "abstract").alias("text"))
    return p, V.token_counts(p, "paper_id", "text")


def vocab(s, d):
    return V.vocabulary(_counts(s, d)[1], 2, 8000)


def tfidf(s, d):
    p, c = _counts(s, d)
    return V.tfidf(c, "paper_id", V.vocabulary(c, 2, 8000), p.count()).select("paper_id", "term", F.round("w", 6).alias("w"))


_CNT = f"{TOKENS}, cnt AS (SELECT paper_id, term, count(*) AS n FROM (SELECT paper_id, unnest(t) AS term FROM tok) GROUP BY 1, 2)"
_VOC = "voc AS (SELECT term, count(*) AS df, CAST(sum(n) AS BIGINT) AS total FROM cnt GROUP BY 1 HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT 8000)"


def svd(s, d):
    p, c = _counts(s, d)
    w = V.tfidf(c, "paper_id", V.vocabulary(c, 2, 8000), p.count())
    return V.svd_features(w, "paper_id", 50)


def emb(s, d):
    return table(s, d, "embeddings")


def unit_vectors(s, d):
    return emb(s, d).select("vec_id", F.posexplode(V.unit(F.col("embedding"))).alias("i", "x")).select("vec_id", "i", F.round("x", 6).alias("x"))


def mean_pool(s, d):
    m = V.mean_by_group(emb(s, d), "label", "embedding")
    return m.select("label", "n", F.posexplode(V.unit(F.col("mean"))).alias("i", "x")).select("label", "n", "i", F.round("x", 6).alias("x"))


def nearest(s, d):
    """Neighbours of every row whose id is divisible by 100, against all rows."""
    e = emb(s, d)
    got = V.nearest(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 5)
    return got.join(e.select(F.col("vec_id").alias("neighbour"), "label"), "neighbour").select("query", "place", "neighbour", F.col("label").alias("neighbour_label"), F.round("distance", 6).alias("distance"))


_V = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM v)"
_MEAN = "m AS (SELECT label, list(x ORDER BY i) AS mean, max(n) AS n FROM (SELECT label, i, avg(x) AS x, count(*) AS n FROM (SELECT label, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM u) GROUP BY 1, 2) GROUP BY 1), c AS (SELECT label, n, mean, list_transform(mean, lambda x: x / sqrt(list_dot_product(mean, mean))) AS cen FROM m)"


def centroid_rows(s, d):
    c = G.centroids(emb(s, d), "label", "embedding")
    return c.select("label", "n", F.posexplode("centroid").alias("i", "x")).select("label", "n", "i", F.round("x", 6).alias("x"))


def geometry(s, d):
    return G.with_geometry(emb(s, d), "vec_id", "label", "embedding").withColumn("distance_to_centroid", F.round("distance_to_centroid", 6))


_GEO = f"""WITH {_V}, {_MEAN}, g AS (SELECT vec_id, label, 1 - list_dot_product(u, cen) AS d, 1 - list_dot_product(u, mean) AS m FROM u JOIN c USING (label)),
r AS (SELECT vec_id, label, round(d, 6) AS distance_to_centroid, row_number() OVER (PARTITION BY label ORDER BY round(d, 9), vec_id) AS representative_rank, row_number() OVER (PARTITION BY label ORDER BY round(m, 9), vec_id) AS medoid_rank FROM g)"""


def representatives(s, d):
    return G.top_representatives(G.with_geometry(emb(s, d), "vec_id", "label", "embedding"), "label", "vec_id", 3).select("label", "place", "vec_id")


def silhouettes(s, d):
    return G.silhouettes(emb(s, d), "vec_id", "label", "embedding").select("vec_id", "label", F.round("silhouette", 6).alias("silhouette"))


_SIL = f"""{_V}, {_MEAN}, sa AS (SELECT u.vec_id, u.label, c.n, (c.n * (1 - list_dot_product(u.u, c.mean)) - (1 - list_dot_product(u.u, u.u))) / (c.n - 1) AS a FROM u JOIN c USING (label)),
sb AS (SELECT u.vec_id, min(1 - list_dot_product(u.u, c.mean)) AS b FROM u JOIN c ON u.label <> c.label GROUP BY 1), sil AS (SELECT vec_id, label, CASE WHEN n = 1 THEN 0.0 ELSE (b - a) / greatest(a, b) END AS silhouette FROM sa JOIN sb USING (vec_id))"""


def selection_row(s, d):
    r = G.selection_row(G.silhouettes(emb(s, d), "vec_id", "label", "embedding"), "label")
    return r.withColumns({c: F.round(c, 6) for c in ("average_silhouette", "max_cluster_ratio", "negative_silhouette_ratio")})


def kmeans_fixed(s, d):
    return K.kmeans_steps(emb(s, d), "vec_id", "embedding", 4, 3)


def _kmeans_sql(k: int, rounds: int) -> str:
    """The same rounds, unrolled."""
    q = f"WITH {_V}, c0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS k, u AS c FROM (SELECT * FROM u ORDER BY vec_id LIMIT {k}))"
    for r in range(rounds + 1):
        q += f", a{r} AS (SELECT vec_id, arg_min(k, (round(d, 9), k)) AS k FROM (SELECT vec_id, k, list_sum(list_transform(list_zip(u, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM u, c{r}) GROUP BY 1)"
        if r < rounds:
            q += f", c{r + 1} AS (SELECT k, list(x ORDER BY i) AS c FROM (SELECT k, i, avg(x) AS x FROM (SELECT k, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM u JOIN a{r} USING (vec_id)) GROUP BY 1, 2) GROUP BY 1)"
    return f"{q} SELECT vec_id, CAST(k AS INTEGER) AS cluster FROM a{rounds}"


def kmeans_parts(s, d):
    """k-means in two parts of the table at once, the number of clusters chosen for each."""
    e = emb(s, d).withColumn("part", F.col("label") % 2)
    bounds = e.select("part").distinct().select("part", F.lit(2).alias("low"), F.lit(5).alias("high"))
    labels, table_ = K.kmeans_groups(e, "part", "vec_id", "embedding", bounds)
    return labels.join(table_.where("selected").select("part", "clusters"), ["part", "clusters"]).select("part", "vec_id", "clusters", "cluster", F.round("silhouette", 6).alias("silhouette"))


def near_ties(s, d):
    t = K.selection_table(emb(s, d), "vec_id", "embedding", range(2, 6), 3)
    return t.select("k", F.round("average_silhouette", 6).alias("average_silhouette"), "close_to_best", "selected", "cluster_sizes")


_LABELLED = " UNION ALL ".join(f"SELECT {k} AS k, vec_id, cluster FROM ({_kmeans_sql(k, 3)})" for k in range(2, 6))
_TIES = f"""WITH {_V}, lu AS (SELECT k, vec_id, cluster, u FROM ({_LABELLED}) JOIN u USING (vec_id)),
m AS (SELECT k, cluster, list(x ORDER BY i) AS mean, max(n) AS n FROM (SELECT k, cluster, i, avg(x) AS x, count(*) AS n FROM (SELECT k, cluster, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM lu) GROUP BY 1, 2, 3) GROUP BY 1, 2),
p AS (SELECT lu.k, vec_id, lu.cluster AS own, m.cluster AS c, n, 1 - list_dot_product(u, mean) AS d, list_dot_product(u, u) AS uu FROM lu JOIN m USING (k)),
a AS (SELECT k, vec_id, own, max(CASE WHEN c = own THEN n END) AS n, max(CASE WHEN c = own THEN (n * d - (1 - uu)) / greatest(n - 1, 1) END) AS a, min(CASE WHEN c <> own THEN d END) AS b FROM p GROUP BY 1, 2, 3),
t AS (SELECT k, own, count(*) AS n, sum(CASE WHEN n = 1 THEN 0.0 ELSE (b - a) / greatest(a, b) END) AS s FROM a GROUP BY 1, 2),
r AS (SELECT k, sum(s) / sum(n) AS v, string_agg(own || ':' || n, '; ' ORDER BY own) AS cluster_sizes FROM t GROUP BY 1), q AS (SELECT *, v >= max(v) OVER () - greatest(0.002, 0.02 * abs(max(v) OVER ())) AS close_to_best FROM r)
SELECT CAST(k AS INTEGER) AS k, round(v, 6) AS average_silhouette, close_to_best, k = min(CASE WHEN close_to_best THEN k END) OVER () AS selected, cluster_sizes FROM q"""


def noise_assigned(s, d):
    e = emb(s, d).withColumn("c", F.when(F.col("vec_id") % 9 == 0, -1).otherwise(F.col("label")))
    return G.nearest_cluster(e, "vec_id", "c", "embedding")


_NOISE = f"""WITH {_V}, n AS (SELECT vec_id, e, CASE WHEN vec_id % 9 = 0 THEN -1 ELSE label END AS c FROM v),
m AS (SELECT c AS k, list(x ORDER BY i) AS mean FROM (SELECT c, i, avg(x) AS x FROM (SELECT c, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM n WHERE c <> -1) GROUP BY 1, 2) GROUP BY 1),
b AS (SELECT vec_id, arg_min(k, (round(d, 9), k)) AS k FROM (SELECT vec_id, k, list_sum(list_transform(list_zip(e, mean), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM n, m WHERE c = -1) GROUP BY 1)
SELECT n.vec_id, CAST(coalesce(b.k, n.c) AS INTEGER) AS cluster, n.c = -1 AS peripheral FROM n LEFT JOIN b USING (vec_id)"""


_DBSCAN = f"""WITH RECURSIVE {_V}, n AS (SELECT vec_id AS id, label % 2 AS part, u FROM u), e AS (SELECT a.part, a.id AS a, b.id AS b FROM n a JOIN n b ON a.part = b.part AND 1 - list_dot_product(a.u, b.u) <= 0.35 + 1e-12),
core AS (SELECT part, a AS id FROM e GROUP BY 1, 2 HAVING count(*) >= 4), ce AS (SELECT e.a, e.b FROM e SEMI JOIN core x ON e.a = x.id SEMI JOIN core y ON e.b = y.id),
reach AS (SELECT id, id AS r FROM core UNION SELECT ce.b, reach.r FROM reach JOIN ce ON ce.a = reach.id), root AS (SELECT id, min(r) AS r FROM reach GROUP BY 1),
num AS (SELECT core.id, core.part, dense_rank() OVER (PARTITION BY core.part ORDER BY root.r) - 1 AS c FROM core JOIN root USING (id)), border AS (SELECT e.a AS id, min(num.c) AS c FROM e JOIN num ON e.b = num.id GROUP BY 1)
SELECT n.part, n.id AS vec_id, CAST(coalesce(num.c, border.c, -1) AS INTEGER) AS cluster FROM n LEFT JOIN num ON num.id = n.id LEFT JOIN border ON border.id = n.id"""


def _density(method, **o):
    def run(s, d):
        e = emb(s, d).withColumn("part", F.col("label") % 2)
        return K.density_clusters(e, "part", "vec_id", "embedding", method, **o)

    return run


QUERIES = {
    "vocabulary": (vocab, f"WITH {PAPERS}, {_CNT}, {_VOC} SELECT term, df, total FROM voc"),
    "tfidf": (tfidf, f"""WITH {PAPERS}, {_CNT}, {_VOC}, raw AS (SELECT paper_id, term, n * (ln((1.0 + (SELECT count(*) FROM papers)) / (1.0 + df)) + 1) AS w FROM cnt JOIN voc USING (term))
SELECT paper_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY paper_id)), 6) AS w FROM raw"""),
    "svd_features": (svd, None),
    "unit_vectors": (unit_vectors, f"WITH {_V} SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, round(x, 6) AS x FROM (SELECT vec_id, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM u)"),
    "mean_pool": (mean_pool, """WITH m AS (SELECT label, list(x ORDER BY i) AS mean, max(n) AS n FROM (SELECT label, i, avg(x) AS x, count(*) AS n FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1)
SELECT label, n, CAST(i - 1 AS INTEGER) AS i, round(x / nrm, 6) AS x FROM (SELECT label, n, unnest(mean) AS x, generate_subscripts(mean, 1) AS i, sqrt(list_dot_product(mean, mean)) AS nrm FROM m)"""),
    "nearest_five": (nearest, f"""WITH {_V}, p AS (SELECT q.vec_id AS query, b.vec_id AS neighbour, b.label AS neighbour_label, 1 - list_dot_product(q.u, b.u) AS d FROM u q JOIN u b ON q.vec_id <> b.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(d, 12), neighbour) AS place FROM p) SELECT query, CAST(place AS INTEGER) AS place, neighbour, neighbour_label, round(d, 6) AS distance FROM r WHERE place <= 5"""),
    "cluster_sizes": (lambda s, d: G.cluster_sizes(emb(s, d), "label").withColumn("ratio", F.round("ratio", 6)), "SELECT label, count(*) AS n, round(count(*) / (SELECT count(*) FROM embeddings), 6) AS ratio FROM embeddings GROUP BY 1"),
    "centroids": (centroid_rows, f"WITH {_V}, {_MEAN} SELECT label, n, CAST(i - 1 AS INTEGER) AS i, round(x, 6) AS x FROM (SELECT label, n, unnest(cen) AS x, generate_subscripts(cen, 1) AS i FROM c)"),
    "cluster_geometry": (geometry, f"{_GEO} SELECT vec_id, label, distance_to_centroid, CAST(representative_rank AS INTEGER) AS representative_rank, CAST(medoid_rank AS INTEGER) AS medoid_rank, representative_rank <= 3 AS is_representative_top3 FROM r"),
    "top_representatives": (representatives, f"{_GEO} SELECT label, CAST(representative_rank AS INTEGER) AS place, vec_id FROM r WHERE representative_rank <= 3"),
    "silhouettes": (silhouettes, f"WITH {_SIL} SELECT vec_id, label, round(silhouette, 6) AS silhouette FROM sil"),
    "selection_row": (selection_row, f"""WITH {_SIL}, p AS (SELECT label, count(*) AS n, sum(silhouette) AS s, count_if(silhouette < 0) AS neg FROM sil GROUP BY 1)
SELECT CAST(count(*) AS INTEGER) AS k, round(sum(s) / sum(n), 6) AS average_silhouette, min(n) AS min_cluster_size, max(n) AS max_cluster_size, round(max(n) / sum(n), 6) AS max_cluster_ratio, string_agg(label || ':' || n, '; ' ORDER BY label) AS cluster_sizes,
CAST(sum(neg) AS BIGINT) AS negative_silhouette_count, round(sum(neg) / sum(n), 6) AS negative_silhouette_ratio FROM p"""),
    "kmeans_fixed": (kmeans_fixed, _kmeans_sql(4, 3)),
    "kmeans": (lambda s, d: K.kmeans(emb(s, d), "vec_id", "embedding", 6), None),
    "kmeans_groups": (kmeans_parts, None),
    "selection_table": (near_ties, _TIES),
    "noise_assigned": (noise_assigned, _NOISE),
    "dbscan": (_density("dbscan", eps=0.35), _DBSCAN),
    "dbscan_auto": (_density("dbscan"), None),
    "hdbscan": (_density("hdbscan"), None),
    "layout": (lambda s, d: K.layout(emb(s, d), "vec_id", "embedding"), None),
}
