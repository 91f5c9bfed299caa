"""Tokens, TF-IDF, reduced features and cosine geometry without pair explosions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirelight.session import materialise

# Function words left out of vectors: a short list of our own; callers may pass another.
STOP_WORDS = tuple(
    "about above after again against all also although among and any are because been before being below between both but can could did does doing down during each few for "
    "from further had has have having her here hers him his how into its itself just later less more most not nor now off once only other our ours out over own rather same she "
    "should some such than that the their theirs them then there these they this those through too under until upon very was were what when where which while who whom whose why "
    "will with within without would yet you your".split()
)
#: At most this many cells a table sent to every task may hold.
BROADCAST_CELLS = 4_000_000
#: Terms of a block of sums that one task adds up.
TERM_BLOCK = 512


def tokens(c: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Words of three and more letters (and ai, ux, xr), lower case, stop words left out."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"\b(ai|ux|xr|[a-z]{3,})\b"), 1)
    return F.filter(words, lambda w: ~w.isin(*stop))


def _runs(toks: Column, n: int) -> Column:
    at = F.when(F.size(toks) >= n, F.sequence(F.lit(1), F.size(toks) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(toks, i, F.lit(n)), " "))


def with_ngrams(toks: Column, low: int, high: int) -> Column:
    """Runs of ``low`` to ``high`` neighbouring tokens, built after stop words are gone."""
    parts = []
    for n in range(low, high + 1):
        if n == 1:
            parts.append(toks)
        else:
            parts.append(_runs(toks, n))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def token_counts(df: DataFrame, key: str, text: str, ngrams: tuple[int, int] = (1, 1), stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(key, ``term``, ``n``): the long form of the bag of words. Null texts have no row."""
    t = df.where(F.col(text).isNotNull()).select(key, F.explode(with_ngrams(tokens(F.col(text), stop), *ngrams)).alias("term"))
    return t.groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(counts: DataFrame, min_df: int = 2, most: int | None = None) -> DataFrame:
    """(``term, df, total``): terms of at least ``min_df`` records, the ``most`` commonest,
    equal totals by term. The ranking is a top-k, not a sort of the whole vocabulary."""
    v = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("total")).where(F.col("df") >= min_df)
    return v if most is None else v.orderBy(F.desc("total"), "term").limit(most)


def tfidf(counts: DataFrame, key: str, vocab: DataFrame, n_records: int) -> DataFrame:
    """(key, ``term``, ``w``): n * (ln((1+N)/(1+df)) + 1), every record of unit length.

    ``vocab`` may be broadcast by Spark while it is under the size limit; record norms are a
    window over the record's own rows, which the record's hash partitioning already serves.
    """
    raw = counts.join(vocab.select("term", "df"), "term").select(key, "term", (F.col("n") * (F.log(F.lit(1.0 + n_records) / (F.lit(1.0) + F.col("df"))) + 1)).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(key)))
    return raw.select(key, "term", (F.col("w") / norm).alias("w"))


def svd_features(weights: DataFrame, key: str, dims: int, *, extra: int = 12, rounds: int = 12, seed: int = 42) -> DataFrame:
    """(key, ``vector``): records projected on the leading right singular vectors of the
    TF-IDF matrix, unit length, signs fixed so that each component's largest loading is
    positive.

    Randomised subspace iteration (Halko, Martinsson and Tropp) on ``dims + extra`` columns:
    a round multiplies every record's own terms with the basis, so the cost is the non-zero
    weights times the columns. A task adds up its records and sends one block of sums for
    every ``TERM_BLOCK`` terms. The basis has vocabulary times columns cells, whatever the
    number of records; over ``BROADCAST_CELLS`` cells a ValueError says so. With a vocabulary
    of ``dims + extra`` terms or fewer the result is exact.
    """
    spark = weights.sparkSession
    terms = sorted(r[0] for r in weights.select("term").distinct().limit(BROADCAST_CELLS // (dims + extra) + 1).collect())
    v = len(terms)
    width = min(v, dims + extra)
    if v * (dims + extra) > BROADCAST_CELLS:
        raise ValueError(f"{v} terms are too many for {dims} dimensions: limit the vocabulary first")
    schema = f"`{key}` {weights.schema[key].dataType.simpleString()}, vector array<double>"
    if v == 0:
        return spark.createDataFrame([], schema)
    index = F.broadcast(spark.createDataFrame([(t, i) for i, t in enumerate(terms)], "term string, i int"))
    rows = materialise(weights.join(index, "term").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "w"))).alias("t")).select(key, F.col("t.i").alias("i"), F.col("t.w").alias("w")), "sparse-rows")

    def product(pdf: pd.DataFrame, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The records' products with the basis, and their cells (record, term, weight)."""
        width_ = np.array([len(x) for x in pdf["i"]])
        i, w = np.concatenate([np.asarray(x, np.int64) for x in pdf["i"]]), np.concatenate([np.asarray(x, np.float64) for x in pdf["w"]])
        start = np.r_[0, np.cumsum(width_)[:-1]]
        return np.add.reduceat(w[:, None] * basis[i], start, axis=0), np.repeat(np.arange(len(pdf)), width_), i, w

    def multiply(shared):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            basis = shared.value
            out = np.zeros_like(basis)
            for pdf in batches:
                for a in range(0, len(pdf), 1000):
                    y, row, i, w = product(pdf.iloc[a : a + 1000], basis)
                    order = np.argsort(i, kind="stable")
                    at = i[order]
                    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                    out[at[first]] += np.add.reduceat(w[order, None] * y[row[order]], first, axis=0)
            blocks = range(0, len(out), TERM_BLOCK)
            yield pd.DataFrame({"b": [b // TERM_BLOCK for b in blocks], "x": [out[b : b + TERM_BLOCK].tobytes() for b in blocks]})

        return run

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x) for x in pdf["x"])
        return pd.DataFrame({"b": pdf["b"].iloc[:1], "x": [total.tobytes()]})

    basis, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(v, width)))
    for n in range(rounds + 1 if width < v else 2):
        held = spark.sparkContext.broadcast(basis)
        blocks = rows.select("i", "w").mapInPandas(multiply(held), "b int, x binary").groupBy("b").applyInPandas(add, "b int, x binary").orderBy("b").collect()
        image = np.concatenate([np.frombuffer(bytes(r["x"])) for r in blocks]).reshape(v, width)
        held.unpersist()
        last, basis = basis, np.linalg.qr(image)[0]
    val, vec = np.linalg.eigh((last.T @ image + image.T @ last) / 2)
    basis = last @ vec[:, np.argsort(-val)[: max(1, min(dims, width))]]
    basis *= np.sign(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])])
    shared = spark.sparkContext.broadcast(basis)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            y = product(pdf, shared.value)[0] if len(pdf) else np.zeros((0, 1))
            y /= np.linalg.norm(y, axis=1, keepdims=True) + 1e-12
            yield pd.DataFrame({key: pdf[key], "vector": list(y)})

    return rows.mapInPandas(project, schema)


def unit(v: Column) -> Column:
    """The vector at unit length, in double precision; a zero vector stays."""
    d = v.cast("array<double>")
    n = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(d, lambda x: F.when(n > 0, x / n).otherwise(x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def mean_by_group(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, ``mean``, ``n``): mean vector of each group. One vector per group and task is
    shuffled (a partial aggregate), so a group with a third of all rows is harmless. Null
    vectors are left out."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    v = df.where(F.col(vector).isNotNull()).select(group, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    m = v.groupBy(group).agg(Summarizer.metrics("mean", "count").summary(F.col("_v")).alias("_s"))
    return m.select(group, vector_to_array("_s.mean").alias("mean"), F.col("_s.count").alias("n"))


def nearest(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(``query``, ``neighbour``, ``distance``, ``place``): the ``k`` nearest rows of ``base``
    by cosine distance to each query, itself left out, equal distances by key.

    The queries are a stated set, taken in blocks of at most ``BROADCAST_CELLS`` cells; each
    block visits every row of ``base`` once by matrix products, and a task passes on at most
    k rows per query.
    """
    spark = base.sparkSession
    b = base.select(F.col(key).alias("k"), unit(F.col(vector)).alias("v"))
    q = queries.select(F.col(key).alias("k"), unit(F.col(vector)).alias("v"))
    size = q.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    n, dim = size[0], size[1] or 1
    parts = max(1, -(-n * dim // BROADCAST_CELLS))
    kind = base.schema[key].dataType.simpleString()
    out = None
    for p in range(parts):
        rows = q.where(F.pmod(F.xxhash64("k"), F.lit(parts)) == p).orderBy("k").collect() if parts > 1 else q.orderBy("k").collect()
        if not rows:
            continue
        shared = spark.sparkContext.broadcast(([r["k"] for r in rows], np.array([r["v"] for r in rows])))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, x = shared.value
            for pdf in batches:
                if len(pdf) == 0:
                    continue
                keys, y = pdf["k"].to_numpy(), np.stack(pdf["v"].to_numpy())
                dist = 1.0 - x @ y.T
                order = np.argsort(keys, kind="stable")
                dist, names = dist[:, order], keys[order]
                best = np.argsort(np.round(dist, 12), axis=1, kind="stable")[:, : k + 1]
                rows_ = [(ids[i], names[j], float(dist[i, j])) for i in range(len(ids)) for j in best[i] if names[j] != ids[i]]
                yield pd.DataFrame(rows_, columns=["query", "neighbour", "distance"])

        got = b.mapInPandas(scan, f"query {kind}, neighbour {kind}, distance double")
        out = got if out is None else out.unionByName(got)
    if out is None:
        return spark.createDataFrame([], f"query {kind}, neighbour {kind}, distance double, place int")
    place = F.row_number().over(W.partitionBy("query").orderBy(F.round("distance", 12), "neighbour"))
    return out.withColumn("place", place).where(F.col("place") <= k)
