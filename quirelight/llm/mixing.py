"""Problem 9: mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelight.operators.geometry import ranks
from quirelight.session import materialise

#: Share of its cap that a source's mean repetition reaches at most where no size is asked for:
#: a Poisson variable cut off at the cap has the cap as its mean only in the limit.
NEAR_CAP = 0.9
#: Steps of this size, the golden ratio's, fill (0, 1) evenly however many are made.
STEP = 0.6180339887498949
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pattern that splits words before byte pairs are merged.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_counter(path: str = TOKENIZER):
    """A column function: tokens of each text in the vocabulary at ``path``; null is null.

    Every executor needs the file at that path. Texts are ordinary text: strings that look
    like special tokens are encoded like any other.
    """
    from pyspark.sql.functions import pandas_udf

    held: dict[str, object] = {}

    @pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if "enc" not in held:
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
            held["enc"] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        enc = held["enc"]
        for s in batches:
            yield pd.Series([None if t is None else len(enc.encode_ordinary(t)) for t in s], dtype="Int64")

    return count


def clean_source(c):
    """Source names as in the target table: lower case, no outer space."""
    return F.lower(F.trim(c))


def _capped_mean(lam: float, cap: int) -> float:
    """Mean of a Poisson variable cut off at ``cap``."""
    p, total, mass = math.exp(-lam), 0.0, 0.0
    for k in range(cap):
        total += k * p
        mass += p
        p *= lam / (k + 1)
    return total + cap * (1.0 - mass)


def _rate_for(mean: float, cap: int) -> float:
    """The Poisson rate whose variable, cut off at ``cap``, has this mean; inf at the cap."""
    if mean >= cap * (1 - 1e-9):
        return math.inf
    low, high = 0.0, 1.0
    while _capped_mean(high, cap) < mean and high < 700:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if _capped_mean(mid, cap) < mean else (low, mid)
    return (low + high) / 2


def plan_rates(sizes: dict[str, int], targets: list[tuple[str, float, int]], total: float | None = None) -> list[tuple[str, float, float, int]]:
    """(source, rate, mean repetitions, cap) per source with tokens.

    ``total`` is the size wanted in tokens; left out, it is the largest at which no source
    needs more than ``NEAR_CAP`` of its cap, so the targets can be met. Shares of sources without tokens
    are spread over the others in proportion.
    """
    live = [(s, w, c) for s, w, c in targets if sizes.get(s, 0) > 0 and w > 0 and c > 0]
    whole = sum(w for _, w, _ in live)
    if not live:
        return []
    if total is None:
        total = min(NEAR_CAP * c * sizes[s] * whole / w for s, w, c in live)
    out = []
    for s, w, c in live:
        mean = min(float(c), total * w / whole / sizes[s])
        out.append((s, _rate_for(mean, c), mean, c))
    return out


def counted_documents(docs: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """The documents of the listed sources, with clean ``source`` and ``n_tokens``.

    Only texts of listed sources reach the tokenizer. Null texts and sources are left out.
    The target table is small by nature (one row per source); it is read as an inner join
    that Spark broadcasts only under its size limit.
    """
    names = targets.where("source is not null").select(clean_source(F.col("source")).alias("source")).distinct()
    src = docs.where("text is not null and source is not null").withColumn("source", clean_source(F.col("source"))).join(names, "source", "left_semi")
    return src.withColumn("n_tokens", token_counter(tokenizer)(F.col("text"))).where("n_tokens > 0")


def mix(docs: DataFrame, targets: DataFrame, *, seed: int = 1, total: float | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """The mixture: one row per copy (``doc_id, source, copy, n_tokens, place, text``).

    Each document is repeated as often as a Poisson distribution says, inverted at a number
    in (0, 1): even steps from a hash of ``seed`` and the source, one for each document in
    order of length. Every document's number is uniform over the seeds, but documents of like
    length get numbers spread over (0, 1), so a source's tokens come close to their mean even
    where few documents are drawn. Its mean is the source's target
    repetition rate and it is cut off at ``max_repeats`` (the rate is raised so that the mean
    holds in spite of the cut). ``place`` is a hash by which the rows are globally shuffled.
    Same input and seed, same mixture, whatever the partitioning. A source without documents
    supplies nothing; repeated target rows of one source count once, the largest share.

    Copies are made by a per-row explode, so a source with a third of all rows is no hot key;
    per-source token sums are partial aggregates of one row per source.
    """
    spark = docs.sparkSession
    wanted = [(r["s"], float(r["w"]), int(r["c"])) for r in targets.where("source is not null").groupBy(clean_source(F.col("source")).alias("s")).agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("c")).orderBy("s").collect()]
    counted = materialise(counted_documents(docs, targets, tokenizer).select(F.monotonically_increasing_id().alias("_row"), "doc_id", "source", "n_tokens", "text"), "counted")
    sizes = {r["source"]: r["n"] for r in counted.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    rates = plan_rates(sizes, wanted, total)
    # inverse distribution function as thresholds: copies = how many of them lie at or below u
    steps = []
    for s, lam, _, cap in rates:
        cdf, p, at = [], (math.exp(-lam) if lam < 700 else 0.0), 0.0
        for k in range(cap):
            at += p
            cdf.append(min(at, 1.0) if lam < 700 else 0.0)
            p = p * lam / (k + 1) if lam < 700 else 0.0
        steps.append((s, cdf))
    plan = spark.createDataFrame(steps, "source string, _cdf array<double>")
    largest = counted.groupBy("source").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    # lengths only: no text moves before it is known to be taken
    ranked = ranks(counted.select("_row", "doc_id", "source", "n_tokens"), "source", {"_p": ["n_tokens", "doc_id", "_row"]}, largest)
    offset = (F.xxhash64(F.col("source"), F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) + F.lit(0.5)) / F.lit(float(1 << 52))
    at = F.col("_p") * F.lit(STEP) + offset
    # one row per source of the target table
    drawn = ranked.join(F.broadcast(plan), "source").withColumn("_u", at - F.floor(at)).withColumn("_n", F.expr("size(filter(_cdf, x -> x <= _u))")).where("_n > 0").select("_row", "_n")
    rows = counted.join(drawn, "_row").withColumn("copy", F.explode(F.expr("sequence(1, _n)")))
    placed = rows.withColumn("place", F.xxhash64(F.col("doc_id"), F.col("copy"), F.lit(seed + 1)))
    return placed.select("doc_id", "source", "copy", "n_tokens", "place", "text").orderBy("place")


def reached_shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: wanted share, documents, tokens and share reached, most repeats.

    Sources that supplied nothing are listed with zeros.
    """
    want = targets.where("source is not null").groupBy(clean_source(F.col("source")).alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    got = mixture.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.countDistinct("doc_id").alias("documents"), F.max("copy").alias("most_repeats"))
    total = got.agg(F.sum("tokens")).first()[0] or 0
    zero = F.lit(0).cast("long")
    return want.join(got, "source", "left").select(
        "source", "target_share", "max_repeats", F.coalesce("documents", zero).alias("documents"), F.coalesce("tokens", zero).alias("tokens"),
        (F.coalesce("tokens", zero) / F.lit(float(max(total, 1)))).alias("share"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
