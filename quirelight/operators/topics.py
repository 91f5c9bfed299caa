"""Theme terms, topics and key phrases of clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirelight.operators.vectors import STOP_WORDS, token_counts, vocabulary
from quirelight.session import materialise

# Single words too general to stand alone as a label: our own short list.
GENERIC = ("design", "paper", "study", "approach", "method", "system", "work", "result", "use", "user", "process", "practice", "case", "tool", "data")
# Words that leave a label dangling when they end it: our own short list.
DANGLING = ("of", "for", "with", "and", "or", "the", "to", "in", "on", "by", "from", "new", "based", "using")


def ctfidf(docs: DataFrame, cluster: str, key: str, text: str, *, most: int = 6, limit: int = 8000, noise: str = "unassigned or low-density papers") -> DataFrame:
    """(cluster, ``terms``): the terms with the highest class-based weight, tf share times
    ln(1 + clusters / clusters with the term); equal weights by term. Noise gets ``noise``.

    Clusters are bags of their papers' words; the counts are partial aggregates by cluster
    and term, so a cluster with a third of all papers is no hot key.
    """
    known = docs.where(F.col(cluster).isNotNull())
    noisy = F.col(cluster).cast("string") == "-1"
    real = known.where(~noisy)
    per = token_counts(real.select(F.struct(cluster, key).alias("_k"), text), "_k", text).groupBy(F.col(f"_k.{cluster}").alias(cluster), "term").agg(F.sum("n").alias("n"))
    per = materialise(per, "cluster-terms")
    vocab = vocabulary(per, 1, limit)
    k = real.select(cluster).distinct().count()
    w = per.join(vocab.select("term", "df"), "term")
    share = F.col("n") / F.sum("n").over(W.partitionBy(cluster))
    scored = w.withColumn("w", share * F.log(1 + F.lit(float(k)) / F.col("df")))
    place = F.row_number().over(W.partitionBy(cluster).orderBy(F.desc(F.round("w", 12)), "term"))
    top = scored.withColumn("place", place).where(F.col("place") <= most)
    terms = top.groupBy(cluster).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda s: s["term"]), ", ").alias("terms"))
    return terms.unionByName(known.where(noisy).select(cluster, F.lit(noise).alias("terms")).distinct())


def lda_topics(docs: DataFrame, key: str, text: str, topics: int = 6, *, words: int = 6, seed: int = 42, rounds: int = 20) -> DataFrame:
    """(key, ``topic``, ``probability``, ``words``): the likeliest topic of each record, by
    Spark ML's distributed online variational LDA over counts of at most 5000 terms."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.functions import vector_to_array

    from quirelight.operators.vectors import tokens

    t = docs.where(F.col(text).isNotNull()).select(key, tokens(F.col(text)).alias("t")).persist()
    cv = CountVectorizer(inputCol="t", outputCol="f", vocabSize=5000, minDF=2).fit(t)
    rows = cv.transform(t)
    model = LDA(k=topics, featuresCol="f", seed=seed, maxIter=rounds, optimizer="online", subsamplingRate=1.0).fit(rows)
    names = {r["topic"]: " ".join(cv.vocabulary[i] for i in r["termIndices"]) for r in model.describeTopics(words).collect()}
    p = vector_to_array("topicDistribution")
    label = F.create_map(*[F.lit(x) for kv in sorted(names.items()) for x in kv])
    best = F.array_max(p)
    out = model.transform(rows).select(key, (F.array_position(p, best) - 1).cast("int").alias("topic"), best.alias("probability"))
    return materialise(out.withColumn("words", label[F.col("topic")]), "topics")


def label_root(tok: Column) -> Column:
    """Root of a label word: the plural ``s`` of words over four letters dropped."""
    return F.when((F.length(tok) > 4) & tok.endswith("s"), F.substring(tok, F.lit(1), F.length(tok) - 1)).otherwise(tok)


def phrase_roots(c: Column) -> Column:
    return F.array_distinct(F.transform(F.split(F.lower(F.trim(c)), r"\s+"), label_root))


def is_generic(tok: Column) -> Column:
    return tok.isin(*GENERIC)


def is_dangling(c: Column) -> Column:
    return F.element_at(F.split(F.lower(F.trim(c)), r"\s+"), -1).isin(*DANGLING)


def clean_labels(ranked: Column, limit: int) -> Column:
    """Of a ranked list the terms that add something: no dangling end, no general single
    word, no root already chosen; at most ``limit``. A left fold over the array."""
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("roots"))

    def step(acc: Column, term: Column) -> Column:
        r = phrase_roots(term)
        ok = (F.size(acc["out"]) < limit) & (F.trim(term) != "") & ~is_dangling(term) & ~((F.size(r) == 1) & is_generic(r[0])) & ~F.arrays_overlap(r, acc["roots"])
        return F.struct(F.when(ok, F.concat(acc["out"], F.array(term))).otherwise(acc["out"]).alias("out"), F.when(ok, F.concat(acc["roots"], r)).otherwise(acc["roots"]).alias("roots"))

    return F.aggregate(ranked, empty, step, lambda acc: acc["out"])


def content_runs(title: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Runs of content words of a title, split at punctuation and stop words (RAKE)."""
    low = F.regexp_replace(F.lower(title), r"[^a-z0-9\-'\s]+", " | ")
    words = F.transform(F.split(F.trim(low), r"\s+"), lambda w: F.regexp_replace(w, "^[-']+|[-']+$", ""))
    short = lambda w: (F.length(w) < 3) & ~w.isin("ai", "ux", "xr")
    marked = F.transform(words, lambda w: F.when(w.isin(*stop, "the", "a", "an", "of", "|", "") | short(w), F.lit("|")).otherwise(w))
    runs = F.split(F.array_join(marked, " "), r"(?:\s*\|\s*)+")
    return F.filter(F.transform(runs, lambda x: F.trim(x)), lambda r: r != "")


def rake(titles: DataFrame, group: str, title: str, most: int = 12) -> DataFrame:
    """(group, ``place``, ``phrase``, ``score``): key phrases of each group's titles.

    Words score (degree + frequency) / frequency over the group's runs; a phrase of up to
    three words scores the sum of its words. Single words need four letters. Equal scores by
    phrase. All counts are partial aggregates by group and word.
    """
    runs = titles.where(F.col(title).isNotNull()).select(group, F.explode(content_runs(F.col(title))).alias("run"))
    runs = runs.withColumn("words", F.split("run", " ")).withColumn("size", F.size("words"))
    words = runs.select(group, F.explode("words").alias("word"), "size").groupBy(group, "word").agg(F.count(F.lit(1)).alias("freq"), F.sum(F.col("size") - 1).alias("deg"))
    score = words.select(group, "word", ((F.col("deg") + F.col("freq")) / F.col("freq")).alias("s"))
    phrases = runs.where((F.col("size") <= 3) & ((F.col("size") > 1) | (F.length("run") >= 4))).select(group, "run", "words").distinct()
    scored = phrases.select(group, "run", F.explode("words").alias("word")).join(score, [group, "word"]).groupBy(group, "run").agg(F.sum("s").alias("score"))
    place = F.row_number().over(W.partitionBy(group).orderBy(F.desc(F.round("score", 9)), "run"))
    return scored.withColumn("place", place).where(F.col("place") <= most).select(group, "place", F.col("run").alias("phrase"), "score")


def title_terms(titles: DataFrame, group: str, title: str, rank: str, first: int = 6, limit: int = 4) -> DataFrame:
    """(group, ``terms``): cleaned key phrases of each group's leading titles."""
    lead = titles.where(F.col(rank).between(1, first))
    r = rake(lead, group, title).groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "phrase"))), lambda s: s["phrase"]).alias("p"))
    return r.select(group, F.array_join(clean_labels("p", limit), ", ").alias("terms"))


def preferred_phrases(ranked: Column, preferred: tuple[str, ...] = (), context: tuple[str, ...] = (), limit: int = 4) -> Column:
    """Of a ranked list first the ``preferred`` phrases, the longest first, then phrases of
    several words, then single words, each in the order of the list; ``context`` phrases,
    which name the whole field, are left out; cleaned to ``limit``."""
    low = lambda t: F.lower(F.trim(t))
    kept = F.filter(ranked, lambda t: ~low(t).isin(*context)) if context else ranked
    liked = (lambda t: low(t).isin(*preferred)) if preferred else (lambda t: F.lit(False))
    keyed = F.transform(kept, lambda t, i: F.struct(F.when(liked(t), 0).when(F.size(F.split(F.trim(t), r"\s+")) > 1, 1).otherwise(2).alias("a"), F.when(liked(t), -F.length(t)).otherwise(0).alias("b"), i.alias("i"), t.alias("t")))
    return clean_labels(F.transform(F.array_sort(keyed), lambda x: x["t"]), limit)


def evidence_terms(df: DataFrame, lists: list[str], limit: int = 4, fallback: Column | None = None) -> Column:
    """Merged term lists ordered by (single word, general, length), cleaned to ``limit``; where
    nothing is left, the terms of ``fallback`` (an array, such as a title's words)."""
    merged = F.array_distinct(F.flatten(F.array(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in lists])))
    keyed = F.transform(merged, lambda t: F.struct((F.size(F.split(t, " ")) == 1).cast("int").alias("a"), is_generic(F.lower(t)).cast("int").alias("b"), (-F.length(t)).alias("c"), t.alias("t")))
    found = clean_labels(F.transform(F.array_sort(keyed), lambda s: s["t"]), limit)
    return found if fallback is None else F.when(F.size(found) > 0, found).otherwise(clean_labels(fallback, limit))


def dominant(keywords: DataFrame, group: str, keyword: str, most: int = 2) -> DataFrame:
    """(group, ``place``, keyword, ``n``): the commonest keywords, equal counts by name."""
    n = keywords.groupBy(group, keyword).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(W.partitionBy(group).orderBy(F.desc("n"), keyword))
    return n.withColumn("place", place).where(F.col("place") <= most)
