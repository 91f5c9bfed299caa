"""Theme terms, topics and key phrases: K-operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelight.operators import topics as T
from quirelight.operators import vectors as V
from quirelight.queries.base import PAPERS, clusters, papers
from quirelight.session import table

# one row per paper of one run's clusters, with the paper's text
def clustered(s, d):
    """Papers of all k-means clusters by (run, view, cluster) with title and abstract."""
    c = clusters(s, d).where("cluster_method = 'kmeans' and cluster is not null").groupBy("run_id", "text_view", "cluster", "paper_id").agg(F.min("representative_rank").alias("rank"))
    p = papers(s, d).select("paper_id", "title", F.concat_ws(" ", "title", "abstract").alias("text"), "keyword")
    return c.join(p, "paper_id").withColumn("g", F.concat_ws("|", "run_id", "text_view", F.col("cluster").cast("string")))


CLUSTERED = f"""{PAPERS}, cl AS (SELECT run_id || '|' || text_view || '|' || CAST(cluster AS INTEGER) AS g, CAST(cluster AS INTEGER) AS cluster, paper_id, min(representative_rank) AS rank FROM clustering_results WHERE cluster_method = 'kmeans' AND cluster IS NOT NULL GROUP BY run_id, text_view, cluster, paper_id),
cp AS (SELECT cl.*, title, title || ' ' || abstract AS text, keyword FROM cl JOIN papers USING (paper_id))"""

_STOP = ", ".join(f"'{w}'" for w in V.STOP_WORDS)
_WORDS = f"list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+'), lambda x: regexp_full_match(x, 'ai|ux|xr|[a-z]{{3,}}') AND x NOT IN ({_STOP}))"


def source_terms(s, d):
    """Theme terms of every source of the documents, sources as clusters."""
    docs = table(s, d, "documents").where("source is not null").withColumn("src", F.lower(F.trim("source")))
    t = T.ctfidf(docs.withColumn("cluster", F.abs(F.hash("src")) % 1000003), "cluster", "doc_id", "text", most=5)
    names = docs.select("src", (F.abs(F.hash("src")) % 1000003).alias("cluster")).distinct()
    return t.join(names, "cluster").select("src", "terms")


_CT = f"""WITH docs AS (SELECT lower(trim(source)) AS src, text FROM documents WHERE source IS NOT NULL), per AS (SELECT src, term, count(*) AS n FROM (SELECT src, unnest({_WORDS}) AS term FROM docs) GROUP BY 1, 2),
voc AS (SELECT term, count(*) AS df, sum(n) AS total FROM per GROUP BY 1 ORDER BY total DESC, term LIMIT 8000), w AS (SELECT src, term, n / sum(n) OVER (PARTITION BY src) * ln(1 + (SELECT count(DISTINCT src) FROM docs) / df) AS w FROM per JOIN voc USING (term)),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(w, 12) DESC, term) AS p FROM w) SELECT src, string_agg(term, ', ' ORDER BY p) AS terms FROM r WHERE p <= 5 GROUP BY 1"""


def rake(s, d):
    p = papers(s, d).withColumn("g", F.lower(F.split("keyword", r"\s*[;|,]\s*")[0]))
    return T.rake(p, "g", "title", 12).withColumn("score", F.round("score", 6))


_SHORT = "(length(w) < 3 AND w NOT IN ('ai', 'ux', 'xr'))"
_RUNS = f"""ws AS (SELECT g, paper_id, list_transform(string_split_regex(trim(regexp_replace(lower(title), '[^a-z0-9\\-''\\s]+', ' | ', 'g')), '\\s+'), lambda w: regexp_replace(w, '^[-'']+|[-'']+$', '', 'g')) AS ws FROM tt),
mk AS (SELECT g, paper_id, array_to_string(list_transform(ws, lambda w: CASE WHEN w IN ({_STOP}, 'the', 'a', 'an', 'of', '|', '') OR {_SHORT} THEN '|' ELSE w END), ' ') AS m FROM ws),
rn AS (SELECT g, trim(unnest(string_split_regex(m, '(?:\\s*\\|\\s*)+'))) AS run FROM mk), runs AS (SELECT g, run, string_split(run, ' ') AS words FROM rn WHERE run <> '')"""


def rake_sql(tt: str, most: int) -> str:
    return f"""tt AS ({tt}), {_RUNS}, wd AS (SELECT g, word, count(*) AS freq, sum(size - 1) AS deg FROM (SELECT g, unnest(words) AS word, len(words) AS size FROM runs) GROUP BY 1, 2),
ph AS (SELECT DISTINCT g, run, words FROM runs WHERE len(words) <= 3 AND (len(words) > 1 OR length(run) >= 4)),
sc AS (SELECT g, run, sum((deg + freq) / freq) AS score FROM (SELECT g, run, unnest(words) AS word FROM ph) JOIN wd USING (g, word) GROUP BY 1, 2),
rk AS (SELECT g, CAST(row_number() OVER (PARTITION BY g ORDER BY round(score, 9) DESC, run) AS INTEGER) AS place, run AS phrase, round(score, 6) AS score FROM sc) SELECT * FROM rk WHERE place <= {most}"""


_TT = "SELECT lower(regexp_split_to_array(keyword, '\\s*[;|,]\\s*')[1]) AS g, paper_id, title FROM papers"


def dominant(s, d):
    return T.dominant(clustered(s, d), "g", "keyword", 2).select("g", "place", "keyword", "n")


def label_terms(s, d):
    """Theme-term lists of the clusters, cleaned to at most four terms."""
    c = clusters(s, d).where("cluster_theme_terms is not null and cluster >= 0").select("cluster_theme_terms").distinct()
    return c.select("cluster_theme_terms", F.array_join(T.clean_labels(F.transform(F.split("cluster_theme_terms", ","), lambda x: F.trim(x)), 4), ", ").alias("label"))


def evidence_terms(s, d):
    c = clusters(s, d).where("cluster >= 0").select("cluster_theme_terms", "lda_topic_words").distinct()
    c = c.select("cluster_theme_terms", "lda_topic_words", F.transform(F.split("cluster_theme_terms", ","), lambda x: F.trim(x)).alias("a"), F.split("lda_topic_words", " ").alias("b"))
    return c.select("cluster_theme_terms", "lda_topic_words", F.array_join(T.evidence_terms(c, ["a", "b"]), ", ").alias("terms"))


def _fold_sql(ranked: str, most: int) -> str:
    """The cleaning fold over a ranked list: what adds no root of its own is left out."""
    stem = "CASE WHEN length(w) > 4 AND ends_with(w, 's') THEN substr(w, 1, length(w) - 1) ELSE w END"
    roots = lambda t: f"list_distinct(list_transform(string_split_regex(lower(trim({t})), '\\s+'), lambda w: {stem}))"
    last = "string_split_regex(lower(trim(x[1])), '\\s+')[-1]"
    words = lambda ws: ", ".join(f"'{w}'" for w in ws)
    ok = f"len(acc) < {most} AND trim(x[1]) <> '' AND {last} NOT IN ({words(T.DANGLING)}) AND NOT (len({roots('x[1]')}) = 1 AND {roots('x[1]')}[1] IN ({words(T.GENERIC)})) AND len(list_intersect({roots('x[1]')}, flatten(list_transform(acc, lambda a: {roots('a')})))) = 0"
    return f"list_reduce(list_transform({ranked}, lambda t: [t]), lambda acc, x: CASE WHEN {ok} THEN list_concat(acc, x) ELSE acc END, CAST([] AS VARCHAR[]))"


_THEME_LIST = "list_transform(string_split(cluster_theme_terms, ','), lambda x: trim(x))"
_LABELS = f"SELECT cluster_theme_terms, array_to_string({_fold_sql(_THEME_LIST, 4)}, ', ') AS label FROM (SELECT DISTINCT cluster_theme_terms FROM clustering_results WHERE cluster_theme_terms IS NOT NULL AND cluster >= 0)"
_GENERIC = ", ".join(f"'{w}'" for w in T.GENERIC)
_KEYED = f"list_transform(list_sort(list_transform(list_distinct(list_concat(coalesce({_THEME_LIST}, []), coalesce(string_split(lda_topic_words, ' '), []))), lambda t: {{'a': CAST(NOT contains(t, ' ') AS INTEGER), 'b': CAST(lower(t) IN ({_GENERIC}) AS INTEGER), 'c': -length(t), 't': t}})), lambda v: v.t)"
_EVID = f"SELECT cluster_theme_terms, lda_topic_words, array_to_string({_fold_sql(_KEYED, 4)}, ', ') AS terms FROM (SELECT DISTINCT cluster_theme_terms, lda_topic_words FROM clustering_results WHERE cluster >= 0)"
_LEADS = "SELECT g, paper_id, title FROM cp WHERE rank BETWEEN 1 AND 6"
_TITLES = f"WITH {CLUSTERED}, rr AS (WITH {rake_sql(_LEADS, 12)}) SELECT g, array_to_string({_fold_sql('p', 4)}, ', ') AS terms FROM (SELECT g, list(phrase ORDER BY place) AS p FROM rr GROUP BY 1)"

#: Phrases that come first where they occur, and phrases that name the whole field.
PREFERRED, CONTEXT = ("field trial", "diary study", "visible map"), ("design theory", "design")


def preferred(s, d):
    c = clusters(s, d).where("cluster_theme_terms is not null and cluster >= 0").select("cluster_theme_terms").distinct()
    found = T.preferred_phrases(F.transform(F.split("cluster_theme_terms", ","), lambda x: F.trim(x)), PREFERRED, CONTEXT)
    return c.select("cluster_theme_terms", F.array_join(found, ", ").alias("phrases"))


_LIKED = ", ".join(f"'{w}'" for w in PREFERRED)
_FIELD = ", ".join(f"'{w}'" for w in CONTEXT)
_ORDER = f"list_transform(list_sort(list_transform(list_filter({_THEME_LIST}, lambda t: lower(trim(t)) NOT IN ({_FIELD})), lambda t, i: {{'a': CASE WHEN lower(trim(t)) IN ({_LIKED}) THEN 0 WHEN len(string_split_regex(trim(t), '\\s+')) > 1 THEN 1 ELSE 2 END, 'b': CASE WHEN lower(trim(t)) IN ({_LIKED}) THEN -length(t) ELSE 0 END, 'i': i, 't': t}})), lambda v: v.t)"
_PREF = f"SELECT cluster_theme_terms, array_to_string({_fold_sql(_ORDER, 4)}, ', ') AS phrases FROM (SELECT DISTINCT cluster_theme_terms FROM clustering_results WHERE cluster_theme_terms IS NOT NULL AND cluster >= 0)"

QUERIES = {
    "preferred_phrases": (preferred, _PREF),
    "theme_terms": (source_terms, _CT),
    "rake_phrases": (rake, f"WITH {PAPERS}, {rake_sql(_TT, 12)}"),
    "title_terms": (lambda s, d: T.title_terms(clustered(s, d), "g", "title", "rank"), _TITLES),
    "dominant_keywords": (dominant, f"""WITH {CLUSTERED}, n AS (SELECT g, keyword, count(*) AS n FROM cp GROUP BY 1, 2), r AS (SELECT g, CAST(row_number() OVER (PARTITION BY g ORDER BY n DESC, keyword) AS INTEGER) AS place, keyword, n FROM n)
SELECT * FROM r WHERE place <= 2"""),
    "label_terms": (label_terms, _LABELS),
    "evidence_terms": (evidence_terms, _EVID),
    "lda_topics": (lambda s, d: T.lda_topics(papers(s, d).select("paper_id", F.concat_ws(" ", "title", "abstract").alias("text")), "paper_id", "text", rounds=5), None),
}
