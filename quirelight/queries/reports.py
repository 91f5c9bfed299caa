"""Sources, sinks and reports: S- and O-operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelight.functions import display as D
from quirelight.functions import text as X
from quirelight.functions.fuzzy import same_title
from quirelight.operators import coding as Y
from quirelight.operators import relational as R
from quirelight.queries.base import KEYWORDS, PAPERS, clusters, papers
from quirelight.queries.coding import _CON, _PAT, LEXICON, real
from quirelight.session import scratch_path, table
from quirelight.sources import readers, writers


def csv_round_trip(s, d):
    """The prepared papers written as CSV and read again."""
    p = papers(s, d).select("paper_id", "title", "abstract", "keyword", F.coalesce("year", F.lit("")).alias("year"))
    path = scratch_path(s, "csv")
    writers.write_csv(p, path)
    return readers.read_csv(s, path, p.schema)


def run_metadata(s, d):
    m = writers.run_metadata(R.paper_keywords(papers(s, d)), ["kmeans", "hdbscan"], "overall", "tfidf-svd", 10)
    return m.select("paper_count", "keyword_count", "text_view", "embedding", "min_papers_to_cluster", F.array_join("methods", "|").alias("methods"),
                    F.array_join(F.transform(F.map_entries("keyword_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "; ").alias("counts"))


def _rows(s, d):
    c = clusters(s, d).where("cluster >= 0 and focus_keyword is not null")
    return c.groupBy(F.col("focus_keyword").alias("keyword"), "cluster_method", "cluster", "paper_id").agg(F.min("title").alias("title"), F.min(F.when(F.col("representative_rank") >= 1, F.col("representative_rank"))).alias("rank"), F.max("cluster_theme_terms").alias("theme"))


def cluster_report(s, d):
    return writers.cluster_lines(_rows(s, d))


_REP = """WITH c AS (SELECT focus_keyword AS keyword, cluster_method, CAST(cluster AS INTEGER) AS cluster, paper_id, min(title) AS title, CAST(min(CASE WHEN representative_rank >= 1 THEN representative_rank END) AS INTEGER) AS rank, max(cluster_theme_terms) AS theme
FROM clustering_results WHERE cluster >= 0 AND focus_keyword IS NOT NULL GROUP BY 1, 2, 3, 4),
g AS (SELECT keyword, cluster_method, cluster, count(DISTINCT paper_id) AS n, max(theme) AS theme, (list(title ORDER BY rank, paper_id) FILTER (WHERE rank BETWEEN 1 AND 3))[1:3] AS lead FROM c GROUP BY 1, 2, 3)
SELECT keyword, cluster_method, cluster, '- **' || keyword || ' / ' || cluster_method || ' / ' || cluster || '** (' || n || ' papers): ' || coalesce(theme, '') || CASE WHEN len(lead) > 0 THEN '. Read first: ' || array_to_string(lead, '; ') ELSE '' END AS line FROM g"""


def embedded_payload(s, d):
    """A page per event with its properties embedded, and the properties read back from it."""
    e = table(s, d, "events").select("event_id", "props")
    page = F.concat(F.lit('<html><script type="application/json" id="payload">'), F.col("props"), F.lit("</script></html>"))
    kind = "map<string,string>"
    back = e.withColumns({"got": readers.embedded_json(page, "payload", kind), "want": F.from_json("props", kind)})
    same = F.sort_array(F.map_entries("got")) == F.sort_array(F.map_entries("want"))
    return back.select("event_id", F.array_join(F.array_sort(F.map_keys("got")), ",").alias("keys"), same.alias("same"))


def explorer(s, d):
    """The explorer payload of every run, read back: papers and clusters it carries."""
    c = clusters(s, d).where("cluster is not null").groupBy("run_id", "cluster", "paper_id").agg(F.min("title").alias("title"), F.min("umap_x").alias("x"), F.min("umap_y").alias("y"))
    k = c.groupBy("run_id", "cluster").agg(F.count(F.lit(1)).alias("n")).withColumn("label", F.concat(F.lit("Cluster "), F.col("cluster").cast("string")))
    p = writers.explorer_payload("Explorer", c, k, "run_id", 50)
    x = F.from_json("payload", "title string, papers array<struct<paper_id string, title string, cluster int, x double, y double>>, clusters array<struct<cluster int, label string, n bigint>>")
    v = p.select("run_id", x.alias("v")).select("run_id", F.size("v.papers").alias("p"), F.size("v.clusters").alias("c"), F.aggregate("v.clusters", F.lit(0).cast("bigint"), lambda a, b: a + b["n"]).alias("t"))
    return v.groupBy("run_id").agg(F.sum("p").alias("papers"), F.max("c").alias("clusters"), F.max("t").alias("total"))


def matching_titles(s, d):
    """Papers of one DOI whose titles count as the same."""
    p = papers(s, d).select("paper_id", "title", X.doi(F.col("doi")).alias("k")).where("k != ''")
    a, b = p.alias("a"), p.alias("b")
    j = a.join(b, "k").where("a.paper_id < b.paper_id")
    return j.where(same_title(F.col("a.title"), F.col("b.title"))).select(F.col("a.paper_id").alias("paper_id_a"), F.col("b.paper_id").alias("paper_id_b"))


def display_titles(s, d):
    return papers(s, d).where("title != ''").select("paper_id", D.title_case(F.col("title")).alias("shown"))


_SMALL = ", ".join(f"'{w}'" for w in D.SMALL)
_FIX = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in D.SPELLINGS.items())
_SHOW = f"""WITH {PAPERS} SELECT paper_id, array_to_string(list_transform(string_split(lower(title), ' '), lambda w, i: CASE w {_FIX} ELSE CASE WHEN i > 1 AND w IN ({_SMALL}) THEN w ELSE upper(substr(w, 1, 1)) || substr(w, 2) END END), ' ') AS shown FROM papers WHERE title <> ''"""


def contribution_texts(s, d):
    c = Y.contribution(real(s, d), "g", "paper_id", "low")
    return c.select("g", D.definition(F.col("contribution")).alias("definition"), D.support_text(F.col("support"), F.col("n")).alias("support_text"))


_DEF = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in D.DEFINITIONS.items())


def claims(s, d):
    """A claim sentence per paper of the real clusters: form and role by their lexicons."""
    top = Y.group_scores(real(s, d), ["g", "paper_id"], "low", LEXICON, 1)
    return top.select("g", "paper_id", D.claim(F.lit("design paper"), F.lit("offers a"), F.col("label")).alias("claim"))


QUERIES = {
    "matching_titles": (matching_titles, None),
    "display_titles": (display_titles, _SHOW),
    "contribution_texts": (contribution_texts, f"SELECT g, CASE contribution {_DEF} END AS definition, support || ' of ' || n || CASE WHEN n = 1 THEN ' paper' ELSE ' papers' END AS support_text FROM (WITH {_CON} SELECT * FROM co)"),
    "cluster_claims": (claims, f"SELECT g, paper_id, 'Design Paper that offers a ' || label || '.' AS claim FROM ({_PAT}) WHERE place = 1"),
    "first_domain": (lambda s, d: clusters(s, d).select("run_id", "paper_id", D.first_value("application_domains", "distinguishing_evidence_terms", "cluster_theme_terms").alias("first")).distinct(),
                     "SELECT DISTINCT run_id, paper_id, coalesce(nullif(trim(string_split(coalesce(application_domains, ''), ',')[1]), ''), nullif(trim(string_split(coalesce(distinguishing_evidence_terms, ''), ',')[1]), ''), nullif(trim(string_split(coalesce(cluster_theme_terms, ''), ',')[1]), ''), '') AS first FROM clustering_results"),
    "csv_round_trip": (csv_round_trip, f"WITH {PAPERS} SELECT paper_id, title, abstract, keyword, coalesce(year, '') AS year FROM papers"),
    "run_metadata": (run_metadata, f"""WITH {PAPERS}, {KEYWORDS}, n AS (SELECT keyword, count(DISTINCT paper_id) AS n FROM keywords GROUP BY 1) SELECT (SELECT count(DISTINCT paper_id) FROM keywords) AS paper_count, count(*) AS keyword_count, 'overall' AS text_view, 'tfidf-svd' AS embedding,
10 AS min_papers_to_cluster, 'kmeans|hdbscan' AS methods, string_agg(keyword || '=' || n, '; ' ORDER BY keyword) AS counts FROM n"""),
    "cluster_report": (cluster_report, _REP),
    "embedded_payload": (embedded_payload, "SELECT event_id, array_to_string(list_sort(json_keys(props)), ',') AS keys, true AS same FROM events"),
    "explorer_payload": (explorer, """WITH c AS (SELECT run_id, cluster, paper_id FROM clustering_results WHERE cluster IS NOT NULL GROUP BY ALL) SELECT run_id, count(*) AS papers, CAST(count(DISTINCT cluster) AS INTEGER) AS clusters, count(*) AS total FROM c GROUP BY 1"""),
}
