"""Preparation, lookups, gates: R-operators of the survey."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelight.functions import text as X
from quirelight.operators import contexts as C
from quirelight.operators import relational as R
from quirelight.queries.base import CONTEXTS, KEYWORDS, PAPERS, canon, clusters, contexts, papers, sq, txt
from quirelight.session import table


def keyword_leaders(spark, d):
    """Of every keyword group large enough the three papers that speak most of it."""
    p = papers(spark, d)
    ks = R.paper_keywords(p)
    gate = R.size_gate(ks).where("status = 'clustered'")
    score = X.relevance(F.concat_ws(" ", "title", "abstract"), C.CONTEXT_TERMS) + X.relevance(F.concat_ws(" ", "title", "abstract"), ("practitioners", "diary study", "pattern"))
    from pyspark.sql import Window as W

    s = ks.join(p.select("paper_id", score.alias("score")), "paper_id").join(gate.select("keyword", "n"), "keyword")
    place = F.row_number().over(W.partitionBy("keyword").orderBy(F.desc("score"), "paper_id"))
    return s.withColumn("place", place).where("place <= 3").select("keyword", "n", "place", "paper_id", "score")


def _count_sql(col: str, term: str) -> str:
    """Boundary occurrences in RE2, which has no lookaround: separators are doubled first."""
    d = "".join(ch if ch.isalnum() else ch * 2 for ch in term)
    return f"len(regexp_extract_all('  ' || regexp_replace({col}, '([^a-z0-9])', '\\1\\1', 'g') || '  ', '[^a-z0-9]{d}[^a-z0-9]'))"


def relevance_sql(col: str, terms) -> str:
    return " + ".join(f"{_count_sql(col, t)} * {4 if ' ' in t else 1}" for t in dict.fromkeys(terms))


_LOW = f"lower({sq('title || chr(32) || abstract')})"
_LEADERS = f"""WITH {PAPERS}, {KEYWORDS},
g AS (SELECT keyword, count(DISTINCT paper_id) AS n FROM keywords GROUP BY 1 HAVING n >= 10),
s AS (SELECT paper_id, {relevance_sql('low', C.CONTEXT_TERMS)} + {relevance_sql('low', ('practitioners', 'diary study', 'pattern'))} AS score FROM (SELECT paper_id, {_LOW} AS low FROM papers)),
r AS (SELECT keyword, n, row_number() OVER (PARTITION BY keyword ORDER BY score DESC, paper_id) AS place, paper_id, score FROM keywords JOIN g USING (keyword) JOIN s USING (paper_id))
SELECT keyword, n, CAST(place AS INTEGER) AS place, paper_id, CAST(score AS INTEGER) AS score FROM r WHERE place <= 3"""

QUERIES = {
    "keyword_leaders": (keyword_leaders, _LEADERS),
    "prepare_papers": (lambda s, d: papers(s, d).select("paper_id", "title", "abstract", "keyword", "year"), f"WITH {PAPERS} SELECT paper_id, title, abstract, keyword, year FROM papers"),
    "keyword_counts": (lambda s, d: R.value_counts(papers(s, d), "keyword"), f"WITH {PAPERS} SELECT keyword, count(*) AS n FROM papers GROUP BY 1"),
    "distinct_keywords": (lambda s, d: R.paper_keywords(papers(s, d)).agg(F.countDistinct("keyword").alias("keywords"), F.countDistinct("paper_id").alias("papers")),
                          f"WITH {PAPERS}, {KEYWORDS} SELECT count(DISTINCT keyword) AS keywords, count(DISTINCT paper_id) AS papers FROM keywords"),
    "group_order": (lambda s, d: R.group_sizes(R.paper_keywords(papers(s, d))),
                    f"WITH {PAPERS}, {KEYWORDS}, n AS (SELECT keyword, count(DISTINCT paper_id) AS n FROM keywords GROUP BY 1) SELECT keyword, n, CAST(row_number() OVER (ORDER BY n DESC, lower(keyword), keyword) AS INTEGER) AS place FROM n"),
    "size_gate": (lambda s, d: R.size_gate(R.paper_keywords(papers(s, d))),
                  f"WITH {PAPERS}, {KEYWORDS} SELECT keyword, count(DISTINCT paper_id) AS n, CASE WHEN count(DISTINCT paper_id) < 10 THEN 'too_few_papers' ELSE 'clustered' END AS status FROM keywords GROUP BY 1"),
    "paper_keywords": (lambda s, d: R.paper_keywords(papers(s, d)), f"WITH {PAPERS}, {KEYWORDS} SELECT paper_id, CAST(position AS INTEGER) AS position, keyword FROM keywords"),
    "focus_filter": (lambda s, d: papers(s, d).where(X.has_keyword(F.col("keyword"), "design  Patterns")).select("paper_id", "keyword"),
                     f"WITH {PAPERS}, {KEYWORDS} SELECT paper_id, papers.keyword FROM papers WHERE paper_id IN (SELECT paper_id FROM keywords WHERE lower(keyword) = 'design patterns')"),
    "confirmed_papers": (lambda s, d: R.confirmed(papers(s, d), contexts(s, d).where("pdf_found")).select("paper_id", "title"),
                         f"WITH {PAPERS}, {CONTEXTS} SELECT paper_id, title FROM papers WHERE paper_id IN (SELECT paper_id FROM contexts WHERE pdf_found)"),
    "missing_files": (lambda s, d: R.missing_files(papers(s, d), contexts(s, d)).select("paper_id", "doi", "url"),
                      f"WITH {PAPERS}, {CONTEXTS} SELECT paper_id, doi, url FROM papers WHERE paper_id NOT IN (SELECT paper_id FROM contexts WHERE pdf_found AND pdf_extract_method <> 'failed')"),
    "with_context": (lambda s, d: R.with_context(papers(s, d).select("paper_id", "title"), contexts(s, d)),
                     f"""WITH {PAPERS}, {CONTEXTS} SELECT p.paper_id, p.title, coalesce(pdf_found, false) AS pdf_found, coalesce(pdf_extract_method, 'missing') AS pdf_extract_method, coalesce(full_text_chars, 0) AS full_text_chars,
  coalesce(paragraph_count, 0) AS paragraph_count, coalesce(matched_paragraph_count, 0) AS matched_paragraph_count, coalesce(discussion_found, false) AS discussion_found, coalesce(extracted_context, '') AS extracted_context,
  coalesce(discussion_summary, '') AS discussion_summary, coalesce(discussion_excerpt, '') AS discussion_excerpt FROM papers p LEFT JOIN contexts c USING (paper_id)"""),
    "coverage_report": (lambda s, d: R.coverage(contexts(s, d)),
                        f"""WITH {CONTEXTS} SELECT count(*) AS papers, count_if(coalesce(pdf_found, false)) AS found, count_if(coalesce(matched_paragraph_count, 0) > 0) AS matched, count_if(coalesce(discussion_found, false)) AS discussed,
  CAST(sum(coalesce(full_text_chars, 0)) AS BIGINT) AS characters FROM contexts"""),
}


# --- cluster lookups and updates ---

_KEY = ["run_id", "text_view", "cluster_method", "cluster"]


def cluster_sizes_on_rows(s, d):
    """Every clustered row with its cluster's number of papers (a lookup at cluster grain)."""
    c = clusters(s, d).where("cluster is not null").select(*_KEY, "paper_id").distinct()
    size = c.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("papers"))
    return c.join(size, _KEY)


def union_by_name(s, d):
    """Gated groups and clustered rows in one frame; what a side lacks is null."""
    gate = R.size_gate(R.paper_keywords(papers(s, d))).select(F.col("keyword").alias("focus_keyword"), F.col("status").alias("cluster_status"), "n")
    rows = clusters(s, d).select("focus_keyword", "cluster_status", "run_id", "paper_id").distinct()
    return rows.unionByName(gate, allowMissingColumns=True)


def noise_update(s, d):
    """Theme terms of noise clusters replaced by a fixed text, others kept."""
    c = clusters(s, d).select("run_id", "text_view", "cluster_method", "cluster", "paper_id", "cluster_theme_terms").distinct()
    change = c.where("cluster = -1").select(*_KEY).distinct().withColumn("cluster_theme_terms", F.lit("no theme")).withColumn("review_note", F.lit("noise"))
    return R.update_where(c, change, _KEY, ["cluster_theme_terms", "review_note"])


def k_limits(s, d):
    g = R.size_gate(R.paper_keywords(papers(s, d))).select("keyword", F.col("n").cast("int").alias("n"))
    low, high = R.cluster_bounds(F.col("n"))
    return g.withColumns({"k_cap": R.most_clusters(F.col("n")), "k_low": low, "k_high": high, **R.density_parameters(F.col("n"))})


_CAP = "CASE WHEN n < 4 THEN greatest(0, n - 1) WHEN n < 10 THEN 2 WHEN n < 20 THEN 3 WHEN n < 35 THEN 4 WHEN n < 60 THEN 5 WHEN n < 90 THEN 6 ELSE 8 END"


def candidate_links(s, d):
    """Links of every paper in order of their source, a repeated link where it comes first."""
    p = papers(s, d).select("paper_id", X.text("url").alias("url"), X.doi(F.col("doi")).alias("doi"))
    links = p.select("paper_id", F.posexplode(F.array(F.col("url"), F.when(F.col("doi") != "", F.concat(F.lit("https://resolver.example/"), "doi")), F.split("url", r"\?")[0])).alias("source", "link"))
    return R.first_candidates(links, "paper_id", "link", "source").select("paper_id", "link", "source", "place")


_DOI = "lower(trim(coalesce(doi, '')))"
for _p in X.DOI_PREFIXES:
    _DOI = f"CASE WHEN starts_with({_DOI}, '{_p}') THEN substr({_DOI}, {len(_p) + 1}) ELSE {_DOI} END"
_DOI = f"trim({_DOI})"


_ARX_DOI = "regexp_extract(coalesce(doi, ''), '(?i)10\\.48550/arxiv\\.([^/]+)$', 1)"
_ARX_URL = "regexp_replace(regexp_extract(coalesce(url, ''), '(?i)^[a-z]+://(?:www\\.)?arxiv\\.org/(?:[^?#]*/)?(?:abs|pdf)/([^/?#]+)', 1), '\\.pdf$', '')"
_ARX = f"CASE WHEN {_ARX_DOI} <> '' THEN {_ARX_DOI} ELSE {_ARX_URL} END"


def name_keys(s, d):
    p = papers(s, d)
    return p.select("paper_id", X.slug(F.col("title")).alias("slug"), X.safe_name(F.col("title")).alias("file_name"), X.doi(F.col("doi")).alias("doi_key"), X.title_key(F.col("title")).alias("title_key"),
                    X.arxiv_pdf(F.col("doi"), F.col("url")).alias("arxiv"), X.is_direct_pdf(F.col("url")).alias("direct_pdf"))


def acquisition_status(s, d):
    """What can be fetched: counts of found, failed, direct and unlinked papers."""
    j = R.with_context(papers(s, d).select("paper_id", "url", "doi"), contexts(s, d))
    status = (F.when(F.col("pdf_found") & (F.col("pdf_extract_method") != "failed"), "existing").when(F.col("pdf_extract_method") == "failed", "failed")
              .when(X.is_direct_pdf(F.col("url")), "direct").when(X.doi(F.col("doi")) != "", "resolvable").otherwise("no_open_pdf_candidate"))
    return j.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def cleaned_fields(s, d):
    """Flags, years and reasons of a paper as typed or filled values."""
    p = papers(s, d)
    year = F.regexp_extract(F.coalesce("year", F.lit("")), r"^\s*(\d{4})(?:\.0+)?\s*$", 1)
    return p.select("paper_id", X.is_true(F.col("fulltext_flag")).alias("has_fulltext"), F.coalesce(F.expr("try_cast(nullif(regexp_extract(coalesce(year, ''), '^\\\\s*(\\\\d{4})(?:\\\\.0+)?\\\\s*$', 1), '') as int)"), F.lit(0)).alias("year_number"),
                    F.coalesce("primary_reason", "val_reason", F.lit("")).alias("reason"),
                    F.lower(F.concat_ws(" ", X.text("title"), X.text("abstract"), X.text("primary_reason"), X.text("val_reason"))).alias("all_text"), (year != "").alias("year_is_clean"))


def term_lists(s, d):
    """Distinguishing terms of every cluster list, first spelling of each."""
    c = clusters(s, d).where("distinguishing_evidence_terms is not null").select("distinguishing_evidence_terms").distinct()
    return c.select("distinguishing_evidence_terms", F.posexplode(X.distinct_terms(X.terms(F.col("distinguishing_evidence_terms")))).alias("position", "term"))


QUERIES |= {
    "cluster_size_lookup": (cluster_sizes_on_rows, """WITH c AS (SELECT DISTINCT run_id, text_view, cluster_method, cluster, paper_id FROM clustering_results WHERE cluster IS NOT NULL)
SELECT run_id, text_view, cluster_method, CAST(cluster AS INTEGER) AS cluster, paper_id, count(*) OVER (PARTITION BY run_id, text_view, cluster_method, cluster) AS papers FROM c"""),
    "union_by_name": (union_by_name, f"""WITH {PAPERS}, {KEYWORDS} SELECT DISTINCT focus_keyword, cluster_status, run_id, paper_id, CAST(NULL AS BIGINT) AS n FROM clustering_results
UNION ALL SELECT keyword, CASE WHEN count(DISTINCT paper_id) < 10 THEN 'too_few_papers' ELSE 'clustered' END, NULL, NULL, count(DISTINCT paper_id) FROM keywords GROUP BY keyword"""),
    "noise_update": (noise_update, """SELECT DISTINCT run_id, text_view, cluster_method, CAST(cluster AS INTEGER) AS cluster, paper_id, CASE WHEN cluster = -1 THEN 'no theme' ELSE cluster_theme_terms END AS cluster_theme_terms,
CASE WHEN cluster = -1 THEN 'noise' ELSE '' END AS review_note FROM clustering_results"""),
    "k_limits": (k_limits, f"""WITH {PAPERS}, {KEYWORDS}, g AS (SELECT keyword, CAST(count(DISTINCT paper_id) AS INTEGER) AS n FROM keywords GROUP BY 1), u AS (SELECT *, {_CAP} AS k_cap FROM g)
SELECT keyword, n, CAST(k_cap AS INTEGER) AS k_cap, CAST(greatest(2, least(2, least(8, k_cap, n - 1))) AS INTEGER) AS k_low, CAST(least(8, k_cap, n - 1) AS INTEGER) AS k_high, CAST(least(5, greatest(2, n // 3)) AS INTEGER) AS min_cluster_size,
CAST(least(4, greatest(2, n // 4)) AS INTEGER) AS min_samples, CAST(least(6, greatest(2, n - 1)) AS INTEGER) AS topics FROM u"""),
    "row_slice": (lambda s, d: R.rows_between(papers(s, d), "input_row", 11, 25).select("input_row", "paper_id"), f"WITH {PAPERS} SELECT input_row, paper_id FROM papers ORDER BY input_row LIMIT 25 OFFSET 10"),
    "candidate_links": (candidate_links, f"""WITH {PAPERS}, p AS (SELECT paper_id, {txt('url')} AS url, {_DOI} AS doi FROM papers),
l AS (SELECT paper_id, 0 AS source, url AS link FROM p UNION ALL SELECT paper_id, 1, 'https://resolver.example/' || doi FROM p WHERE doi <> '' UNION ALL SELECT paper_id, 2, string_split(url, '?')[1] FROM p),
b AS (SELECT paper_id, link, min(source) AS source FROM l WHERE link <> '' GROUP BY 1, 2)
SELECT paper_id, link, CAST(source AS INTEGER) AS source, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY source, link) AS INTEGER) AS place FROM b"""),
    "name_keys": (name_keys, f"""WITH {PAPERS} SELECT paper_id, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug,
CASE WHEN regexp_replace(regexp_replace(trim(title), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') = '' THEN 'paper' ELSE regexp_replace(regexp_replace(trim(title), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') END AS file_name,
{_DOI} AS doi_key, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS title_key, CASE WHEN ({_ARX}) <> '' THEN 'https://arxiv.org/pdf/' || ({_ARX}) || '.pdf' ELSE '' END AS arxiv,
coalesce(regexp_matches(string_split(url, '?')[1], '(?i)\\.pdf$'), false) AS direct_pdf FROM papers"""),
    "acquisition_status": (acquisition_status, f"""WITH {PAPERS}, {CONTEXTS} SELECT CASE WHEN coalesce(pdf_found, false) AND coalesce(pdf_extract_method, 'missing') <> 'failed' THEN 'existing' WHEN pdf_extract_method = 'failed' THEN 'failed'
WHEN coalesce(regexp_matches(string_split(url, '?')[1], '(?i)\\.pdf$'), false) THEN 'direct' WHEN {_DOI} <> '' THEN 'resolvable' ELSE 'no_open_pdf_candidate' END AS status, count(*) AS n FROM papers p LEFT JOIN contexts c USING (paper_id) GROUP BY 1"""),
    "cleaned_fields": (cleaned_fields, f"""WITH {PAPERS} SELECT paper_id, lower(trim(coalesce(fulltext_flag, ''))) IN ('1', 'true', 'yes', 'y') AS has_fulltext, coalesce(try_cast(nullif(regexp_extract(coalesce(year, ''), '^\\s*(\\d{{4}})(?:\\.0+)?\\s*$', 1), '') AS INTEGER), 0) AS year_number,
coalesce(primary_reason, val_reason, '') AS reason, lower(title || ' ' || abstract || ' ' || {txt('primary_reason')} || ' ' || {txt('val_reason')}) AS all_text, regexp_matches(coalesce(year, ''), '^\\s*(\\d{{4}})(?:\\.0+)?\\s*$') AS year_is_clean FROM papers"""),
    "term_lists": (term_lists, f"""WITH c AS (SELECT DISTINCT distinguishing_evidence_terms FROM clustering_results WHERE distinguishing_evidence_terms IS NOT NULL),
l AS (SELECT distinguishing_evidence_terms, string_split(distinguishing_evidence_terms, ',') AS _l FROM c), e AS (SELECT distinguishing_evidence_terms, unnest(_l) AS t, generate_subscripts(_l, 1) AS i FROM l),
f AS (SELECT distinguishing_evidence_terms, trim(t) AS term, i, row_number() OVER (PARTITION BY distinguishing_evidence_terms, lower({sq('trim(t)')}) ORDER BY i) AS r FROM e WHERE trim(t) <> '' AND lower(trim(t)) <> 'nan')
SELECT distinguishing_evidence_terms, CAST(row_number() OVER (PARTITION BY distinguishing_evidence_terms ORDER BY i) - 1 AS INTEGER) AS position, term FROM f WHERE r = 1"""),
}
