"""Registered queries p1_ to p10_ over the test tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelight.llm import distinctive, leakage, mixing, near_dup, scan_repair, sentences, spam, subjects, themes, topn
from quirelight.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    got = distinctive.distinctive_terms(table(spark, d, "final_advancing_list"), table(spark, d, "clustering_results"))
    return got.select("record_kind", "record_key", "term")


def p1_scores(spark: SparkSession, d: str) -> DataFrame:
    """The same terms with their counts and log-likelihood ratio."""
    got = distinctive.distinctive_terms(table(spark, d, "final_advancing_list"), table(spark, d, "clustering_results"))
    return got.select("record_kind", "record_key", "term", "n", "n_records", F.round("g2", 3).alias("g2"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.passage_sentences(table(spark, d, "build_fulltext_context"), table(spark, d, "evidence_items"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.versions_of_works(table(spark, d, "final_advancing_list"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return themes.theme_pairs(themes.themes(table(spark, d, "final_advancing_list")))


def p4_themes(spark: SparkSession, d: str) -> DataFrame:
    return themes.themes(table(spark, d, "final_advancing_list"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subject_areas(table(spark, d, "final_advancing_list"), table(spark, d, "area_labels")).select("paper_id", "area")


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    return subjects.area_shares(subjects.subject_areas(table(spark, d, "final_advancing_list"), table(spark, d, "area_labels")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.leading_papers(table(spark, d, "clustering_results")).select("run_id", "text_view", "cluster_method", "cluster", "paper_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return scan_repair.damaged_places(table(spark, d, "build_fulltext_context"), table(spark, d, "final_advancing_list"))


def p7_texts(spark: SparkSession, d: str) -> DataFrame:
    return scan_repair.repaired_texts(table(spark, d, "build_fulltext_context"), table(spark, d, "final_advancing_list"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items")).select("item_id", "doc_id")


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.reached_shares(mixing.mix(table(spark, d, "documents"), targets), targets)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.stuffed_pages(table(spark, d, "documents")).select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(v)}


_P1_SQL = """
WITH paper AS (
  SELECT paper_id, arg_min(abstract, input_row) AS abstract FROM final_advancing_list WHERE paper_id IS NOT NULL GROUP BY paper_id),
word AS (
  SELECT paper_id, unnest(regexp_extract_all(lower(abstract), '\\p{L}{3,}')) AS term FROM paper
  WHERE lower(trim(regexp_replace(abstract, '[\\s\\x{a0}]+', ' ', 'g'))) NOT IN ('', 'nan')),
held AS (SELECT paper_id, term, count(*) AS n FROM word GROUP BY 1, 2),
few AS (SELECT term FROM held GROUP BY term HAVING count(*) BETWEEN 2 AND 8),
entry AS (
  SELECT concat_ws('|', coalesce(run_id, ''), coalesce(text_view, ''), coalesce(cluster_method, ''), CAST(CAST(cluster AS INTEGER) AS VARCHAR)) AS record_key,
         trim(regexp_replace(lower(unnest(string_split(distinguishing_evidence_terms, ','))), '[\\s\\x{a0}]+', ' ', 'g')) AS term
  FROM clustering_results WHERE cluster >= 0),
kept AS (SELECT DISTINCT record_key, term FROM entry WHERE term NOT IN ('', 'n/a')),
rare AS (SELECT term FROM kept GROUP BY term HAVING count(*) BETWEEN 2 AND 8)
SELECT 'paper' AS record_kind, paper_id AS record_key, term FROM held JOIN few USING (term) WHERE n >= 2
UNION ALL
SELECT 'cluster', record_key, term FROM kept JOIN rare USING (term)
"""

def _xlx(c: str) -> str:
    return f"(CASE WHEN {c} > 0 THEN {c} * ln({c}) ELSE 0 END)"


def _g2(a: str, rt: str, tt: str, n: str) -> str:
    """Dunning's ratio of a term counted ``a`` times in a record of ``rt`` and ``tt`` times in ``n`` in all."""
    cells = [a, f"({rt} - {a})", f"({tt} - {a})", f"({n} - {rt} - {tt} + {a})", n]
    margins = [rt, f"({n} - {rt})", tt, f"({n} - {tt})"]
    sign = f"CASE WHEN {a} * ({n} - {rt}) >= ({tt} - {a}) * {rt} THEN 2 ELSE -2 END"
    return f"round({sign} * ({' + '.join(_xlx(f'CAST({c} AS DOUBLE)') for c in cells)} - {' - '.join(_xlx(f'CAST({c} AS DOUBLE)') for c in margins)}), 3)"


_P1_SCORES = _P1_SQL.split("SELECT 'paper' AS record_kind")[0].rstrip() + f""",
pr AS (SELECT paper_id, sum(n) AS rt FROM held GROUP BY 1), pt AS (SELECT term, sum(n) AS tt, count(*) AS k FROM held GROUP BY 1), pn AS (SELECT sum(n) AS total FROM held),
cr AS (SELECT record_key, count(*) AS rt FROM kept GROUP BY 1), ct AS (SELECT term, count(*) AS tt FROM kept GROUP BY 1), cn AS (SELECT count(*) AS total FROM kept)
SELECT 'paper' AS record_kind, paper_id AS record_key, term, n, k AS n_records, {_g2('n', 'rt', 'tt', 'total')} AS g2 FROM held JOIN few USING (term) JOIN pr USING (paper_id) JOIN pt USING (term), pn WHERE n >= 2
UNION ALL
SELECT 'cluster', record_key, term, 1, tt, {_g2('1', 'rt', 'tt', 'total')} FROM kept JOIN rare USING (term) JOIN cr USING (record_key) JOIN ct USING (term), cn
"""

_P6_SQL = """
WITH best AS (
  SELECT run_id, text_view, cluster_method, cluster, paper_id, min((representative_rank, coalesce(medoid_rank, 2147483647))) AS k
  FROM clustering_results WHERE cluster >= 0 AND representative_rank >= 1 AND paper_id IS NOT NULL GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY run_id, text_view, cluster_method, cluster ORDER BY k, paper_id) AS p FROM best)
SELECT run_id, text_view, cluster_method, CAST(cluster AS INTEGER) AS cluster, paper_id FROM placed WHERE p <= 3
"""

_P3_SQL = """
WITH paper AS (SELECT paper_id, arg_min({'t': title, 'a': abstract, 'd': doi}, input_row) AS r FROM final_advancing_list WHERE paper_id IS NOT NULL GROUP BY paper_id),
one AS (
  SELECT paper_id, regexp_extract_all(lower(r.a), '[\\p{L}\\p{N}]+') AS w, coalesce(lower(trim(r.a)) IN ('', 'nan'), true) AS blank, array_to_string(regexp_extract_all(lower(r.t), '[\\p{L}\\p{N}]+'), ' ') AS t,
         CASE WHEN lower(trim(r.d)) IN ('', 'nan') THEN NULL ELSE nullif(regexp_replace(lower(trim(r.d)), '^(?:https?://[^/]*/|doi\\s*:?\\s*)+', ''), '') END AS d FROM paper),
sh AS (SELECT DISTINCT paper_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM one WHERE NOT blank),
n AS (SELECT paper_id, count(*) AS n FROM sh GROUP BY 1),
c AS (SELECT a.paper_id AS x, b.paper_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.paper_id < b.paper_id GROUP BY 1, 2)
SELECT x AS paper_id_a, y AS paper_id_b FROM c JOIN n p ON p.paper_id = x JOIN n q ON q.paper_id = y WHERE 2 * k >= p.n + q.n - k
UNION
SELECT least(a.paper_id, b.paper_id), greatest(a.paper_id, b.paper_id) FROM one a JOIN one b ON a.t = b.t AND a.d = b.d AND a.paper_id <> b.paper_id WHERE a.blank AND a.t <> ''
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": _P1_SQL, "p1_scores": _P1_SCORES, "p3_found": _P3_SQL, "p6_found": _P6_SQL}
