"""Evidence, faithfulness and labels: E- and L-operators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirelight.functions import text as X
from quirelight.operators import coding as Y
from quirelight.operators import evidence as E
from quirelight.operators import labels as L

from quirelight.queries.coding import _CON, _DOM, _MOV, real
from quirelight.queries.base import PAPERS, papers
from quirelight.session import table

_GEN = ", ".join(f"'{g}'" for g in X.GENERIC_ROOTS)


def roots_sql(c: str) -> str:
    stem = "CASE WHEN length(x) > 4 AND ends_with(x, 'ies') THEN substr(x, 1, length(x) - 3) || 'y' WHEN length(x) > 3 AND ends_with(x, 'es') AND NOT ends_with(x, 'ses') THEN substr(x, 1, length(x) - 2) WHEN length(x) > 3 AND ends_with(x, 's') THEN substr(x, 1, length(x) - 1) ELSE x END"
    return f"list_filter(list_distinct(list_transform(regexp_extract_all(lower({c}), '[a-z0-9][a-z0-9''-]*'), lambda x: {stem})), lambda r: r NOT IN ({_GEN}) AND length(r) >= 3)"


def passages(s, d):
    return table(s, d, "evidence_items").where("sentences is not null").select("id", "paper_id", "paragraph_index", "sentences").distinct()


_PASS = "pa AS (SELECT DISTINCT id, paper_id, paragraph_index, sentences FROM evidence_items WHERE sentences IS NOT NULL)"
_CITES = " + ".join("len(regexp_extract_all(sentences, '" + p.replace("'", "''") + "'))" for p in X.CITATIONS)
_DENS = f"100.0 * ({_CITES}) / greatest(1, len(regexp_extract_all(lower(sentences), '[a-z0-9][a-z0-9''-]*')))"


def passage_roots(s, d):
    return passages(s, d).select("id", "sentences", F.explode(X.roots(F.col("sentences"))).alias("root"))


TERMS = ("field trial", "visible map", "engineers", "recommender", "structure")
KEYS = ("design theory", "portrait")


def scored(s, d):
    p = passages(s, d)
    rep = F.pmod(F.col("paragraph_index"), F.lit(2)) == 0
    return p.withColumn("b", E.score_paragraph(F.col("sentences"), F.array(*[F.lit(t) for t in TERMS]), F.array(*[F.lit(k) for k in KEYS]), F.coalesce(rep, F.lit(False))))


def paragraph_evidence(s, d):
    return scored(s, d).select("id", "sentences", *[F.round(f"b.{c}", 6).alias(c) for c in ("total", "term_overlap", "first_person", "action", "keyword", "citation_penalty", "representative_bonus")], F.array_join("b.reasons", ",").alias("reasons"))


def _evidence_sql() -> str:
    multi, single = [t for t in TERMS if " " in t], [t for t in TERMS if " " not in t]
    over = " + ".join(f"3.0 * CAST(contains(low, '{t}') AS INTEGER)" for t in multi) + f" + len(list_intersect({roots_sql('sentences')}, {roots_sql(chr(39) + ' '.join(single) + chr(39)).replace('lower(', 'lower(')}))"
    own = f"least(8.0, 4.0 * ({' + '.join(f'CAST(contains(low, {chr(39)}{w}{chr(39)}) AS INTEGER)' for w in E.OWN_CLAIMS)}))"
    act = f"least(6.0, {' + '.join('2.0 * CAST(' + ' OR '.join(f'contains(low, {chr(39)}{w}{chr(39)})' for w in ws) + ' AS INTEGER)' for ws in E.ACTIONS.values())})"
    key = " + ".join(f"{2.0 if ' ' in k else 1.0} * CAST(contains(low, '{k}') AS INTEGER)" for k in KEYS)
    return f"""WITH {_PASS}, x AS (SELECT *, lower(sentences) AS low, {_DENS} AS dens FROM pa), y AS (SELECT id, sentences, {over} AS term_overlap, {own} AS first_person, {act} AS action, {key} AS keyword,
CASE WHEN dens > 1.5 THEN least(6.0, 1.5 * (dens - 1.5)) ELSE 0 END + CASE WHEN regexp_matches(low, '{E.RELATED_CUE}') THEN 4.0 ELSE 0 END AS citation_penalty, CASE WHEN ((paragraph_index % 2) + 2) % 2 = 0 THEN 1.5 ELSE 0 END AS representative_bonus FROM x)
SELECT id, sentences, round(CAST(term_overlap + first_person + action + keyword + representative_bonus - citation_penalty AS DOUBLE), 6) AS total, CAST(term_overlap AS DOUBLE) AS term_overlap, CAST(first_person AS DOUBLE) AS first_person, CAST(action AS DOUBLE) AS action,
CAST(keyword AS DOUBLE) AS keyword, round(CAST(citation_penalty AS DOUBLE), 6) AS citation_penalty, CAST(representative_bonus AS DOUBLE) AS representative_bonus,
concat_ws(',', CASE WHEN term_overlap > 0 THEN 'shares terms' END, CASE WHEN first_person > 0 THEN 'own claim' END, CASE WHEN action > 0 THEN 'action' END, CASE WHEN keyword > 0 THEN 'keyword' END, CASE WHEN representative_bonus > 0 THEN 'representative' END, CASE WHEN citation_penalty > 0 THEN 'citations' END) AS reasons FROM y"""


def claims(s, d):
    return passages(s, d).select("id", "sentences", E.claim_sentences(F.col("sentences"), F.array(*[F.lit(t) for t in TERMS])).alias("claim"))


def _claims_sql() -> str:
    from quirelight.queries.texts import _SENT

    own = " OR ".join(f"contains(lower(t), '{w}')" for w in E.OWN_CLAIMS)
    want = roots_sql("'" + " ".join(TERMS) + "'")
    return f"""WITH {_PASS}, l AS (SELECT id, paper_id, paragraph_index, sentences, {_SENT.format('sentences')} AS l FROM pa), t AS (SELECT id, paper_id, paragraph_index, sentences, trim(unnest(l)) AS t, generate_subscripts(l, 1) AS i FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY id, paper_id, paragraph_index, sentences ORDER BY CAST(({own}) AS INTEGER) DESC, len(list_intersect({roots_sql('t')}, {want})) DESC, i) AS p FROM t WHERE t <> ''),
c AS (SELECT id, paper_id, paragraph_index, sentences, string_agg(t, ' ' ORDER BY i) AS claim FROM r WHERE p <= 2 GROUP BY ALL)
SELECT pa.id, pa.sentences, coalesce(claim, substr(pa.sentences, 1, 300)) AS claim FROM pa LEFT JOIN c ON pa.id = c.id AND pa.paper_id IS NOT DISTINCT FROM c.paper_id AND pa.paragraph_index IS NOT DISTINCT FROM c.paragraph_index AND pa.sentences = c.sentences"""


def evidence_selection(s, d):
    """The best evidence of every fifth of the papers, as clusters."""
    e = scored(s, d).withColumn("g", F.abs(F.hash("paper_id")) % 5)
    c = e.select("g", "paper_id", "paragraph_index", F.col("sentences").alias("paragraph"), E.claim_sentences(F.col("sentences"), F.array(*[F.lit(t) for t in TERMS])).alias("sentences"), F.col("b.total").alias("score"))
    return E.select_evidence(c, "g", least_score=1.0)


def support(s, d):
    """Titles as claims against the evidence passages of their papers."""
    c = papers(s, d).select("paper_id", F.col("title").alias("claim"))
    e = passages(s, d).select("paper_id", F.col("sentences").alias("passage"))
    return E.claim_support(c.join(e.select("paper_id").distinct(), "paper_id", "left_semi"), e, "paper_id", "claim", "passage")


_SUP = f"""WITH {PAPERS}, {_PASS}, e AS (SELECT DISTINCT paper_id, {roots_sql('sentences')} AS er FROM pa), c AS (SELECT paper_id, title AS claim, {roots_sql('title')} AS r FROM papers WHERE paper_id IN (SELECT paper_id FROM e)),
s AS (SELECT paper_id, claim, max(CASE WHEN len(r) = 0 THEN 1.0 ELSE len(list_intersect(r, er)) / len(r) END) AS best FROM c JOIN e USING (paper_id) GROUP BY 1, 2)"""


def faithfulness(s, d):
    g = support(s, d).withColumn("g", F.substring("paper_id", 1, 1))
    return E.faithfulness(g, "g")


def _summaries(s, d):
    r = real(s, d)
    code = Y.contribution(r, "g", "paper_id", "low").join(Y.theory_move(r, "g", "paper_id", "low").select("g", "move"), "g")
    dom = Y.domains(r, "g", "paper_id", "low").where("place = 1").select("g", "domain")
    lead = F.transform(F.array_sort(F.collect_list(F.when(F.col("rank").between(1, 3), F.struct("rank", "paper_id", "title")))), lambda x: x["title"])
    t = r.groupBy("g").agg(lead.alias("titles"), F.min("cluster").alias("cluster"), F.min(F.substring_index("g", "|", 2)).alias("run"))
    j = code.join(dom, "g").join(t, "g").withColumn("move", Y.conditional_move(F.col("contribution"), F.col("secondary"), F.col("move"))).withColumn("form", F.lit("papers")).withColumn("subtype", F.lit(""))
    return j.withColumn("label", L.hierarchical_label("form", "contribution", "secondary", "subtype", "move", "domain")).withColumn("summary", L.base_summary("n", "contribution", "domain", "titles"))


def cluster_labels(s, d):
    return _summaries(s, d).select("g", "cluster", "run", "label", "summary")


def _cap(c: str) -> str:
    return f"upper(substr({c}, 1, 1)) || substr({c}, 2)"


_LAB = f"""con AS (WITH {_CON} SELECT * FROM co), mov AS (WITH {_MOV} SELECT g, move FROM mo), dom AS (SELECT g, domain FROM ({_DOM}) WHERE place = 1), rea AS (WITH {_CON} SELECT * FROM re),
ti AS (SELECT g, list(title ORDER BY rank, paper_id) FILTER (WHERE rank BETWEEN 1 AND 3) AS titles, min(cluster) AS cluster, min(string_split(g, '|')[1] || '|' || string_split(g, '|')[2]) AS run FROM rea GROUP BY 1),
la AS (SELECT g, cluster, run, contribution, domain, titles, 'Papers: ' || {_cap('contribution')} || CASE WHEN secondary <> '' THEN ' + ' || {_cap('secondary')} ELSE '' END || CASE WHEN contribution = 'theoretical' OR secondary = 'theoretical' THEN ' — ' || {_cap('move')} ELSE '' END || ' | Primary Domain: ' || {_cap('domain')} AS label,
'This cluster holds ' || n || CASE WHEN n = 1 THEN ' paper' ELSE ' papers' END || ' with a mainly ' || contribution || ' contribution in ' || domain || '.' || CASE WHEN len(titles) > 0 THEN ' Representative papers: ' || array_to_string(titles[1:2], '; ') || '.' ELSE '' END AS summary FROM con JOIN mov USING (g) JOIN dom USING (g) JOIN ti USING (g))"""


def distinct_labels(s, d):
    x = _summaries(s, d).withColumn("extra", L.suffix(F.col("domain"), F.col("titles")))
    return L.distinct_labels(x, ["run"], "cluster", "label", "extra").select("g", L.numbered(F.col("cluster"), F.col("final_label")).alias("final_label"))


def theme_lists(s, d):
    c = table(s, d, "clustering_results").where("cluster_theme_terms is not null and cluster is not null")
    return c.select("run_id", "text_view", "cluster_method", "cluster", F.transform(F.split("cluster_theme_terms", ","), lambda x: F.trim(x)).alias("phrases")).distinct()


def unique_phrases(s, d):
    u = L.unique_phrases(theme_lists(s, d), ["run_id", "text_view", "cluster_method"], "cluster", "phrases")
    return u.select("run_id", "text_view", "cluster_method", "cluster", F.array_join("unique", "; ").alias("own"))


_UNI = f"""WITH c AS (SELECT DISTINCT run_id, text_view, cluster_method, cluster, trim(unnest(string_split(cluster_theme_terms, ','))) AS phrase FROM clustering_results WHERE cluster >= 0 AND cluster_theme_terms IS NOT NULL),
m AS (SELECT run_id, text_view, cluster_method FROM c GROUP BY ALL HAVING count(DISTINCT cluster) >= 2), p AS (SELECT c.* FROM c SEMI JOIN m USING (run_id, text_view, cluster_method)),
r AS (SELECT DISTINCT run_id, text_view, cluster_method, cluster, phrase, CASE WHEN length(w) > 4 AND ends_with(w, 's') THEN substr(w, 1, length(w) - 1) ELSE w END AS root FROM (SELECT *, unnest(string_split_regex(lower(trim(phrase)), '\\s+')) AS w FROM p)),
k AS (SELECT run_id, text_view, cluster_method, root, count(DISTINCT cluster) AS n FROM r GROUP BY ALL), x AS (SELECT run_id, text_view, cluster_method, cluster, phrase, max(n) AS n FROM r JOIN k USING (run_id, text_view, cluster_method, root) GROUP BY ALL)
SELECT run_id, text_view, cluster_method, CAST(cluster AS INTEGER) AS cluster, coalesce(string_agg(phrase, '; ' ORDER BY phrase) FILTER (WHERE n = 1), '') AS own FROM x GROUP BY ALL"""


def contrastive(s, d):
    """Summaries with the majority contribution of their run's clusters as contrast."""
    x = _summaries(s, d)
    n = x.groupBy("run", "contribution").agg(F.count(F.lit(1)).alias("k"))
    top = n.withColumn("p", F.row_number().over(W.partitionBy("run").orderBy(F.desc("k"), "contribution"))).where("p = 1").select("run", F.col("contribution").alias("majority"))
    # phrases of a cluster: the words of its leading titles
    phrases = F.filter(F.split(F.lower(F.array_join("titles", " ")), "[^a-z]+"), lambda w: F.length(w) > 3)
    x = x.withColumn("phrases", F.array_distinct(phrases))
    own = L.unique_phrases(x, ["run"], "cluster", "phrases")
    none = F.array().cast("array<string>")
    return x.join(top, "run").join(own, ["run", "cluster"], "left").select("g", L.contrastive_summary(F.col("summary"), F.coalesce("unique", none), F.col("contribution"), F.col("majority")).alias("summary"))


QUERIES = {
    "passage_roots": (passage_roots, f"WITH {_PASS}, q AS (SELECT DISTINCT id, sentences, paper_id, paragraph_index FROM pa) SELECT id, sentences, unnest({roots_sql('sentences')}) AS root FROM q"),
    "citation_density": (lambda s, d: passages(s, d).select("id", "sentences", F.round(X.citation_density(F.col("sentences")), 6).alias("density")), f"WITH {_PASS} SELECT id, sentences, round({_DENS}, 6) AS density FROM pa"),
    "paragraph_evidence": (paragraph_evidence, _evidence_sql()),
    "claim_sentences": (claims, _claims_sql()),
    "evidence_selection": (evidence_selection, None),
    "claim_support": (support, f"{_SUP} SELECT paper_id, claim, best, best >= 0.35 AS supported FROM s"),
    "faithfulness": (faithfulness, f"{_SUP} SELECT substr(paper_id, 1, 1) AS g, round(avg(CAST(best >= 0.35 AS DOUBLE)), 2) AS faithfulness FROM s GROUP BY 1"),
    "cluster_labels": (cluster_labels, f"WITH {_LAB} SELECT g, cluster, run, label, summary FROM la"),
    "distinct_labels": (distinct_labels, f"""WITH {_LAB}, x AS (SELECT *, CASE WHEN domain <> 'generic' THEN domain ELSE coalesce(list_filter(titles, lambda t: trim(t) <> '')[1], '') END AS extra FROM la),
y AS (SELECT *, count(*) OVER (PARTITION BY run, label) AS k, row_number() OVER (PARTITION BY run, label, extra ORDER BY cluster) AS f FROM x)
SELECT g, 'Cluster ' || cluster || ': ' || CASE WHEN k > 1 AND f = 1 AND extra <> '' THEN label || ' around ' || extra ELSE label END AS final_label FROM y"""),
    "unique_phrases": (unique_phrases, _UNI),
    "contrastive_summaries": (contrastive, f"""WITH {_LAB}, n AS (SELECT run, contribution, count(*) AS k FROM la GROUP BY 1, 2), m AS (SELECT run, arg_min(contribution, (-k, contribution)) AS majority FROM n GROUP BY 1),
re_ AS (SELECT * FROM la WHERE cluster >= 0), many AS (SELECT run FROM re_ GROUP BY run HAVING count(DISTINCT cluster) >= 2),
ph AS (SELECT DISTINCT run, cluster, w AS phrase, CASE WHEN length(w) > 4 AND ends_with(w, 's') THEN substr(w, 1, length(w) - 1) ELSE w END AS root FROM (SELECT run, cluster, unnest(string_split_regex(lower(array_to_string(titles, ' ')), '[^a-z]+')) AS w FROM re_ SEMI JOIN many USING (run)) WHERE length(w) > 3),
sp AS (SELECT run, root, count(DISTINCT cluster) AS c FROM ph GROUP BY 1, 2), un AS (SELECT run, cluster, list(phrase ORDER BY phrase) AS own FROM ph JOIN sp USING (run, root) WHERE c = 1 GROUP BY 1, 2)
SELECT g, summary || CASE WHEN len(coalesce(own, [])) > 0 THEN ' Unlike its siblings it treats ' || array_to_string(own[1:3], ', ') || '.' ELSE '' END || CASE WHEN contribution <> majority THEN ' Most siblings are ' || majority || '.' ELSE '' END AS summary
FROM la JOIN m USING (run) LEFT JOIN un USING (run, cluster)"""),
}
