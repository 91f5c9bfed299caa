"""Facets, lexicons and rule coding: F- and Y-operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelight.operators import coding as Y
from quirelight.operators import contexts as C
from quirelight.queries.preparation import relevance_sql
from quirelight.queries.topics import CLUSTERED, clustered

LEXICON = {"thing": ("toolkit", "prototype", "physical device", "robot", "lamp"), "study": ("diary study", "field trial", "findings from", "remote survey"), "idea": ("we argue", "school of thought", "theory"), "rule": ("guideline", "rubric", "standard", "checklist")}
NEEDLES = [("records", ("data:", "records", "collected")), ("proposal", ("proposed", "contribution")), ("review", ("prior studies", "accounts"))]


def real(s, d):
    """The papers of the real k-means clusters with lower-cased text."""
    return clustered(s, d).where("cluster >= 0").withColumn("low", F.lower("text"))


_REAL = f"{CLUSTERED}, re AS (SELECT *, lower(text) AS low FROM cp WHERE cluster >= 0), sz AS (SELECT g, count(DISTINCT paper_id) AS n FROM re GROUP BY 1)"


def _hits(book: Y.Codebook, src: str = "re", keep: str = "g, paper_id") -> str:
    rows = " UNION ALL ".join(f"SELECT {keep}, '{r.key}' AS key, '{r.name}' AS rule, {i} AS ord, {r.weight} AS weight, least(2, len(regexp_extract_all(low, '{r.pattern}'))) AS hits FROM {src}" for i, r in enumerate(book.rules))
    pr = " ".join(f"WHEN '{k}' THEN {v}" for k, v in book.priority.items())
    return f"hi AS (SELECT *, CASE key {pr} END AS pr FROM ({rows}) WHERE hits > 0), ps AS (SELECT {keep}, key, pr, sum(weight * hits) AS score FROM hi GROUP BY ALL)"


_SEL = "se AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g, paper_id ORDER BY score DESC, pr DESC) AS place, max(score) OVER (PARTITION BY g, paper_id) AS best FROM ps) WHERE score >= 3 AND (place = 1 OR (place = 2 AND best - score <= 1)))"
_NEED = "CASE WHEN n < 8 THEN 1 ELSE greatest(2, ceil(n * 0.10)) END"
_CON = f"""{_REAL}, {_hits(Y.CONTRIBUTION)}, {_SEL}, cs AS (SELECT g, key, pr, sum(least(14, score)) AS score, count(*) AS support FROM se GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, support DESC, pr DESC) AS place FROM cs),
tp AS (SELECT g, max(CASE WHEN place = 1 THEN key END) AS k1, max(CASE WHEN place = 1 THEN score END) AS s1, max(CASE WHEN place = 1 THEN support END) AS u1, max(CASE WHEN place = 2 THEN key END) AS k2, max(CASE WHEN place = 2 THEN score END) AS s2,
  max(CASE WHEN place = 2 THEN support END) AS u2, count_if(score >= 3) AS sg, sum(CASE WHEN score >= 3 THEN support END) AS sp FROM rk GROUP BY 1),
co AS (SELECT g, n, CASE WHEN coalesce(s1 < 3 OR u1 < {_NEED}, true) THEN CASE WHEN coalesce(sg >= 2 AND sp >= 3, false) THEN 'mixed' ELSE 'unclear' END ELSE k1 END AS contribution,
  CASE WHEN coalesce(NOT (s1 < 3 OR u1 < {_NEED}) AND s2 >= 3 AND u2 >= {_NEED} AND s1 - s2 <= greatest(1, round_even(s1 * 0.08, 0)) AND abs(u1 - u2) <= 1, false) THEN k2 ELSE '' END AS secondary, CAST(coalesce(s1, 0) AS BIGINT) AS score, coalesce(u1, 0) AS support FROM sz LEFT JOIN tp USING (g))"""
_MOV = f"""{_REAL}, {_hits(Y.MOVES)}, cs AS (SELECT g, key, pr, sum(least(12, score)) AS score, count(*) AS support FROM ps GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, support DESC, pr DESC) AS place FROM cs),
tp AS (SELECT g, max(CASE WHEN place = 1 THEN key END) AS k1, max(CASE WHEN place = 1 THEN score END) AS s1, max(CASE WHEN place = 1 THEN support END) AS u1, coalesce(max(CASE WHEN place = 2 THEN score END), 0) AS s2, coalesce(max(CASE WHEN place = 2 THEN support END), 0) AS u2 FROM rk GROUP BY 1),
mo AS (SELECT g, n, CASE WHEN coalesce(s1 < 3 OR u1 < {_NEED} OR (s2 > 0 AND s1 - s2 < 2 AND u1 = u2), true) THEN 'unclear' ELSE k1 END AS move, CAST(coalesce(s1, 0) AS BIGINT) AS score, coalesce(u1, 0) AS support FROM sz LEFT JOIN tp USING (g))"""


def paper_types(s, d):
    r = real(s, d)
    c = Y.selected_per_paper(Y.paper_scores(r, ["g", "paper_id"], "low", Y.CONTRIBUTION), ["g", "paper_id"], Y.CONTRIBUTION)
    return c.select("g", "paper_id", "place", "key", "score")


def contribution(s, d):
    return Y.contribution(real(s, d), "g", "paper_id", "low")


def cluster_codes(s, d):
    """Contribution and, where it is theoretical, the theory move of every cluster."""
    r = real(s, d)
    c, m = Y.contribution(r, "g", "paper_id", "low"), Y.theory_move(r, "g", "paper_id", "low").select("g", "move")
    return c.join(m, "g").select("g", "contribution", "secondary", Y.conditional_move(F.col("contribution"), F.col("secondary"), F.col("move")).alias("move"))


def patterns(s, d):
    return Y.pattern_evidence(real(s, d), "g", "paper_id", "low", Y.CONTRIBUTION)


def subtype(s, d):
    return Y.subtype(real(s, d), "g", "paper_id", "low", "rank", "artifact")


def _sub_sql(key: str) -> str:
    rows = " UNION ALL ".join(f"SELECT g, paper_id, '{n}' AS label, {-i} AS fi, least(2, len(regexp_extract_all(low, '{p}'))) AS h, CASE WHEN rank BETWEEN 1 AND 3 THEN 3 ELSE 1 END AS w FROM re" for i, (n, p) in enumerate(Y.SUBTYPES[key]))
    return f"""WITH {_REAL}, a AS ({rows}), b AS (SELECT g, label, fi, sum(w) AS we, count(*) AS su, sum(h) AS ma FROM a WHERE h > 0 GROUP BY ALL), t AS (SELECT g, arg_max(label, (we, su, ma, fi)) AS label, arg_max(su, (we, su, ma, fi)) AS su FROM b GROUP BY 1)
SELECT g, n, CASE WHEN su >= {_NEED} THEN label ELSE '' END AS subtype, coalesce(su, 0) AS support FROM sz LEFT JOIN t USING (g)"""


_DOM = f"""WITH {_REAL}, {_hits(Y.DOMAINS)}, s AS (SELECT g, key, pr, sum(least(8, score)) AS score, count(*) AS support FROM ps GROUP BY ALL), k AS (SELECT s.*, n, CAST(row_number() OVER (PARTITION BY g ORDER BY support DESC, score DESC, pr DESC) AS INTEGER) AS place
FROM s JOIN sz USING (g) WHERE support >= CASE WHEN n <= 4 THEN 1 ELSE greatest(2, ceil(n * 0.20)) END AND score >= 3)
SELECT g, n, place, key AS domain, support FROM k WHERE place <= 3 UNION ALL SELECT g, n, 1, 'generic', n FROM sz WHERE g NOT IN (SELECT g FROM k)"""

_PHR = C.VIEW_TERMS["method"] + C.VIEW_TERMS["target-user"] + C.VIEW_TERMS["context"]


def facet_matches(s, d):
    return Y.facets(real(s, d), "g", "paper_id", "low", _PHR).withColumn("share", F.round("share", 6))


_FAC = f"""WITH {_REAL}, h AS ({' UNION ALL '.join(f"SELECT g, paper_id, '{p}' AS phrase FROM re WHERE {relevance_sql('low', (p,))} > 0" for p in _PHR)}),
c AS (SELECT g, phrase, count(DISTINCT paper_id) AS papers, any_value(n) AS n FROM h JOIN sz USING (g) GROUP BY 1, 2), k AS (SELECT *, papers / n AS share, CAST(row_number() OVER (PARTITION BY g ORDER BY papers DESC, papers / n DESC, length(phrase) DESC, phrase) AS INTEGER) AS place FROM c
WHERE papers >= CASE WHEN n <= 4 THEN 1 ELSE 2 END OR papers / n >= 0.25) SELECT g, place, phrase, papers, round(share, 6) AS share FROM k WHERE place <= 4"""


def _lex_total(words, multi: int) -> str:
    return " + ".join(f"({relevance_sql('low', (t,))}) / {4 if ' ' in t else 1} * {multi if ' ' in t else 1}" for t in words)


def lexical_types(s, d):
    return Y.lexical_types(real(s, d), "g", "paper_id", "low", LEXICON)


_LEX = f"""WITH {_REAL}, h AS ({' UNION ALL '.join(f"SELECT g, paper_id, '{k}' AS type, {i} AS o, CAST({_lex_total(v, 2)} AS BIGINT) AS h FROM re" for i, (k, v) in enumerate(LEXICON.items()))}),
c AS (SELECT g, type, o, count(DISTINCT paper_id) AS papers, CAST(sum(h) AS BIGINT) AS hits FROM h WHERE h > 0 GROUP BY ALL), k AS (SELECT g, CAST(row_number() OVER (PARTITION BY g ORDER BY papers DESC, hits DESC, o) AS INTEGER) AS place, type, papers, hits FROM c) SELECT * FROM k WHERE place <= 3"""


def pattern_scores(s, d):
    return Y.group_scores(real(s, d), ["g", "paper_id"], "low", LEXICON, 2)


_PAT = f"""WITH {_REAL}, h AS ({' UNION ALL '.join(f"SELECT g, paper_id, '{k}' AS label, CAST({_lex_total(v, 3)} AS INTEGER) AS score FROM re" for k, v in LEXICON.items())}),
k AS (SELECT g, paper_id, CAST(row_number() OVER (PARTITION BY g, paper_id ORDER BY score DESC, length(label) DESC, label) AS INTEGER) AS place, label, score FROM h WHERE score > 0) SELECT * FROM k WHERE place <= 2"""


def needle_choice(s, d):
    return real(s, d).select("g", "paper_id", F.coalesce(Y.needle_choice(F.col("low"), NEEDLES), F.lit("")).alias("rule"))


_NEE = f"""WITH {_REAL} SELECT g, paper_id, CASE WHEN greatest(h0, h1, h2) = 0 THEN '' WHEN h0 >= h1 AND h0 >= h2 THEN '{NEEDLES[0][0]}' WHEN h1 >= h2 THEN '{NEEDLES[1][0]}' ELSE '{NEEDLES[2][0]}' END AS rule FROM (
SELECT g, paper_id, {', '.join('(' + ' + '.join(f"CAST(contains(low, '{x}') AS INTEGER)" for x in ns) + f') AS h{i}' for i, (_, ns) in enumerate(NEEDLES))} FROM re)"""


def cluster_text(s, d):
    """The distinct titles of a cluster as one text, and its group's form word."""
    r = real(s, d).where("rank between 1 and 3")
    t = r.groupBy("g").agg(F.array_join(F.array_sort(F.collect_set(F.lower("title"))), " ").alias("titles"), F.countDistinct("keyword").alias("kinds"), F.min("keyword").alias("k"))
    return t.select("g", "titles", F.when(F.col("kinds") == 1, F.lower("k")).otherwise(F.lit("mixed keywords")).alias("form"))


QUERIES = {
    "contribution_papers": (paper_types, f"WITH {_REAL}, {_hits(Y.CONTRIBUTION)}, {_SEL} SELECT g, paper_id, CAST(place AS INTEGER) AS place, key, CAST(score AS BIGINT) AS score FROM se"),
    "contribution_clusters": (contribution, f"WITH {_CON} SELECT * FROM co"),
    "theory_moves": (lambda s, d: Y.theory_move(real(s, d), "g", "paper_id", "low"), f"WITH {_MOV} SELECT * FROM mo"),
    "cluster_codes": (cluster_codes, f"SELECT g, contribution, secondary, CASE WHEN contribution = 'theoretical' OR secondary = 'theoretical' THEN move ELSE 'not_applicable' END AS move FROM (WITH {_CON} SELECT * FROM co) JOIN (WITH {_MOV} SELECT g, move FROM mo) USING (g)"),
    "contribution_patterns": (patterns, f"""WITH {_REAL}, {_hits(Y.CONTRIBUTION)}, n AS (SELECT g, key, rule, ord, sum(hits) AS h FROM hi GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY g, key ORDER BY h DESC, ord) AS p FROM n)
SELECT g, key, string_agg(rule || ' (' || CAST(h AS BIGINT) || ')', '; ' ORDER BY p) AS patterns FROM r WHERE p <= 5 GROUP BY 1, 2"""),
    "contribution_subtype": (subtype, _sub_sql("artifact")),
    "cluster_domains": (lambda s, d: Y.domains(real(s, d), "g", "paper_id", "low"), _DOM),
    "facet_matches": (facet_matches, _FAC),
    "lexical_types": (lexical_types, _LEX),
    "pattern_scores": (pattern_scores, _PAT),
    "needle_choice": (needle_choice, _NEE),
    "cluster_text": (cluster_text, f"""WITH {_REAL}, r AS (SELECT * FROM re WHERE rank BETWEEN 1 AND 3) SELECT g, string_agg(DISTINCT lower(title), ' ' ORDER BY lower(title)) AS titles, CASE WHEN count(DISTINCT keyword) = 1 THEN lower(min(keyword)) ELSE 'mixed keywords' END AS form FROM r GROUP BY 1"""),
}
