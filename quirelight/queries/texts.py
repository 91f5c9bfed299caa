"""Paragraphs, contexts, text views and tokens: T- and V1-V2 operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelight.functions import text as X
from quirelight.operators import contexts as C
from quirelight.operators import vectors as V
from quirelight.queries.base import CONTEXTS, PAPERS, contexts, papers, sq, txt
from quirelight.queries.preparation import relevance_sql

_TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_CLEAN = _TRIM.format("regexp_replace(regexp_replace(extracted_context, '[ \\t\\r\\f\\v]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")
_BLOCKS = "string_split(regexp_replace({0}, '\\n[ \\t\\r\\f\\v\\n]*\\n', chr(1), 'g'), chr(1))"
_CTX = txt("extracted_context")

# (paper_id, i, p): the paragraphs of every context
_PARA = f"""para AS (SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY _i) AS i, p FROM (
  SELECT paper_id, _i, {_TRIM.format('_p')} AS p FROM (SELECT paper_id, unnest(_l) AS _p, generate_subscripts(_l, 1) AS _i FROM (SELECT paper_id, {_BLOCKS.format(_CTX)} AS _l FROM contexts)))
  WHERE p <> '')"""


def _low(c: str) -> str:
    return f"lower({sq(c)})"


def context_paragraphs(s, d):
    return contexts(s, d).select("paper_id", F.posexplode(X.blocks(X.text("extracted_context"))).alias("i", "paragraph")).withColumn("i", F.col("i") + 1)


def fulltext_paragraphs(s, d):
    return contexts(s, d).where("extracted_context is not null").select("paper_id", F.posexplode(X.fulltext_paragraphs(F.col("extracted_context"))).alias("i", "paragraph")).withColumn("i", F.col("i") + 1)


def paragraph_scores(s, d):
    return context_paragraphs(s, d).select("paper_id", "i", X.relevance(F.col("paragraph"), C.CONTEXT_TERMS).alias("score"))


def top_context(s, d):
    return C.top_context(contexts(s, d), "extracted_context").select("paper_id", "context", "matched")


def keyword_context(s, d):
    return C.top_context(contexts(s, d), "extracted_context", C.keyword_terms("Design patterns")).select("paper_id", "context", "matched")


def _top_sql(terms, most: int, cut: int) -> str:
    return f"""WITH {CONTEXTS}, {_PARA}, sc AS (SELECT paper_id, i, p, {relevance_sql('low', terms)} AS score FROM (SELECT *, {_low('p')} AS low FROM para)),
pick AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, length(p) DESC, i) AS hit, count_if(score > 0) OVER (PARTITION BY paper_id) AS m FROM sc),
ch AS (SELECT paper_id, CASE WHEN m > 0 THEN hit ELSE i END AS o, rtrim(substr(p, 1, {cut})) AS p FROM pick WHERE (m > 0 AND score > 0 AND hit <= {most}) OR (m = 0 AND i <= {most}))
SELECT c.paper_id, coalesce((SELECT string_agg(p, chr(10) || chr(10) ORDER BY o) FROM ch WHERE ch.paper_id = c.paper_id), '') AS context,
CAST(coalesce((SELECT max(m) FROM pick WHERE pick.paper_id = c.paper_id), 0) AS INTEGER) AS matched FROM contexts c"""


def discussion(s, d):
    found, parts = C.discussion(X.blocks(X.text("extracted_context")))
    return contexts(s, d).select("paper_id", F.coalesce(found, F.lit(False)).alias("found"), F.coalesce(F.size(parts), F.lit(0)).alias("paragraphs"), F.array_join(parts, "\n\n").alias("discussion"))


_NAMES = "|".join(X.DISCUSSION_HEADINGS)
_DISC = f"""WITH {CONTEXTS}, {_PARA}, h AS (SELECT paper_id, min(i) AS a0 FROM para WHERE regexp_matches(lower(trim(string_split(p, chr(10))[1])), '^(\\d+(\\.\\d+)*\\.?\\s+)?({_NAMES})\\s*$')
  OR regexp_matches(lower(trim(string_split(p, chr(10))[1])), '^discussions?\\b') GROUP BY 1),
k AS (SELECT para.paper_id, count(*) AS n, string_agg(p, chr(10) || chr(10) ORDER BY i) AS t FROM para JOIN h ON para.paper_id = h.paper_id AND i BETWEEN a0 AND a0 + 7 GROUP BY 1)
SELECT c.paper_id, k.n IS NOT NULL AS found, CAST(coalesce(k.n, 0) AS INTEGER) AS paragraphs, coalesce(k.t, '') AS discussion FROM contexts c LEFT JOIN k USING (paper_id)"""


def lead_summary(s, d):
    return contexts(s, d).select("paper_id", C.lead_summary(X.blocks(X.text("extracted_context"))).alias("summary"))


_SENT = "string_split(regexp_replace(regexp_replace(trim({0}), '([.!?])\\s+([A-Z\"“(])', '\\1' || chr(1) || '\\2', 'g'), '([.!?])\\s+([A-Z\"“(])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"
_LEAD = f"""WITH {CONTEXTS}, {_PARA}, f AS (SELECT paper_id, i, {sq(_SENT.format(sq('p')) + '[1]')} AS sn FROM para WHERE i <= 3)
SELECT c.paper_id, coalesce((SELECT string_agg('- ' || rtrim(substr(sn, 1, 260)), chr(10) ORDER BY i) FROM f WHERE f.paper_id = c.paper_id AND length(sn) >= 40), '') AS summary FROM contexts c"""


def _viewed(s, d):
    p = papers(s, d)
    c = contexts(s, d).select("paper_id", F.coalesce("extracted_context", F.lit("")).alias("extracted_context"), F.coalesce("discussion_summary", F.lit("")).alias("discussion_summary"))
    return p.join(C.top_context(c, "extracted_context").select("paper_id", "context", "discussion_summary"), "paper_id", "left")


def overall_view(s, d):
    return _viewed(s, d).select("paper_id", C.overall_view("Design theory").alias("view"))


_VIEWED = f"""WITH {PAPERS}, tc AS ({_top_sql(C.CONTEXT_TERMS, 10, 1800)}), {CONTEXTS}, v AS (SELECT papers.*, {txt('tc.context')} AS context, {txt('contexts.discussion_summary')} AS discussion_summary FROM papers LEFT JOIN tc USING (paper_id) LEFT JOIN contexts USING (paper_id))"""
_OVER = f"""{_VIEWED} SELECT paper_id, concat_ws('. ', nullif(title, ''), nullif(abstract, ''), nullif(context, ''), nullif(discussion_summary, ''), 'Design theory', nullif(keyword, ''), nullif({txt('venue')}, ''), nullif({txt('year')}, '')) AS view FROM v"""


def facet_terms(s, d):
    return papers(s, d).select("paper_id", F.array_join(X.present_terms(F.concat_ws(" ", "title", "abstract"), C.VIEW_TERMS["method"] + C.VIEW_TERMS["target-user"], 5), "|").alias("found"))


def _present_sql(col: str, terms, most: int) -> str:
    hits = ", ".join(f"CASE WHEN {relevance_sql(col, (t,))} > 0 THEN '{t}' END" for t in terms)
    return f"list_filter([{hits}], lambda x: x IS NOT NULL)[1:{most}]"


_FACET = f"""WITH {PAPERS} SELECT paper_id, array_to_string({_present_sql('low', C.VIEW_TERMS['method'] + C.VIEW_TERMS['target-user'], 5)}, '|') AS found FROM (SELECT paper_id, lower({sq("title || ' ' || abstract")}) AS low FROM papers)"""


def view_texts(s, d):
    v = _viewed(s, d)
    return v.select("paper_id", C.view_text("method", "design patterns").alias("method_view"), C.view_text("target-user").alias("user_view"), C.view_text("purpose").alias("purpose_view"))


def _view_sql(view: str, focus: str | None) -> str:
    found = _present_sql("low", C.VIEW_TERMS[view], 10)
    if focus:
        found = f"list_concat(['{focus}'], {found})"
    return f"'Clustering view: {view}. Facet terms: ' || CASE WHEN len({found}) > 0 THEN array_to_string({found}, ', ') ELSE keyword || '. ' || title END || '. Title: ' || title || '. Abstract signal: ' || substr(abstract, 1, 500)"


_VIEWS = f"""{_VIEWED} SELECT paper_id, {_view_sql('method', 'Design patterns')} AS method_view, {_view_sql('target-user', None)} AS user_view, {_view_sql('purpose', None)} AS purpose_view
FROM (SELECT *, lower({sq("concat_ws(' ', title, abstract, context, discussion_summary)")}) AS low FROM v)"""


def evidence_sentences(s, d):
    from quirelight.session import table

    e = table(s, d, "evidence_items").where("sentences is not null").select("id", "sentences").distinct()
    return e.select("id", F.posexplode(X.sentences(F.col("sentences"))).alias("i", "sentence"))


_ESENT = f"""SELECT id, CAST(row_number() OVER (PARTITION BY id, sentences ORDER BY _i) - 1 AS INTEGER) AS i, trim(_s) AS sentence FROM (SELECT id, sentences, unnest(_l) AS _s, generate_subscripts(_l, 1) AS _i FROM (
  SELECT id, sentences, {_SENT.format('sentences')} AS _l FROM (SELECT DISTINCT id, sentences FROM evidence_items WHERE sentences IS NOT NULL))) WHERE trim(_s) <> ''"""


def paper_tokens(s, d):
    t = V.token_counts(papers(s, d).select("paper_id", F.concat_ws(" ", "title", "abstract").alias("text")), "paper_id", "text")
    return t.select("paper_id", "term", "n")


_STOP = ", ".join(f"'{w}'" for w in V.STOP_WORDS)
TOKENS = f"""tok AS (SELECT paper_id, list_filter(regexp_extract_all(lower(title || ' ' || abstract), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+'), lambda x: regexp_full_match(x, 'ai|ux|xr|[a-z]{{3,}}') AND x NOT IN ({_STOP})) AS t FROM papers)"""
_TOK = f"WITH {PAPERS}, {TOKENS} SELECT paper_id, term, count(*) AS n FROM (SELECT paper_id, unnest(t) AS term FROM tok) GROUP BY 1, 2"


def paper_bigrams(s, d):
    t = V.token_counts(papers(s, d).select("paper_id", F.concat_ws(" ", "title", "abstract").alias("text")), "paper_id", "text", ngrams=(2, 2))
    return t.select("paper_id", "term", "n")


_BIG = f"WITH {PAPERS}, {TOKENS} SELECT paper_id, term, count(*) AS n FROM (SELECT paper_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term FROM tok) GROUP BY 1, 2"

# a fold over the sentences of a paragraph: a chunk grows until the next sentence is too much
_PACK = """WITH {ctx}, p AS (SELECT paper_id, trim(_p, ' ' || chr(9) || chr(10) || chr(13)) AS p, _i FROM (SELECT paper_id, unnest(_l) AS _p, generate_subscripts(_l, 1) AS _i FROM (SELECT paper_id, string_split(regexp_replace(extracted_context, '\\n\\s*\\n', chr(1), 'g'), chr(1)) AS _l FROM contexts WHERE extracted_context IS NOT NULL))),
q AS (SELECT paper_id, _i, CASE WHEN length(p) <= {most} THEN [p] ELSE list_filter(string_split(regexp_replace(p, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') END AS l FROM p WHERE p <> ''),
c AS (SELECT paper_id, _i, list_reduce(list_transform(l, lambda x: [x]), lambda acc, x: CASE WHEN len(acc) > 0 AND length(acc[-1]) + 1 + length(x[1]) <= {most} THEN list_concat(acc[1:len(acc) - 1], [acc[-1] || ' ' || x[1]]) ELSE list_concat(acc, x) END, CAST([] AS VARCHAR[])) AS l FROM q),
f AS (SELECT paper_id, flatten(list(l ORDER BY _i)) AS l FROM c GROUP BY 1) SELECT paper_id, CAST(generate_subscripts(l, 1) AS INTEGER) AS chunk_no, unnest(l) AS chunk FROM f"""

QUERIES = {
    "space_cleanup": (lambda s, d: contexts(s, d).where("extracted_context is not null").select("paper_id", X.clean_space(F.col("extracted_context")).alias("clean")), f"WITH {CONTEXTS} SELECT paper_id, {_CLEAN} AS clean FROM contexts WHERE extracted_context IS NOT NULL"),
    "context_paragraphs": (context_paragraphs, f"WITH {CONTEXTS}, {_PARA} SELECT paper_id, CAST(i AS INTEGER) AS i, p AS paragraph FROM para"),
    "fulltext_paragraphs": (fulltext_paragraphs, f"""WITH {CONTEXTS}, l AS (SELECT paper_id, string_split(regexp_replace(regexp_replace({_CLEAN}, '\\n[ \\t\\r\\f\\v\\n]*\\n', chr(1), 'g'), '([.!?])\\s+([A-Z][a-z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS _l FROM contexts WHERE extracted_context IS NOT NULL),
e AS (SELECT paper_id, {sq('_p')} AS p, _i FROM (SELECT paper_id, unnest(_l) AS _p, generate_subscripts(_l, 1) AS _i FROM l))
SELECT paper_id, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY _i) AS INTEGER) AS i, p AS paragraph FROM e WHERE length(p) >= 80"""),
    "paragraph_scores": (paragraph_scores, f"WITH {CONTEXTS}, {_PARA} SELECT paper_id, CAST(i AS INTEGER) AS i, CAST({relevance_sql('low', C.CONTEXT_TERMS)} AS INTEGER) AS score FROM (SELECT paper_id, i, {_low('p')} AS low FROM para)"),
    "top_context": (top_context, _top_sql(C.CONTEXT_TERMS, 10, 1800)),
    "keyword_context": (keyword_context, _top_sql(C.keyword_terms("Design patterns"), 10, 1800)),
    "discussion_section": (discussion, _DISC),
    "lead_summary": (lead_summary, _LEAD),
    "overall_view": (overall_view, _OVER),
    "facet_terms": (facet_terms, _FACET),
    "view_texts": (view_texts, _VIEWS),
    "text_chunks": (lambda s, d: C.chunks(contexts(s, d), "paper_id", "extracted_context", 600), _PACK.format(ctx=CONTEXTS, most=600)),
    "evidence_sentences": (evidence_sentences, _ESENT),
    "paper_tokens": (paper_tokens, _TOK),
    "paper_bigrams": (paper_bigrams, _BIG),
}
