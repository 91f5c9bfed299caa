"""What the queries share: prepared tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirelight.operators import relational as R
from quirelight.session import table

# The SQL that prepares the same tables. ``txt`` turns null and nan into ''.
MACROS = {
    "txt": "CASE WHEN lower(trim(coalesce({0}, ''))) = 'nan' THEN '' ELSE trim(coalesce({0}, '')) END",
    "sq": "trim(regexp_replace({0}, '\\s+', ' ', 'g'))",
}


def txt(c: str) -> str:
    return MACROS["txt"].format(c)


def sq(c: str) -> str:
    return MACROS["sq"].format(c)


PAPERS = f"""papers AS (
  SELECT input_row, paper_id, {sq(txt('title'))} AS title, {sq(txt('abstract'))} AS abstract, {sq(txt('keyword'))} AS keyword, authors, doi, year, venue, url, fulltext_flag, primary_reason, val_reason
  FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY input_row) AS _r FROM final_advancing_list WHERE paper_id IS NOT NULL) WHERE _r = 1)"""

CONTEXTS = """contexts AS (
  SELECT * EXCLUDE (_r) FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY built_at DESC, coalesce(extracted_context, '') DESC) AS _r
  FROM build_fulltext_context WHERE paper_id IS NOT NULL) WHERE _r = 1)"""

_CANON = " ".join(f"WHEN '{k.lower()}' THEN '{k}'" for k in __import__("quirelight.functions.text", fromlist=["KEYWORDS"]).KEYWORDS)


def canon(c: str) -> str:
    return f"CASE lower({sq(c)}) {_CANON} ELSE trim({c}) END"


KEYWORDS = f"""keywords AS (
  SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY _i) AS position, keyword FROM (
    SELECT paper_id, _i, keyword, row_number() OVER (PARTITION BY paper_id, lower({sq('keyword')}) ORDER BY _i) AS _f FROM (
      SELECT paper_id, _i, {canon('_k')} AS keyword FROM (
        SELECT paper_id, unnest(_l) AS _k, generate_subscripts(_l, 1) AS _i FROM (SELECT paper_id, regexp_split_to_array(keyword, '\\s*[;|,]\\s*') AS _l FROM papers))
      WHERE trim(_k) <> '')) WHERE _f = 1)"""


def papers(spark: SparkSession, d: str) -> DataFrame:
    return R.prepare(table(spark, d, "final_advancing_list"))


def contexts(spark: SparkSession, d: str) -> DataFrame:
    return R.latest_contexts(table(spark, d, "build_fulltext_context"))


def clusters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "clustering_results")
