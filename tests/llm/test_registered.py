"""Registered queries: columns as stated, SQL where there is some, equal results."""

import glob
import os

import duckdb
import pytest

from quirelight.llm.queries import oracle_sql, queries

DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": {"record_kind": "string", "record_key": "string", "term": "string"}, "p2_found": {"record_kind": "string", "record_key": "string", "start_pos": "int", "end_pos": "int"}, "p3_found": {"paper_id_a": "string", "paper_id_b": "string"},
    "p4_found": {"paper_id_a": "string", "paper_id_b": "string"}, "p5_found": {"paper_id": "string", "area": "string"}, "p6_found": {"run_id": "string", "text_view": "string", "cluster_method": "string", "cluster": "int", "paper_id": "string"},
    "p7_found": {"paper_id": "string", "field_name": "string", "line_no": "int", "kind": "string", "word": "string"}, "p8_found": {"item_id": "bigint", "doc_id": "bigint"}, "p10_found": {"doc_id": "bigint"},
}


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, name):
    df = queries()[name](spark, DIR)
    rows = [tuple(r) for r in df.collect()]
    if name in COLUMNS:
        assert dict(df.dtypes) == COLUMNS[name] and len(rows) == len(set(rows))
    if name in oracle_sql():
        con = duckdb.connect()
        for p in glob.glob(f"{DIR}/*.parquet"):
            con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}/*.parquet'" if os.path.isdir(p) else f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
        r = con.execute(f"select {', '.join(df.columns)} from ({oracle_sql()[name]})")
        assert sorted(rows) == sorted(r.fetchall())
