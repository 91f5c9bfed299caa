"""Every registered core query against its SQL on the smallest tables."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from quirelight.queries import oracle_sql, queries

DIR = "/root/testdata/sf0.001"
SLOW = {"selection_table", "lda_topics"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}/*.parquet'" if os.path.isdir(p) else f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return tuple(map(norm, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(set(queries()) - SLOW))
def test_query(spark, duck, name):
    df = queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    sql = oracle_sql().get(name)
    if sql is None:
        assert got
        return
    r = duck.execute(sql)
    names = [c[0] for c in r.description]
    assert sorted(names) == cols
    want = Counter(tuple(norm(row[names.index(c)]) for c in cols) for row in r.fetchall())
    assert got == want
