"""The training-data queries on the smallest tables: against their SQL, and for the shape of their results."""

import glob
import os

import duckdb
import pytest

from sieveline.llm import queries as Q

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
SHAPES = {
    "p1_found": "unique_id bigint", "p2_found": "doc_id string, span_start int, span_end int, kind string", "p3_found": "id_a bigint, id_b bigint",
    "p4_found": "unique_id bigint, func_id bigint", "p5_found": "keep_id bigint, copy_id bigint", "p8_found": "doc_id bigint, kind string",
}


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = Q.QUERIES[name](spark, DATA)
    cur = con.execute(Q.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*names).collect()))) == sorted(map(repr, cur.fetchall()))


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_runs(spark, name):
    df = Q.QUERIES[name](spark, DATA)
    if name in SHAPES:
        assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == SHAPES[name]
    rows = df.collect()
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))
    if name == "p1_splits":
        assert len(rows) == spark.read.parquet(f"{DATA}/codereview.parquet").count()
