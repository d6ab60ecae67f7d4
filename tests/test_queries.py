"""Every query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from sieveline.plans import catalog, reviews  # noqa: F401

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture
def sql():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    yield con
    con.close()


def cells(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def one(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        return v

    return sorted(names), sorted((tuple(one(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, sql, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = cells(df.columns, [tuple(r) for r in df.collect()])
    cur = sql.execute(catalog.ORACLES[name])
    want = cells([c[0] for c in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert [tuple(map(_loose, r)) for r in got[1]] == [tuple(map(_loose, r)) for r in want[1]]


def _loose(v):
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES) - {"G05_G07_classifier", "G06_boosted", "G11_held_out_project", "G12_G13_code_folds"}))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
