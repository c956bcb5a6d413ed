"""The driver's contract over the smallest tables, where they are there: every query runs, and SQL agrees."""

import glob
import os

import pytest

import __spark_entry__
from kelpline.plans import corpus_queries, reference_queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def _canon(v):
    import numpy as np

    if v is None or isinstance(v, float) and v != v:
        return None
    if isinstance(v, (float, np.floating)):
        return round(float(v), 6) + 0.0
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(_canon(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in __spark_entry__.oracle_sql() if not n.startswith("p2_")])
def test_sql_agrees(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    got = df.collect()
    r = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    a = sorted(str([_canon(x[c]) for c in sorted(names)]) for x in got)
    b = sorted(str([_canon(x[names.index(c)]) for c in sorted(names)]) for x in r.fetchall())
    assert a == b


@pytest.mark.parametrize("name", [n for part in (corpus_queries, reference_queries) for n in part.QUERIES if n not in part.ORACLE])
def test_queries_without_sql_run(spark, name):
    df = __spark_entry__.queries()[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
