"""The registered queries over the smallest tables, where they are there, with their production parameters."""

import os

import pytest

from kelpline.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW file_scores AS SELECT * FROM '{SF}/file_scores.parquet'")
    return c


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_runs(spark, name):
    rows = queries.QUERIES[name](spark, SF).collect()
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_sql_agrees(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(queries.ORACLE[name])
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


def test_recall_of_the_neighbour_query(spark):
    r = queries.p7_recall(spark, SF).collect()[0]
    assert r.queries > 0 and r.recall >= 0.9


def test_shares_follow_targets_and_limits(spark):
    rows = queries.p9_shares(spark, SF).collect()
    limits = {r["source"].strip().lower(): r["max_repeats"] for r in queries.table(spark, SF, "source_weights").collect()}
    assert sum(r.actual_share for r in rows) == pytest.approx(1, abs=1e-4)
    assert all(r.tokens <= limits[r.source] * r.available_tokens for r in rows)
