"""Every registered query against its SQL on the smallest data set."""

import duckdb
import pytest

import __spark_entry__ as entry
from loanlens.catalog import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def clean(v):
    return 0.0 if isinstance(v, float) and v == 0 else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, small, name):
    got = QUERIES[name](spark, small)
    columns = sorted(got.columns)
    rows = [tuple(clean(r[c]) for c in columns) for r in got.collect()]
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = [tuple(clean(r[names.index(c)]) for c in columns) for r in cursor.fetchall()]
    assert ordered(rows) == ordered(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, small, name):
    assert not QUERIES[name](spark, small).isEmpty()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["automap_headers", "join_headers_fuzzy", "impute_application", "by_risk_level", "auc_roc"])
def test_no_cross_joins(spark, small, name):
    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark, small):
    plan = QUERIES["prediction_by_id"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_id,77)" in plan
    plan = QUERIES["by_model_type"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_type:string>" in plan
