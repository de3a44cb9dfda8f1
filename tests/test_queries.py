"""Every registered query against its SQL on the smallest tables, and checks of plans."""

import duckdb
import pytest

import __spark_entry__ as entry
from logloom.plans import catalog, tables

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
# The training-data queries have tests of their own.
QUERIES = {n: q for n, q in entry.queries().items() if n in catalog.QUERIES}
SQL = {n: s for n, s in entry.oracle_sql().items() if n in catalog.QUERIES}
USES_PYTHON = {"prediction_label_of_json", "redact_nested", "score_in_pandas", "label_rows", "label_rows_usage", "train_classifier", "triage", "unified_diff", "unified_diff_balance", "unified_diff_text", "label_rows_with_ledger"}


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return db


def shown(value):
    if value is None or str(value) in ("nan", "<NA>", "NaT", "None"):
        return ""
    return f"{value:.6g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name not in USES_PYTHON:
        assert "ArrowEvalPython" not in plan and "MapInPandas" not in plan
    got = df.toPandas()
    if name not in SQL:
        assert len(got)
        return
    want = duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    as_rows = lambda t: sorted(tuple(map(shown, r)) for r in t[columns].itertuples(index=False, name=None))
    assert as_rows(got) == as_rows(want)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["gate_pass", "failed_count", "failed_checks"]


def test_only_needed_columns_are_read(spark):
    plan = QUERIES["label_distribution"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "user_id" in plan  # messages are built from it
    scan = tables.given(spark, FOLDER, "lineitem").groupBy("l_returnflag").count()._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_returnflag:string>" in scan
