"""Every registered query against its DuckDB twin on the smallest driver tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    if hasattr(v, "isoformat"):
        return str(v)[:19]
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    got = df.collect()
    cur = con.execute(E.oracle_sql()[name])
    ocols = [c[0] for c in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert _rows(df.columns, got) == _rows(ocols, want)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    # The driver checks that the flagship schema is stable.
    assert [(f.name, f.dataType.simpleString()) for f in df.schema.fields] == [
        ("engagement_id", "string"), ("engagement_name", "string"), ("ansr", "double"), ("margin_cost", "double"),
        ("margin_amount", "double"), ("ter", "double"), ("margin_pct", "double"), ("hours", "double")]


def test_queries_without_oracle_run(spark):
    for name, fn in E.queries().items():
        if name not in E.oracle_sql():
            assert fn(spark, SF_SMALL).count() >= 0, name
