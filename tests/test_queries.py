"""Every engine query against DuckDB on the smallest tables; the others for their rows."""

import math

import duckdb
import pytest

from fathomgrid.plans import pictures, queries  # noqa: F401
from fathomgrid.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows):
    fix = lambda x: None if isinstance(x, float) and math.isnan(x) else float(x) if isinstance(x, int) and not isinstance(x, bool) else x
    return sorted((tuple(map(fix, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows
    if name in SQL:
        found = con.execute(SQL[name])
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(df.columns)
        at = [df.columns.index(c) for c in columns]
        assert plain([[r[i] for i in at] for r in rows]) == plain(found.fetchall())


def test_stream_equals_batch(spark):
    batch = {(r["stream"], r["id"]): r["y"] for r in QUERIES["ema_fold"](spark, SF).collect()}
    stream = {(r["stream"], r["id"]): r["y"] for r in QUERIES["stream_fold"](spark, SF).collect()}
    assert batch.keys() == stream.keys() and all(abs(batch[k] - stream[k]) < 1e-5 for k in batch)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
