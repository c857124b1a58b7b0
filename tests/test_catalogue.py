"""Every registered query that has SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest
from codeloom.plans.scenarios import QUERIES, SQL
from compare import digest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


#: Jobs that tests/test_index.py, test_upkeep.py and test_stream.py go through step by step.
ELSEWHERE = {"job_upkeep", "job_enrichment", "stream_reindex"}


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ELSEWHERE])
def test_query(spark, db, name):
    df = QUERIES[name](spark, DATA)
    want = db.sql(SQL[name])
    assert digest(df.columns, df.collect()) == digest(want.columns, want.fetchall())
