"""Every query of the core library that SQL can express, against DuckDB on the same tables."""

import duckdb
import pytest

from lectern import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Queries whose windows have ties that the smallest tables do not show.
TIES = ["finding_labels", "finding_boxes", "rate_limit", "request_spacing", "queue_replay", "claim_next", "tool_history", "sessions", "artifact_admission"]


def _tables(folder):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def con(sf_dir):
    return _tables(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, sf_dir, name):
    _compare(spark, con, sf_dir, name)


@pytest.mark.parametrize("name", TIES)
def test_ties(spark, name):
    _compare(spark, _tables("/root/testdata/sf0.01"), "/root/testdata/sf0.01", name)


def _compare(spark, con, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted(map(tuple, df.select(*columns).collect()), key=str)
    sql = registry.oracle_sql().get(name)
    if sql:
        assert rows == sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall(), key=str)
    else:
        assert rows
