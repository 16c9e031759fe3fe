"""Every query of the graph over the smallest tables against its SQL."""

import duckdb
import pytest

from loomgraph.plans import driver_queries, source_queries, upkeep_queries  # noqa: F401  registers its queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(driver_queries.ORACLES))
def test_query(spark, oracle, name):
    df = driver_queries.QUERIES[name](spark, SF)
    want = oracle.sql(driver_queries.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    found = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
    order = [want.columns.index(c) for c in columns]
    assert found == sorted(str(tuple(r[k] for k in order)) for r in want.fetchall())
