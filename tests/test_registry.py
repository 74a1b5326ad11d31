"""Every registered query against its DuckDB oracle on the smallest fixture."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from quotalake.plans import registry
from tools.check_oracle import TABLES, rows_of, type_mismatches

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "estimated_cost_usd" in df.columns


@pytest.mark.parametrize("key", sorted(registry.queries()))
def test_query_matches_oracle(spark, con, key):
    sdf = E.queries()[key](spark, SF)
    spdf = pd.DataFrame(sdf.collect(), columns=sdf.columns)
    sql = E.oracle_sql()[key]
    opdf = con.execute(sql).fetchdf()
    assert sorted(spdf.columns) == sorted(opdf.columns)
    assert type_mismatches(sdf, con, sql) == {}
    assert rows_of(spdf) == rows_of(opdf)
