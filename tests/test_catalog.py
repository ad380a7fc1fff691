"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pandas as pd
import pytest

from noetik.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES.split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df):
    cell = lambda v: "null" if pd.isna(v) else repr(round(float(v), 8)) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)
    return sorted(df.columns), sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, db, name):
    assert rows(catalog.queries()[name](spark, SF).toPandas()) == rows(db.execute(catalog.oracle_sql()[name]).df())
