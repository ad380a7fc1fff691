"""Each case on small model tables gives the rows of its SQL."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import fixtures  # noqa: E402
from test_catalog import rows  # noqa: E402

from noetik.plans.cases import CASES, filled  # noqa: E402


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, name):
    plan, sql = CASES[name]
    tables = {n: fixtures.sql(n) for n in fixtures.TABLES}
    got = rows(plan(lambda n: fixtures.table(spark, n)).toPandas())
    want = rows(duckdb.connect().execute(filled(sql, tables)).df())
    assert got == want and got[1]
