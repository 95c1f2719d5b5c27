import os

import pytest
from compare import same

from textloom import queries as core

NAMES = sorted(core.queries())
SQL = core.oracle_sql()


@pytest.mark.skipif(not os.path.isdir(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")), reason="no tables")
@pytest.mark.parametrize("name", [n for n in NAMES if n in SQL])
def test_against_sql(spark, sf, duck, name):
    same(spark, sf, duck, core.queries()[name], SQL[name])


@pytest.mark.parametrize("name", [n for n in NAMES if n not in SQL])
def test_runs(spark, sf, name):
    df = core.queries()[name](spark, sf)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_sql_names_queries():
    assert set(SQL) <= set(NAMES)
