import pytest
from compare import same

from textloom.llm import queries as llm

SQL = llm.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, duck, name):
    same(spark, sf, duck, llm.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(llm.queries()) - set(SQL)))
def test_runs(spark, sf, name):
    df = llm.queries()[name](spark, sf)
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name.endswith("_found"):
        assert len({tuple(r) for r in rows}) == len(rows) > 0
