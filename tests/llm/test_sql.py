"""The operators that SQL can express give DuckDB's rows."""

import pytest

from millrace.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_rows(name, spark, duck, sf_dir):
    df = queries.queries()[name](spark, sf_dir)
    want = duck.sql(queries.oracle_sql()[name])
    assert want.columns == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())
