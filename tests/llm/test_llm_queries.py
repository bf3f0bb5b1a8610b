"""Every query of the subpackage against its SQL, or at least that it runs."""

import pytest

from gridloom.llm import queries as q

SQL = q.oracle_sql()


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query(spark, sf, compared, name):
    df = q.queries()[name](spark, sf)
    if name in SQL:
        compared.same(df, SQL[name])
    else:
        assert df.columns and df.count() >= 0
