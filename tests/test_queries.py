"""Every registered query outside the llm subpackage against its SQL, or at least that it runs."""

import pytest

from gridloom.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf, compared, name):
    df = registry.queries()[name](spark, sf)
    if name in SQL:
        compared.same(df, SQL[name])
    else:
        assert df.columns and df.count() >= 0


def test_flagship_is_registered():
    assert registry.FLAGSHIP in registry.queries()
