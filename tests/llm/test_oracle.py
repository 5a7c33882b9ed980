import pytest

from tidemill.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(same_as_sql, name):
    same_as_sql(queries.QUERIES[name], queries.ORACLE[name], "/root/testdata/sf0.01")
