import pytest

from tesserine.llm import queries
from tests.llm.conftest import SF
from tests.oracle import connect, same


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    mine, theirs = same(queries.QUERIES[name](spark, SF), queries.SQL[name], connect(SF))
    assert mine == theirs
