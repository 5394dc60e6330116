import pytest
from chunkweave.llm import queries

from ..compare import DATA, same


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    same(spark, queries.queries()[name], queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_runs(spark, name):
    rows = queries.queries()[name](spark, DATA)
    assert rows.count() > 0
    first = {"op1": "length", "op7": "doc_id"}.get(name.split("_")[0], "doc_id")
    assert first in rows.columns
