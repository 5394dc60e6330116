import pytest
from chunkweave.plans import oracle
from chunkweave.plans import queries as plans

from .compare import DATA, same

#: Held against exact search instead.
NO_SQL = {"search_approximate"}


def test_every_query_has_its_twin():
    assert set(plans.queries()) == {*oracle.oracle_sql(), *NO_SQL}


def test_approximate_search_recalls(spark):
    rows = plans.search_approximate(spark, DATA).collect()
    assert rows and {r.n_exact for r in rows} == {20} and sum(r.recall for r in rows) >= 0.9 * len(rows)


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_matches_sql(spark, name):
    same(spark, plans.queries()[name], oracle.oracle_sql()[name])


def test_entry():
    import __spark_entry__ as entry

    assert {*plans.queries()} <= {*entry.queries()} and {*entry.oracle_sql()} <= {*entry.queries()}


def test_flagship(spark):
    rows = plans.retrieve_one(spark, DATA).orderBy("rank").collect()
    assert [r.rank for r in rows] == [1, 2, 3, 4] and rows[0].score >= rows[3].score and "(l. " in rows[0].reference
