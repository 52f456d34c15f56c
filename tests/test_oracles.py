import pytest

from conftest import agree
from folioflow.plans.oracles import ORACLES
from folioflow.plans.queries import QUERIES

WITHOUT_SQL = sorted(set(QUERIES) - set(ORACLES))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, duck, root, name):
    agree(spark, duck, root, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_query_without_sql_runs(spark, root, name):
    df = QUERIES[name](spark, root)
    assert df.columns and df.count() >= 0


def test_entry(spark, root):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["query_id", "doc_id", "rrf_score", "rank"]
