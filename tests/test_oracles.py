import pytest
from oracle import same

from panelworks.plans.oracles import oracle_sql
from panelworks.plans.queries import queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    same(spark, sf, queries()[name], oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["origin", "n", "rank_ic"]
    assert set(oracle_sql()) <= set(__spark_entry__.queries())
