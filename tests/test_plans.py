import pytest

from tessera.plans import corpus, edges, search
from tests.compare import same

PLANS = (search, edges, corpus)
CASES = [(name, plan.QUERIES[name], plan.ORACLES[name]) for plan in PLANS for name in plan.QUERIES]


@pytest.mark.parametrize("name,query,sql", CASES, ids=[c[0] for c in CASES])
def test_query_matches_its_sql(spark, sf_dir, name, query, sql):
    same(spark, sf_dir, query, sql)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
