"""Each query of the library gives the rows of its SQL on the smallest tables."""

import pytest

from quillstone.plans import registry
from tests.oracle import compare

D = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    q = registry.queries()[name]
    if name in SQL:
        compare(q, SQL[name], spark, D)
    else:
        assert q(spark, D).count() > 0


def test_same_result_with_other_partitioning(spark):
    q, kept = registry.queries()["hybrid_topk"], spark.conf.get("spark.sql.shuffle.partitions")
    first = sorted(map(tuple, q(spark, D).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        assert sorted(map(tuple, q(spark, D).collect())) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
