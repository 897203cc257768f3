import pytest

from equisift.plans.queries import ORACLE_SQL, QUERIES

from .compare import assert_same, connect


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["q04_stratified_split", "q13_roulette", "q20_kmeans_representatives"])
def test_partitions_do_not_matter(spark, sf_dir, name):
    found = []
    for n in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted(map(tuple, QUERIES[name](spark, sf_dir).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert found[0] == found[1]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
