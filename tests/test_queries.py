import pytest
from oracle import connect, same

from blockyard.plans.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf_dir, con, name):
    assert same(QUERIES[name](spark, sf_dir), con, SQL[name]) > 0


@pytest.mark.parametrize("name", ["flagship_page_blocks", "p6_page_text"])
def test_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() == 50


def test_dispositions_add_up(spark, sf_dir):
    from blockyard.operators.regions import unaccounted

    assert unaccounted(QUERIES["flagship_page_blocks"](spark, sf_dir)).count() == 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
