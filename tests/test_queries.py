import pytest

import __spark_entry__ as entry
from tests.compare import duck_rows, rows_of

SF = "/root/testdata/sf0.001"
from quillon.plans.registry import ORACLE_SQL, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    assert rows_of(QUERIES[name](spark, SF)) == duck_rows(ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", ["stat03_two_way_interval", "ml02_ridge_prediction", "ml11_transport_targets", "snk09_table_digest"])
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
