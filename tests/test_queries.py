import pytest
from pyspark.sql.types import StructType

from catalith.plans import catalogue, oracles

KEYS = sorted(catalogue.queries())


@pytest.mark.parametrize("name", KEYS)
def test_query_agrees_with_sql(agrees, name):
    agrees(name)


def test_every_query_has_sql():
    assert set(KEYS) == set(oracles.oracle_sql())


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert isinstance(df.schema, StructType) and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark):
    from tests.conftest import SF

    plan = catalogue.queries()["event_latest_per_key"](spark, SF)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "props" not in plan and "ReadSchema" in plan
