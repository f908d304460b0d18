import pytest

from catalith.llm import oracles, queries

KEYS = sorted(oracles.oracle_sql())


@pytest.mark.parametrize("name", KEYS)
def test_query_agrees_with_sql(agrees, name):
    agrees(name)


def test_one_query_for_each_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.queries())
    assert numbers == list(range(1, 11))


@pytest.mark.parametrize("name", ["op2_mix_sources", "op5_preferences", "op7_licences", "op8_pii"])
def test_native_plans_hold_no_python(spark, name):
    from tests.conftest import SF

    plan = queries.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
