"""Every query against its SQL, and the shape of the plans."""

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry_module
from dispatchmart.catalog.oracles import ORACLES
from dispatchmart.catalog.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_catalogues_match():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf_dir, name):
    assert compare(spark, con, name, sf_dir) == ""


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["location_feed", "free_text_feed", "split_field_feed", "time_to_shift"])
def test_rules_need_no_shuffle_and_no_python(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert "o_totalprice" not in plan


@pytest.mark.parametrize(
    "name", ["fact_with_keys", "geocode_budget", "scd2_dimension", "message_facts", "not_in_insert", "except_distinct"]
)
def test_plans_have_no_cross_join_and_no_python(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert operator not in plan


def test_marking_the_head_does_not_shuffle_the_table(spark, sf_dir):
    plan = QUERIES["split_head_rest"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert "Exchange rangepartitioning" not in plan and "hashpartitioning" not in plan


def test_difference_shuffles_once(spark, sf_dir):
    plan = QUERIES["except_distinct"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Join" not in plan
