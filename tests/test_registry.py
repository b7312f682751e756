import re

import pytest

import __spark_entry__ as registry
from check_oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
# The optional subpackage has tests of its own.
OWN = [k for k, f in registry.queries().items() if not f.__module__.startswith(("tallygrid.llm", "corpus_pipeline"))]


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(OWN) <= registry.oracle_sql().keys() <= registry.queries().keys()


@pytest.mark.parametrize("name", OWN)
def test_query_agrees_with_its_sql(spark, con, name):
    assert compare(spark, con, SF_DIR, name) is None


# Nodes that would pair all rows, leave the JVM or pull everything into one task.
FORBIDDEN = r"CartesianProduct|BroadcastNestedLoopJoin|Python|Pandas|InMemoryTableScan|SinglePartition"


@pytest.mark.parametrize("name", OWN)
def test_plan(spark, name):
    df = registry.queries()[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(FORBIDDEN, plan)


@pytest.mark.parametrize(
    "name, pushed",
    [
        ("bigger_orders", "GreaterThan(o_totalprice,250000.0)"),
        ("starts_letter", "StringStartsWith(p_name,s)"),
        ("contains", "StringContains(p_name,ing)"),
        ("starts", "StringStartsWith(c_mktsegment,MA)"),
    ],
)
def test_filter_reaches_the_scan(spark, name, pushed):
    assert pushed in registry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["ledger_summary", "yoy_change", "alerts", "letter", "grid_smooth"])
def test_single_shuffle(spark, name):
    plan = registry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_entry(spark):
    df = registry.entry(spark)
    assert df.columns == ["client", "concept", "y2025", "y2024"]
    assert df.count() > 0
