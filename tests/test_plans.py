"""Every registered plan beside its SQL, and the physical plans that scale depends on."""

import pytest
from oracle import SMALL, compare_frame, connect
from pyspark.sql import functions as F

import __spark_entry__ as contract
from quire.functions.text import text_hash
from quire.operators import dedup, ordered
from quire.plans import PLANS
from quire.session import table

KEYS = list(PLANS)


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("key", KEYS)
def test_plan_equals_sql(spark, con, key):
    df = contract.queries()[key](spark, SMALL)
    ok, note, rows = compare_frame(con, key, df)
    assert ok, note
    assert rows > 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def physical(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_text_is_scanned_once_for_first_wins(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", text_hash(F.col("text"), "target").alias("h"))
    plan = physical(dedup.first_wins(docs, "h", "doc_id", "doc_id"))
    assert plan.split("Initial Plan")[0].count("ArrowEvalPython") == 1
    assert "ReusedExchange" in plan or "TableCacheQueryStage" in plan
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_block_window_is_keyed(spark):
    rows = table(spark, SMALL, "events").select("user_id", "event_id")
    plan = physical(ordered.in_order(rows, ["user_id"], "event_id", position="n"))
    assert "user_id" in plan and "_block" in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = physical(contract.queries()["t2_exact_lookup"](spark, SMALL))
    pushed = plan[plan.index("PushedFilters: ["):].split("]")[0]
    assert "EqualTo(o_orderkey,37)" in pushed and "IsNotNull(o_orderstatus)" in pushed
    assert "o_totalprice" not in plan
