"""Every registered query against its SQL on DuckDB, and the shape of the plans."""

import pytest

import __spark_entry__ as registered
from tests.oracle import connect, difference

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registered.QUERIES, registered.ORACLES


def test_all_are_registered():
    assert QUERIES.items() <= registered.queries().items()
    assert ORACLES.items() <= registered.oracle_sql().items()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got) > 0
    assert difference(got, duck.sql(ORACLES[name]).df()) is None


def test_entry(spark):
    assert registered.entry(spark).count() > 0


BATCH = sorted(n for n in QUERIES if not n.startswith(("stream_", "message_stream_", "write_", "read_")))


@pytest.mark.parametrize("name", BATCH)
def test_plan(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert "BatchEvalPython" not in plan
    # A window always has a partition key.
    assert not ("SinglePartition" in plan and "Window" in plan)


def test_decode_is_one_stage(spark):
    plan = QUERIES["signal_decode"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


@pytest.mark.parametrize("name", ["signal_stats", "gauge_snapshot", "fleet_state", "subscriber_set", "latest_row"])
def test_hash_aggregation(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("HashAggregate") >= 2


def test_scan_is_pruned_and_filtered(spark):
    plan = QUERIES["phone_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in plan
