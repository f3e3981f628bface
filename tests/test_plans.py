"""Plan shape: no Python UDFs, pruned scans, top-k operators, partition pruning."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from shiftlake.operators import master
from shiftlake.plans.catalog import QUERIES


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


FILE_QUERIES = {"scan_driver_day", "load_audit", "master_upsert", "master_backfill", "stream_master",
                "archive_snapshot", "scan_mixed_headers", "previous_file_by_mtime", "daily_whole_file", "master_replay_any_order"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - FILE_QUERIES))
def test_no_python_udf_in_any_query(spark, name):
    p = plan(QUERIES[name](spark, SF_SMALL))
    for node in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas", "MapInPandas"):
        assert node not in p


def test_events_scan_is_pruned_to_needed_columns(spark):
    p = plan(QUERIES["location_performance"](spark, SF_SMALL))
    line = [x for x in p.splitlines() if "events.parquet" in x][0]
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in line
    assert "props" not in line and "event_id" not in line


def test_vehicle_filter_reaches_customer_scan(spark):
    p = plan(QUERIES["location_performance"](spark, SF_SMALL))
    cust = [x for x in p.splitlines() if "customer.parquet" in x][0]
    assert "c_mktsegment" in cust  # the exclusion filter is evaluated at the customer side of the join


def test_global_top_k_is_take_ordered(spark):
    assert "TakeOrderedAndProject" in plan(QUERIES["top_performers"](spark, SF_SMALL))


def test_per_day_top_k_limits_before_shuffle(spark):
    p = plan(QUERIES["top_performers_by_day"](spark, SF_SMALL))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_keep_last_is_an_aggregate_not_a_window(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), "a", "1", "v", 1.0, 0, 0)],
                               "Date date, driver_name string, driver_mobile string, vehicle_number string, "
                               "cash_collected double, _batch long, _seq long")
    p = plan(master.keep_last(df, master.dedup_keys(df), ["_batch", "_seq"]))
    assert "max_by" in p and "partial_max_by" in p and "Window" not in p


def test_date_filter_prunes_master_partitions(spark, tmp_shared):
    df = spark.createDataFrame([(dt.date(2024, 1, d), "a", "1", "v", 1.0) for d in (1, 2, 3)],
                               "Date date, driver_name string, driver_mobile string, vehicle_number string, "
                               "cash_collected double")
    master.upsert(tmp_shared, df, 1)
    p = plan(spark.read.parquet(tmp_shared).where(F.col("Date") == dt.date(2024, 1, 2)))
    assert "PartitionFilters: [isnotnull(Date" in p and "2024-01-02" in p


def test_whole_set_fleet_average_is_a_scalar_subquery_not_a_join(spark):
    p = plan(QUERIES["risk_flags"](spark, SF_SMALL))
    assert "Subquery" in p and "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
