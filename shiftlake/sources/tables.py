"""Driver-day facts derived from the provided parquet tables.

``driver_day`` is one row per (events.user_id, date of events.ts): events
are aggregated *before* any join (partial + final hash aggregate, so a hot
user or a hot day is combined map-side), then joined to customer (a
shuffle join that AQE may turn into a broadcast at run time), and to
nation / region, whose sizes are fixed by the TPC-H spec (25 and 5 rows),
so broadcasting them is bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlake.functions.expr import exact_sum

# TPC-H fixes nation at 25 rows and region at 5 rows at every scale factor.
NATION_ROWS = 25
REGION_ROWS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation -> region name; both dimension tables are spec-bounded."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", "r_name"
    )


def _count_if(cond) -> F.Column:
    return F.count_if(cond).cast("double")


def driver_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical driver-day frame from events x customer x nation x region."""
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "value")
    et = F.col("event_type")
    agg = ev.groupBy("user_id", F.to_date("ts").alias("Date")).agg(
        F.count(F.lit(1)).cast("double").alias("_n"),
        _count_if(et == "purchase").alias("_purchases"),
        _count_if(et == "error").alias("_errors"),
        _count_if(et == "view").alias("_views"),
        _count_if(et == "signup").alias("_signups"),
        F.min("ts").alias("_min_ts"),
        F.max("ts").alias("_max_ts"),
        exact_sum("value").alias("_cash"),
        exact_sum(F.when(et == "purchase", F.col("value"))).alias("_fare"),
        exact_sum(F.when(et == "click", F.col("value"))).alias("_km"),
        exact_sum(F.when(et == "error", F.col("value"))).alias("_idle_km"),
    )
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    geo = _geo(spark, sf_dir)
    j = (
        agg.join(cust, agg.user_id == cust.c_custkey)
        .join(F.broadcast(geo), F.col("c_nationkey") == geo.n_nationkey)
    )
    login_hrs = F.expr("timestampdiff(MICROSECOND, _min_ts, _max_ts)") / F.lit(3.6e9)
    idle_hrs = F.col("total_login_time_in_hrs") * F.col("_errors") / F.col("_n")
    return (
        j.withColumn("total_login_time_in_hrs", login_hrs)
        .withColumn("time_spent_idle_in_hrs", idle_hrs)
        .select(
            "Date",
            F.col("c_name").alias("driver_name"),
            F.col("user_id").cast("string").alias("driver_mobile"),
            F.col("r_name").alias("driver_geo_region"),
            F.concat(F.lit("VH-"), F.col("user_id").cast("string")).alias("vehicle_number"),
            F.col("c_mktsegment").alias("vehicle_type"),
            F.col("_n").alias("allocated_orders"),
            F.col("_purchases").alias("completed_orders"),
            F.col("_errors").alias("partner_cancellation"),
            F.col("_min_ts").alias("first_recorded_login_time"),
            F.col("_max_ts").alias("last_recorded_login_time"),
            "total_login_time_in_hrs",
            (F.col("total_login_time_in_hrs") - F.col("time_spent_idle_in_hrs")).alias(
                "time_spent_orders_in_hrs"
            ),
            "time_spent_idle_in_hrs",
            F.col("_km").alias("total_distance_in_kms"),
            F.col("_idle_km").alias("distance_travelled_while_idle_in_kms"),
            F.col("_fare").alias("trip_fare"),
            (F.lit(100.0) * F.col("_signups") / F.col("_n")).alias("pct_notifs_missed_overall"),
            F.col("_n").alias("total_orders"),
            F.col("_errors").alias("orders_cancelled"),
            F.col("time_spent_idle_in_hrs").alias("idle_hours"),
            F.col("total_login_time_in_hrs").alias("online_hours"),
            F.col("_cash").alias("cash_collected"),
            F.col("_views").alias("notifications"),
        )
    )


def supplier_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second fact of the same shape from lineitem x supplier (no login times).

    One row per (l_suppkey, ship date): orders = lines, cancelled = lines with
    return flag 'R', cash = sum of extended price.
    """
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_returnflag", "l_extendedprice")
    agg = li.groupBy("l_suppkey", F.to_date("l_shipdate").alias("Date")).agg(
        F.count(F.lit(1)).cast("double").alias("_n"),
        _count_if(F.col("l_returnflag") == "R").alias("_r"),
        exact_sum("l_extendedprice").alias("_cash"),
    )
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    geo = _geo(spark, sf_dir)
    j = agg.join(sup, agg.l_suppkey == sup.s_suppkey).join(
        F.broadcast(geo), F.col("s_nationkey") == geo.n_nationkey
    )
    return j.select(
        "Date",
        F.col("s_name").alias("driver_name"),
        F.col("l_suppkey").cast("string").alias("driver_mobile"),
        F.col("r_name").alias("driver_geo_region"),
        F.concat(F.lit("VH-"), F.col("l_suppkey").cast("string")).alias("vehicle_number"),
        F.lit(None).cast("string").alias("vehicle_type"),
        F.col("_n").alias("allocated_orders"),
        (F.col("_n") - F.col("_r")).alias("completed_orders"),
        F.col("_r").alias("partner_cancellation"),
        F.col("_cash").alias("trip_fare"),
        F.col("_n").alias("total_orders"),
        F.col("_r").alias("orders_cancelled"),
        F.col("_cash").alias("cash_collected"),
    )
