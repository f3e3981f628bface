"""Region rollups (A4 location performance, A9 location breakdown, A5 counts)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlake.functions.expr import exact_sum, rnd, trunc_int
from shiftlake.functions.schema import ROLE_FALLBACK_NAMES
from shiftlake.operators.common import quoted, metric, roles, with_total_orders
from shiftlake.params import Params

REGION = "driver_geo_region"


def location_performance(df: DataFrame, params: Params, by=()) -> DataFrame:
    """Per region: drivers, orders, cash, cancellations and the pooled rate.

    NULL regions are dropped (as a pandas groupby does). Sums are exact
    (decimal) so they do not depend on partitioning; the rate is
    sum(cancelled) / sum(orders) on the truncated integer totals, 2 dp.
    """
    if REGION not in df.columns:  # no region: the full columns, no rows
        df = df.withColumn(REGION, F.lit(None).cast("string"))
    d = with_total_orders(df, params)
    r = roles(d, params)
    has_orders = r["orders"] is not None
    g = d.where(F.col(REGION).isNotNull()).groupBy(*by, F.col(REGION).alias("region")).agg(
        F.count(F.lit(1)).alias("driver_count"),
        exact_sum("total_orders").alias("_orders"),
        exact_sum(metric(d, r["cash"])).alias("_cash"),
        exact_sum(metric(d, r["cancelled_region"])).alias("_cancelled"),
    )
    tot_orders = trunc_int("_orders") if has_orders else F.lit(0).cast("bigint")
    tot_cancel = trunc_int("_cancelled") if r["cancelled_region"] else F.lit(0).cast("bigint")
    g = g.select(
        *by, "region", "driver_count",
        tot_orders.alias("total_orders"),
        (F.col("_orders") / F.col("driver_count") if has_orders else F.lit(0.0)).alias("avg_orders_per_driver"),
        F.col("_cash").alias("total_cash"),
        (F.col("_cash") / F.col("driver_count")).alias("avg_cash_per_driver"),
        tot_cancel.alias("total_cancelled"),
    )
    rate_ok = (F.col("total_orders") > 0) & F.lit(has_orders and r["cancelled_region"] is not None)
    return g.withColumn(
        "cancellation_rate",
        F.when(rate_ok, rnd(F.col("total_cancelled") / F.col("total_orders") * F.lit(100.0), 2)).otherwise(F.lit(0.0)),
    )


def region_count_expr(df: DataFrame):
    """Distinct non-NULL regions as an aggregate expression (0 without the column)."""
    if REGION not in df.columns:
        return F.lit(0).cast("bigint")
    return F.count_distinct(REGION)


def location_breakdown(df: DataFrame, params: Params, by=()) -> DataFrame:
    """Monthly region rollup of cash, notifications and orders."""
    r = roles(df, params)
    region = r["region"] or ROLE_FALLBACK_NAMES["region"]
    if region not in df.columns:  # no region: the full columns, no rows
        df = df.withColumn(region, F.lit(None).cast("string"))
    cash = metric(df, r["cash"] or ROLE_FALLBACK_NAMES["cash"])
    notif = metric(df, r["notifications"] or ROLE_FALLBACK_NAMES["notifications"])
    orders = metric(df, r["orders"] or ROLE_FALLBACK_NAMES["orders"])
    g = df.where(F.col(quoted(region)).isNotNull()).groupBy(*by, F.col(quoted(region)).cast("string").alias("region")).agg(
        F.count(F.lit(1)).alias("driver_count"),
        exact_sum(cash).alias("_cash"),
        exact_sum(notif).alias("_notif"),
        exact_sum(orders).alias("_orders"),
    )
    return breakdown_rows(g, by)


def breakdown_rows(g: DataFrame, by=()) -> DataFrame:
    """The breakdown's figures from its sums."""
    n = F.col("driver_count")
    return g.select(
        *by, "region", "driver_count",
        rnd("_cash", 2).alias("total_cash"),
        rnd(F.col("_cash") / n, 2).alias("avg_cash"),
        trunc_int("_notif").alias("total_notifications"),
        rnd(F.col("_notif") / n, 1).alias("avg_notifications"),
        trunc_int("_orders").alias("total_orders"),
        rnd(F.col("_orders") / n, 1).alias("avg_orders"),
    )
