"""Driver performance: overview counts, summary stats, top/bottom lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlake.functions.expr import rnd, trunc_int
from shiftlake.operators.cleaning import with_cancellation_rate
from shiftlake.operators.common import quoted, metric, roles, text_or, tie_break, top_k, with_total_orders
from shiftlake.operators.stats import exact_median
from shiftlake.params import Params

# Statistics of float metrics are reported to 6 decimals: Spark's and
# DuckDB's float aggregates differ in summation order, which only moves
# bits far below that.
STAT_DP = 6


def _who(df: DataFrame, by) -> list:
    return [
        *[F.col(b) for b in by],
        text_or(df, "driver_name").alias("driver_name"),
        text_or(df, "driver_mobile").alias("driver_mobile"),
        text_or(df, "driver_geo_region").alias("region"),
    ]


def driver_overview(df: DataFrame, params: Params, by=(), extra: list | None = None) -> DataFrame:
    """Row counts and shift-hour buckets (one pass, partial aggregation).

    ``extra``: further aggregate columns computed in the same pass.
    """
    hc = roles(df, params)["hours"]
    if hc:
        h = metric(df, hc)
        under = F.count_if(h < 8)
        mid = F.count_if((h >= 8) & (h <= 12))
        over = F.count_if(h > 12)
    else:
        under = mid = over = F.lit(0)
    mobile = F.col("driver_mobile") if "driver_mobile" in df.columns else F.lit(None)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_drivers"),
        F.count(F.lit(1)).alias("active_drivers"),
        over.cast("bigint").alias("drivers_over_12_hours"),
        under.cast("bigint").alias("drivers_under_8_hours"),
        mid.cast("bigint").alias("drivers_8_to_12_hours"),
        F.count_distinct(mobile).alias("unique_drivers"),
        *(extra or []),
    )


def summary_stats(df: DataFrame, params: Params, by=()) -> DataFrame:
    """mean / median / std (ddof 1) / min / max per metric, long format.

    Metrics: orders (as ``total_orders``), cash (as ``total_cash``), idle and
    cancelled under their own column names; only numeric columns.
    """
    r = roles(df, params)
    picked = []
    for role, key in (("orders", "total_orders"), ("cash", "total_cash"), ("idle", None), ("cancelled", None)):
        col = r[role]
        if col is None or dict(df.dtypes)[col] not in ("double", "float", "int", "bigint", "smallint") \
                and not dict(df.dtypes)[col].startswith("decimal"):
            continue
        name = key or col
        if name not in [p[0] for p in picked]:
            picked.append((name, col))
    if not picked:
        return df.sparkSession.createDataFrame(
            [], "metric string, mean double, median double, std double, min double, max double")
    long = df.select(*by, *[F.col(quoted(c)).cast("double").alias(n) for n, c in picked]).unpivot(
        list(by), [n for n, _ in picked], "metric", "value")
    x = F.col("_x")
    med = exact_median(long, [*by, "metric"], "value", params, out="_median", extra=[
        rnd(F.avg(x), STAT_DP).alias("mean"),
        rnd(F.stddev_samp(x), STAT_DP).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    ])
    return med.select(*by, "metric", "mean", rnd("_median", STAT_DP).alias("median"), "std", "min", "max")


def top_performers(df: DataFrame, params: Params, by=()) -> DataFrame:
    """Top N rows by orders, with cash (T1); none where the frame has no orders column."""
    has_orders = roles(df, params)["orders"] is not None
    d = with_total_orders(df, params).where(F.lit(has_orders))
    cash = roles(d, params)["cash"]
    ranked = top_k(d, [F.col("total_orders").desc(), *tie_break(d)], params.top_n, by)
    return ranked.select(
        "rank", *_who(ranked, by),
        trunc_int("total_orders").alias("orders"),
        metric(ranked, cash).alias("cash_collected"),
    )


def bottom_performers(df: DataFrame, params: Params, by=()) -> DataFrame:
    """Bottom N rows by orders among rows with orders >= the minimum."""
    d = with_total_orders(df, params).where(F.col("total_orders") >= params.min_orders)
    ranked = top_k(d, [F.col("total_orders").asc(), *tie_break(d)], params.top_n, by)
    return ranked.select("rank", *_who(ranked, by), trunc_int("total_orders").alias("orders"))


def high_cancellation(df: DataFrame, params: Params, by=()) -> DataFrame:
    """Top N cancellation rates above the warning level, orders >= minimum."""
    d = with_cancellation_rate(df, params)
    cc = roles(d, params)["cancelled"]
    if cc is None:
        return top_k(d.where(F.lit(False)), [F.col("total_orders")], 1, by).select(
            "rank", *_who(d, by), F.lit(0.0).alias("cancellation_rate"), F.lit(0).cast("bigint").alias("total_cancelled"))
    hot = d.where((F.col("cancellation_rate") > params.cancellation_rate_warning)
                  & (F.col("total_orders") >= params.min_orders))
    ranked = top_k(hot, [F.col("cancellation_rate").desc(), *tie_break(hot)], params.top_n, by)
    return ranked.select(
        "rank", *_who(ranked, by),
        rnd("cancellation_rate", 2).alias("cancellation_rate"),
        trunc_int(metric(ranked, cc)).alias("total_cancelled"),
    )


def high_idle(df: DataFrame, params: Params, by=()) -> DataFrame:
    """Top N idle hours above the warning level (T4)."""
    ic = roles(df, params)["idle"]
    if ic is None:
        return top_k(df.where(F.lit(False)), [F.lit(1)], 1, by).select(
            "rank", *_who(df, by), F.lit(0.0).alias("idle_hours"))
    hot = df.where(metric(df, ic) > params.idle_hours_warning)
    ranked = top_k(hot, [metric(hot, ic).desc(), *tie_break(hot)], params.top_n, by)
    return ranked.select("rank", *_who(ranked, by), rnd(metric(ranked, ic), 2).alias("idle_hours"))


def cancellation_rates(df: DataFrame, params: Params) -> DataFrame:
    """Per-row cancellation rate (E1), keyed by the row identity."""
    d = with_cancellation_rate(df, params)
    keys = [c for c in ("Date", "driver_name", "driver_mobile", "vehicle_number") if c in d.columns]
    return d.select(*keys, F.col("total_orders"), F.col("cancellation_rate"))
