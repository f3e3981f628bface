"""Shift analytics over one or many days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftlake.functions.expr import exact_sum, rnd, safe_corr
from shiftlake.functions.schema import BUCKET_8_12, BUCKET_OVER_12, BUCKET_UNDER_8, ROLE_FALLBACK_NAMES
from shiftlake.operators.common import quoted, metric, roles
from shiftlake.params import Params


def _role_col(df: DataFrame, params: Params, role: str) -> str:
    return roles(df, params)[role] or ROLE_FALLBACK_NAMES[role]


def shift_durations(df: DataFrame, params: Params, by=()) -> DataFrame:
    """Three shift buckets (<8, 8-12, >12 hours) with share and averages.

    One aggregation pass with conditional sums, then ``stack`` into three
    rows: every bucket is present even when empty (counts 0, averages 0),
    with no join against a bucket spine.
    """
    hc = _role_col(df, params, "hours")
    if hc not in df.columns:
        return df.sparkSession.createDataFrame(
            [], "bucket string, bucket_order int, count bigint, pct double, avg_cash double, "
                "avg_orders double, total_active_drivers bigint")
    h = metric(df, hc)
    cash = metric(df, _role_col(df, params, "cash"))
    orders = metric(df, _role_col(df, params, "orders"))
    conds = [bucket_number(h) == i for i in range(3)]
    aggs = [F.count(F.lit(1)).alias("total_active_drivers")]
    for i, cnd in enumerate(conds):
        aggs += [
            F.count_if(cnd).alias(f"c{i}"),
            exact_sum(F.when(cnd, cash)).alias(f"s{i}"),
            exact_sum(F.when(cnd, orders)).alias(f"o{i}"),
        ]
    return bucket_rows(df.groupBy(*by).agg(*aggs), by)


def bucket_number(hours) -> Column:
    """0, 1, 2 for under 8, 8 to 12, over 12 hours."""
    return F.when(hours < 8, 0).when(hours <= 12, 1).otherwise(2)


def bucket_rows(g: DataFrame, by=()) -> DataFrame:
    """A row per bucket from one row with the counts c, cash sums s and order sums o of all three."""
    names = [BUCKET_UNDER_8, BUCKET_8_12, BUCKET_OVER_12]
    stack = "stack(3, " + ", ".join(
        f"'{n}', {i + 1}, c{i}, s{i}, o{i}" for i, n in enumerate(names)) + ") as (bucket, bucket_order, count, s, o)"
    long = g.select(*by, "total_active_drivers", F.expr(stack))
    tot, cnt = F.col("total_active_drivers"), F.col("count")
    return long.select(
        *by, "bucket", F.col("bucket_order").cast("int").alias("bucket_order"), "count",
        F.when(tot > 0, rnd(cnt / tot * F.lit(100.0), 1)).otherwise(F.lit(0.0)).alias("pct"),
        F.when(cnt > 0, rnd(F.col("s") / cnt, 2)).otherwise(F.lit(0.0)).alias("avg_cash"),
        F.when(cnt > 0, rnd(F.col("o") / cnt, 2)).otherwise(F.lit(0.0)).alias("avg_orders"),
        "total_active_drivers",
    )


def hours_correlations(df: DataFrame, params: Params, by=()) -> DataFrame:
    """Pearson correlation of duty hours with cash, notifications, orders (3 dp).

    Constant columns, single rows and missing columns give 0 instead of NaN
    or an ANSI divide-by-zero error.
    """
    hc = _role_col(df, params, "hours")
    out = []
    for role, name in (("cash", "hours_vs_cash"), ("notifications", "hours_vs_notifications"),
                       ("orders", "hours_vs_orders")):
        other = _role_col(df, params, role)
        if hc in df.columns and other in df.columns:
            c = F.coalesce(safe_corr(metric(df, hc), metric(df, other)), F.lit(0.0))
            out.append(rnd(F.nanvl(c, F.lit(0.0)), 3).alias(name))
        else:
            out.append(F.lit(0.0).alias(name))
    return df.groupBy(*by).agg(*out)


def login_hour(df: DataFrame, params: Params) -> Column | None:
    """Hour of the first login; None without such a column."""
    fc = roles(df, params)["first_login"]
    if fc is None:
        return None
    t, kind = F.col(quoted(fc)), dict(df.dtypes)[fc]
    if kind == "string":
        t = F.try_to_timestamp(F.trim(t))
    elif not (kind.startswith("timestamp") or kind == "date"):
        t = F.lit(None).cast("timestamp")  # the alias hit a non-time column: nothing parses
    return F.hour(t)


def login_hour_stats(df: DataFrame, params: Params, by=()) -> DataFrame:
    """Rows per hour of first login with average cash and notifications."""
    hr = login_hour(df, params)
    if hr is None:
        return df.sparkSession.createDataFrame(
            [], "hour int, hour_label string, driver_count bigint, avg_cash double, avg_notifications double")
    cash = metric(df, _role_col(df, params, "cash"))
    notif = metric(df, _role_col(df, params, "notifications"))
    return hour_rows(df.where(hr.isNotNull()).groupBy(*by, hr.alias("hour")).agg(
        F.count(F.lit(1)).alias("driver_count"),
        exact_sum(cash).alias("_cash"),
        exact_sum(notif).alias("_notif"),
    ), by)


def hour_rows(g: DataFrame, by=()) -> DataFrame:
    """The hours' figures from their sums."""
    n = F.col("driver_count")
    return g.select(
        *by, F.col("hour").cast("int").alias("hour"),
        F.format_string("%02d:00", F.col("hour")).alias("hour_label"),
        "driver_count",
        rnd(F.col("_cash") / n, 2).alias("avg_cash"),
        rnd(F.col("_notif") / n, 1).alias("avg_notifications"),
    )
