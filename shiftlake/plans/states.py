"""Daily states of the monthly section (A8-A11, R8): one small mergeable table instead of a second reading of the month.

A state row holds, for one Date and one region, shift bucket, login hour or
the whole day, the number of rows, decimal sums of cash, notifications and
orders, and for the whole day the sums of products that correlations need.
States of any dates add up, so a span of days is a filter on the partition
column and an aggregate of a few rows per day. ``refresh`` rewrites the
states of given dates from the master.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlake.functions.expr import rnd
from shiftlake.functions.schema import ROLE_FALLBACK_NAMES
from shiftlake.operators import master, regions, shifts
from shiftlake.operators.common import metric, quoted, roles
from shiftlake.params import Params

PAIRS = (("cash", "hours_vs_cash"), ("notifications", "hours_vs_notifications"), ("orders", "hours_vs_orders"))


def daily_states(df: DataFrame, params: Params) -> DataFrame:
    """(Date, kind, key, n, cash, notifications, orders, products) of the rows with a Date, in one aggregate."""
    r = roles(df, params)

    def value(role):
        return metric(df, r[role] or ROLE_FALLBACK_NAMES[role])

    region = r["region"] or ROLE_FALLBACK_NAMES["region"]
    hour = shifts.login_hour(df, params)
    rows = df.where(F.col("Date").isNotNull()).select(
        "Date", *[value(x).alias(x) for x in ("cash", "notifications", "orders", "hours")],
        (F.col(quoted(region)).cast("string") if region in df.columns else F.lit(None).cast("string")).alias("region"),
        (hour if hour is not None else F.lit(None)).cast("string").alias("hour"))
    kinds = F.array(F.struct(F.lit("day").alias("kind"), F.lit("").alias("key")),
                    F.struct(F.lit("shift").alias("kind"), shifts.bucket_number(F.col("hours")).cast("string").alias("key")),
                    F.when(F.col("region").isNotNull(), F.struct(F.lit("region").alias("kind"), F.col("region").alias("key"))),
                    F.when(F.col("hour").isNotNull(), F.struct(F.lit("hour").alias("kind"), F.col("hour").alias("key"))))
    long = rows.withColumn("of", F.explode(F.filter(kinds, lambda x: x.isNotNull())))
    day = F.col("of.kind") == "day"

    def total(name):
        return F.coalesce(F.sum(F.col(name).cast("decimal(18,4)")), F.lit(0).cast("decimal(28,4)")).alias(name)

    def products(x, y, name):
        return F.sum(F.when(day, F.col(x) * F.col(y))).alias(name)

    return long.groupBy("Date", F.col("of.kind").alias("kind"), F.col("of.key").alias("key")).agg(
        F.count(F.lit(1)).alias("n"), total("cash"), total("notifications"), total("orders"),
        F.sum(F.when(day, F.col("hours"))).alias("hours"), products("hours", "hours", "hours_hours"),
        *[F.sum(F.when(day, F.col(x))).alias(f"sum_{x}") for x, _ in PAIRS],
        *[products(x, x, f"{x}_{x}") for x, _ in PAIRS], *[products("hours", x, f"hours_{x}") for x, _ in PAIRS])


def refresh(spark: SparkSession, master_path: str, states_path: str, params: Params, dates=None) -> None:
    """Compute the states of ``dates`` (default: all) from the master and replace them."""
    rows = master.read_master(spark, master_path)
    if dates is not None:
        rows = rows.where(F.col("Date").isin(list(dates)))
    master.write_by_date(daily_states(rows, params), states_path)


def _sums(states: DataFrame, kind: str, key: str) -> DataFrame:
    """The sums by key over all dates, under the names that the direct aggregates use."""
    return states.where(F.col("kind") == kind).groupBy(F.col("key").alias(key)).agg(
        F.sum("n").alias("driver_count"), F.sum("cash").cast("double").alias("_cash"),
        F.sum("notifications").cast("double").alias("_notif"), F.sum("orders").cast("double").alias("_orders"))


def location_breakdown(states: DataFrame) -> DataFrame:
    return regions.breakdown_rows(_sums(states, "region", "region"))


def login_hour_stats(states: DataFrame) -> DataFrame:
    return shifts.hour_rows(_sums(states, "hour", "hour").withColumn("hour", F.col("hour").cast("int")))


def shift_durations(states: DataFrame) -> DataFrame:
    one = states.where("kind = 'shift'")
    aggs = [F.coalesce(F.sum("n"), F.lit(0)).alias("total_active_drivers")]
    for i in range(3):
        own = F.col("key") == str(i)
        aggs += [F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0)).alias(f"c{i}"),
                 *[F.coalesce(F.sum(F.when(own, F.col(c))), F.lit(0)).cast("double").alias(f"{c[0] if c != 'cash' else 's'}{i}")
                   for c in ("cash", "orders")]]
    return shifts.bucket_rows(one.agg(*aggs))


def hours_correlations(states: DataFrame) -> DataFrame:
    days = states.where("kind = 'day'")

    def total(name):
        return F.sum(name)

    out = []
    n = F.sum("n")
    for x, name in PAIRS:
        cov = total(f"hours_{x}") - total("hours") * total(f"sum_{x}") / n
        var_h = total("hours_hours") - total("hours") * total("hours") / n
        var_x = total(f"{x}_{x}") - total(f"sum_{x}") * total(f"sum_{x}") / n
        tiny = F.lit(1e-12)  # what is left of a constant column's variance is rounding
        flat = (var_h <= tiny * total("hours_hours")) | (var_x <= tiny * total(f"{x}_{x}"))
        out.append(rnd(F.when(n > 1, F.when(~flat, F.try_divide(cov, F.sqrt(F.abs(var_h)) * F.sqrt(F.abs(var_x))))
                              ).otherwise(F.lit(None)), 3).alias(name))
    return days.agg(*out).select(*[F.coalesce(c, F.lit(0.0)).alias(c) for _, c in PAIRS])


def monthly(states: DataFrame) -> dict[str, DataFrame]:
    """The monthly section from states."""
    return {"shift_durations": shift_durations(states), "hours_correlations": hours_correlations(states),
            "location_breakdown": location_breakdown(states), "login_hour_stats": login_hour_stats(states)}
