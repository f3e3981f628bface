"""Integrity and productivity analysis.

``activity_summary`` is one projection over the rows; flags, rankings and
scores are pure functions of it. Only the fleet average (an aggregate) and
the top-5 lists need data movement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlake.functions.expr import py_fixed, py_float_text, ratio_if_pos, rnd, score_band, trunc_int
from shiftlake.operators.common import attach_group_stats, metric, ranked, text_or, top_k
from shiftlake.params import Params

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's output text.
# ---------------------------------------------------------------------------
FLAG_VERY_HIGH_CANCEL = "🚨 Very High Cancellation Risk (>30%)"
FLAG_HIGH_CANCEL = "⚠️ High Partner Cancellation (>20%)"
FLAG_ROGUE_PATTERN = "🕵️ Rogue Pattern: High KM, Low Orders"
FLAG_IDLE_LEAKAGE = "⏱️ Idle Leakage (>40%)"
FLAG_SUSPICIOUS_KM = "📍 Suspicious KM per Order (Fleet Deviation)"
FLAG_LOW_EARNINGS = "💰 High KM but Low Earnings"
FLAG_NOTIF_MISS = "📵 High Notif Miss Rate (Acceptance Manipulation Proxy)"
ROGUE_STATUS = "⚠ Potential Off-Platform Delivery Risk"
STATUS_INTERVENTION = "Immediate Intervention"
STATUS_REVIEW = "Needs Review"
STATUS_GOOD = "Good"
FLAGS_SEPARATOR = "; "

ACTIVITY_COLUMNS = [
    "total_orders", "completed_orders", "partner_cancels", "cancel_pct", "total_km",
    "total_earnings", "first_activity", "last_activity", "working_window", "active_time",
    "idle_time", "idle_pct", "km_per_order", "earnings_per_km", "orders_per_hour", "missed_notif_pct",
]


def _ident(df: DataFrame) -> list:
    """Row identity carried through every integrity result."""
    return [
        (F.col("Date") if "Date" in df.columns else F.lit(None).cast("date")).alias("Date"),
        text_or(df, "driver_name").alias("driver_name"),
        text_or(df, "driver_mobile").alias("mobile"),
        text_or(df, "vehicle_number", None).alias("vehicle_number"),
    ]


IDENT = ["Date", "driver_name", "mobile", "vehicle_number"]


def _tie(df: DataFrame) -> list:
    return [F.col(c).asc_nulls_first() for c in ("driver_name", "mobile", "vehicle_number", "Date")]


def activity_summary(df: DataFrame, params: Params | None = None) -> DataFrame:
    """Per-row activity metrics with guarded ratios (denominator > 0 else 0).

    Counts are truncated to integers, ratios and amounts rounded to 2 dp,
    the missed-notification share is passed through unrounded.
    """
    g = lambda n: metric(df, n)
    assigned, completed, partner = g("allocated_orders"), g("completed_orders"), g("partner_cancellation")
    window, active, idle = g("total_login_time_in_hrs"), g("time_spent_orders_in_hrs"), g("time_spent_idle_in_hrs")
    km, earn = g("total_distance_in_kms"), g("trip_fare")
    ts = lambda n: (F.col(n) if n in df.columns else F.lit(None)).cast("timestamp_ntz")
    whole = {"total_orders": assigned, "completed_orders": completed, "partner_cancels": partner}
    two_dp = {
        "cancel_pct": ratio_if_pos(partner, assigned, 100.0), "total_km": km, "total_earnings": earn,
        "working_window": window, "active_time": active, "idle_time": idle,
        "idle_pct": ratio_if_pos(idle, window, 100.0), "km_per_order": ratio_if_pos(km, completed),
        "earnings_per_km": ratio_if_pos(earn, km), "orders_per_hour": ratio_if_pos(completed, window),
    }
    plain = {"first_activity": ts("first_recorded_login_time"), "last_activity": ts("last_recorded_login_time"),
             "missed_notif_pct": g("pct_notifs_missed_overall")}
    ident = _ident(df)
    # every metric is computed once; the rounding, which uses it several times, comes in a second step
    raw = df.select(*ident, *[c.alias(k) for k, c in {**whole, **two_dp, **plain}.items()])
    return raw.select(*IDENT, *[
        trunc_int(c).alias(c) if c in whole else rnd(c, 2).alias(c) if c in two_dp else F.col(c) for c in ACTIVITY_COLUMNS])


def fleet_km_per_order(act: DataFrame, by=()) -> DataFrame:
    """Mean of the (rounded) km-per-order over rows with completed orders, else 0.

    The 2-dp inputs are summed as decimals, so the mean is the same for any
    partitioning.
    """
    has = F.col("completed_orders") > 0
    s = F.sum(F.when(has, F.col("km_per_order").cast("decimal(18,2)")))
    n = F.count(F.when(has, F.lit(1)))
    return act.groupBy(*by).agg(
        F.when(n > 0, s.cast("double") / n).otherwise(F.lit(0.0)).alias("fleet_avg_km_per_order"))


def _flags_expr():
    c = F.col
    cancel, km, comp, idle = c("cancel_pct"), c("total_km"), c("completed_orders"), c("idle_pct")
    kpo, earn, missed, fleet = c("km_per_order"), c("total_earnings"), c("missed_notif_pct"), c("fleet_avg_km_per_order")
    return F.filter(F.array(
        F.when(cancel > 30, F.lit(FLAG_VERY_HIGH_CANCEL)).when(cancel > 20, F.lit(FLAG_HIGH_CANCEL)),
        F.when((km > 50) & (comp < 3) & (cancel > 15), F.lit(FLAG_ROGUE_PATTERN)),
        F.when(idle > 40, F.lit(FLAG_IDLE_LEAKAGE)),
        F.when((kpo > fleet * F.lit(1.5)) & (comp > 0), F.lit(FLAG_SUSPICIOUS_KM))
         .when((km > 20) & (earn < km * F.lit(5)), F.lit(FLAG_LOW_EARNINGS)),
        F.when(missed > 50, F.lit(FLAG_NOTIF_MISS)),
    ), lambda x: x.isNotNull())


def risk_flags(act: DataFrame, params: Params, by=()) -> DataFrame:
    """Rows with at least one risk flag, flags in rule order.

    The fleet average is per snapshot: one scalar for ``by=()``, one value
    per group otherwise (attached by a size-checked broadcast join).
    """
    fleet = fleet_km_per_order(act, by)
    withavg = attach_group_stats(act, fleet, by, params)
    flagged = withavg.withColumn("flags", _flags_expr()).where(F.size("flags") > 0)
    metrics_text = F.concat(
        F.lit("Cancel: "), py_float_text("cancel_pct"), F.lit("%, Idle: "), py_float_text("idle_pct"),
        F.lit("%, KM/Order: "), py_float_text("km_per_order"))
    return flagged.select(
        *IDENT, "flags",
        F.array_join("flags", FLAGS_SEPARATOR).alias("flags_text"),
        metrics_text.alias("metrics"),
    )


def rogue_detection(df: DataFrame, params: Params | None = None) -> DataFrame:
    """Rows with partner cancellations and more than 5 km travelled while idle (P5)."""
    partner = metric(df, "partner_cancellation")
    idle_km = metric(df, "distance_travelled_while_idle_in_kms")
    return df.where((partner > 0) & (idle_km > 5)).select(
        (F.col("Date") if "Date" in df.columns else F.lit(None).cast("date")).alias("Date"),
        (F.col("driver_name") if "driver_name" in df.columns else F.lit(None).cast("string")).alias("driver_name"),
        (F.col("driver_mobile") if "driver_mobile" in df.columns else F.lit(None).cast("string")).alias("mobile"),
        text_or(df, "vehicle_number", None).alias("vehicle_number"),
        trunc_int(partner).alias("partner_cancels"),
        rnd(idle_km, 2).alias("idle_km"),
        F.lit(ROGUE_STATUS).alias("status"),
    )


def rankings(act: DataFrame, params: Params, by=()) -> DataFrame:
    """Top and bottom N among rows with a working window over 1 hour (T5).

    top key    = orders_per_hour - cancel_pct/100 - idle_pct/100 (desc)
    bottom key = idle_pct + cancel_pct - 10 * orders_per_hour    (desc)
    """
    c = F.col
    active = act.where(c("working_window") > 1)
    top_key = c("orders_per_hour") - c("cancel_pct") / F.lit(100) - c("idle_pct") / F.lit(100)
    bot_key = c("idle_pct") + c("cancel_pct") - c("orders_per_hour") * F.lit(10)
    n = params.ranking_n
    top = top_k(active.withColumn("rank_key", top_key), [c("rank_key").desc(), *_tie(active)], n, by)
    bot = top_k(active.withColumn("rank_key", bot_key), [c("rank_key").desc(), *_tie(active)], n, by)
    cols = ["rank", *IDENT, *ACTIVITY_COLUMNS, "rank_key"]
    top_label = F.concat(c("driver_name"), F.lit(" ("), py_float_text("orders_per_hour"), F.lit(" orders/hr)"))
    bot_label = F.concat(c("driver_name"), F.lit(" ("), py_float_text("idle_pct"), F.lit("% idle)"))
    return (top.select(F.lit("top_5").alias("rank_type"), *cols, top_label.alias("label"))
            .unionByName(bot.select(F.lit("bottom_5").alias("rank_type"), *cols, bot_label.alias("label"))))


def integrity_scores(act: DataFrame, params: Params | None = None) -> DataFrame:
    """Weighted 0-100 score: 30% cancel, 20% idle, 15% notif miss, 15% km, 20% earnings.

    Status bands use the unrounded score; the 1-dp score drives the display class.
    """
    c = F.col
    cancel_s = F.greatest(F.lit(0.0), F.lit(100.0) - c("cancel_pct") * F.lit(2))
    idle_s = F.greatest(F.lit(0.0), F.lit(100.0) - c("idle_pct"))
    acc_s = F.greatest(F.lit(0.0), F.lit(100.0) - c("missed_notif_pct"))
    km_s = F.when(c("km_per_order") < 15, F.lit(100.0)).otherwise(F.lit(50.0))
    earn_s = F.when(c("total_earnings") > 500, F.lit(100.0)).otherwise(F.lit(50.0))
    final = (cancel_s * F.lit(0.30) + idle_s * F.lit(0.20) + acc_s * F.lit(0.15)
             + km_s * F.lit(0.15) + earn_s * F.lit(0.20))
    status = (F.when(final < 40, F.lit(STATUS_INTERVENTION))
              .when(final < 60, F.lit(STATUS_REVIEW)).otherwise(F.lit(STATUS_GOOD)))
    return act.select(*IDENT, rnd(final, 1).alias("score"), status.alias("status")).withColumn(
        "score_class", score_band("score"))


def ranked_scores(act: DataFrame, params: Params | None = None) -> DataFrame:
    """The scores with their place, worst first (T9); ties by name, mobile, vehicle, Date."""
    scores = integrity_scores(act, params)
    return ranked(scores, [F.col("score").asc_nulls_first(), *_tie(scores)])


def integrity_exec_summary(act: DataFrame, params: Params, by=()) -> DataFrame:
    """Drivers analysed, mean cancel %, mean idle %, number of flagged rows.

    Two passes: the fleet average, then one aggregate that counts rows,
    sums the percentages and counts the rows whose flag list is non-empty.
    """
    fleet = fleet_km_per_order(act, by)
    flagged = attach_group_stats(act, fleet, by, params).withColumn("flags", _flags_expr())
    n = F.count(F.lit(1))
    out = flagged.groupBy(*by).agg(
        n.alias("total_drivers"),
        (F.sum(F.col("cancel_pct").cast("decimal(18,2)")).cast("double") / n).alias("avg_cancel_pct"),
        (F.sum(F.col("idle_pct").cast("decimal(18,2)")).cast("double") / n).alias("avg_idle_pct"),
        F.count_if(F.size("flags") > 0).alias("risk_count"),
    )
    return out.select(
        *by, "total_drivers", "avg_cancel_pct", "avg_idle_pct",
        rnd("avg_cancel_pct", 1).alias("avg_cancel_pct_1dp"), rnd("avg_idle_pct", 1).alias("avg_idle_pct_1dp"),
        F.concat(py_fixed("avg_cancel_pct", 1, commas=False), F.lit("%")).alias("avg_cancel_pct_text"),
        F.concat(py_fixed("avg_idle_pct", 1, commas=False), F.lit("%")).alias("avg_idle_pct_text"),
        F.col("risk_count").cast("bigint").alias("risk_count"))
