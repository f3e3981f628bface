"""Integrity chain: activity ratios, flag rules and edges, rogue rule, rankings, scores."""

from fixtures import frame
from pyspark.sql import functions as F

from shiftlake.operators import integrity as I
from shiftlake.params import Params

P = Params()


def act(spark, rows):
    return I.activity_summary(frame(spark, rows), P)


def flags_by_name(spark, rows, by=()):
    out = I.risk_flags(act(spark, rows), P, by).collect()
    return {r["driver_name"]: list(r["flags"]) for r in out}


def test_activity_guarded_ratios_and_rounding(spark):
    r = act(spark, [dict(allocated_orders=3, completed_orders=0, partner_cancellation=1,
                         total_login_time_in_hrs=0, total_distance_in_kms=10, trip_fare=7)]).first()
    assert r["cancel_pct"] == 33.33 and r["idle_pct"] == 0.0 and r["km_per_order"] == 0.0
    assert r["earnings_per_km"] == 0.7 and r["orders_per_hour"] == 0.0 and r["total_orders"] == 3


def test_cancel_flag_edges_on_rounded_values(spark):
    cases = {"a": 20.0, "b": 20.01, "c": 30.0, "d": 30.004, "e": 30.01}
    rows = [dict(driver_name=k, allocated_orders=100000, partner_cancellation=v * 1000, completed_orders=1,
                 total_distance_in_kms=1, trip_fare=100) for k, v in cases.items()]
    f = flags_by_name(spark, rows)
    assert "a" not in f
    assert f["b"] == [I.FLAG_HIGH_CANCEL]
    assert f["c"] == [I.FLAG_HIGH_CANCEL]
    assert f["d"] == [I.FLAG_HIGH_CANCEL]       # 30.004 rounds to 30.0: not > 30
    assert f["e"] == [I.FLAG_VERY_HIGH_CANCEL]


def test_low_earnings_flag_when_no_completed_orders(spark):
    rows = [dict(driver_name="z", completed_orders=0, total_distance_in_kms=60, trip_fare=100)]
    assert flags_by_name(spark, rows)["z"] == [I.FLAG_LOW_EARNINGS]
    s = I.integrity_scores(act(spark, rows), P).first()
    # km per order is 0 (no completed orders) -> km score 100
    assert s["score"] == round(100 * 0.30 + 100 * 0.20 + 100 * 0.15 + 100 * 0.15 + 50 * 0.20, 1)


def test_suspicious_km_uses_fleet_average(spark):
    rows = [dict(driver_name=n, completed_orders=10, total_distance_in_kms=km, trip_fare=10000)
            for n, km in (("p", 10), ("q", 10), ("r", 40))]
    f = flags_by_name(spark, rows)
    assert f == {"r": [I.FLAG_SUSPICIOUS_KM]}     # avg km/order 2.0, r has 4.0 > 3.0


def test_fleet_average_is_per_day_with_by(spark):
    import datetime as dt
    d2 = dt.date(2024, 1, 11)
    rows = [dict(driver_name="p", completed_orders=10, total_distance_in_kms=10, trip_fare=10000),
            dict(driver_name="q", completed_orders=10, total_distance_in_kms=40, trip_fare=10000),
            dict(driver_name="s", completed_orders=10, total_distance_in_kms=40, trip_fare=10000, Date=d2),
            dict(driver_name="t", completed_orders=10, total_distance_in_kms=40, trip_fare=10000, Date=d2)]
    assert flags_by_name(spark, rows, ("Date",)) == {"q": [I.FLAG_SUSPICIOUS_KM]}


def test_all_flags_in_rule_order(spark):
    rows = [dict(driver_name="x", allocated_orders=10, partner_cancellation=4, completed_orders=2,
                 total_distance_in_kms=100, trip_fare=1, total_login_time_in_hrs=10, time_spent_idle_in_hrs=5,
                 pct_notifs_missed_overall=60),
            dict(driver_name="y", completed_orders=20, total_distance_in_kms=1, trip_fare=1000)]
    f = flags_by_name(spark, rows)["x"]
    assert f == [I.FLAG_VERY_HIGH_CANCEL, I.FLAG_ROGUE_PATTERN, I.FLAG_IDLE_LEAKAGE, I.FLAG_SUSPICIOUS_KM,
                 I.FLAG_NOTIF_MISS]


def test_rogue_uses_unrounded_values(spark):
    rows = [dict(driver_name="a", partner_cancellation=1, distance_travelled_while_idle_in_kms=5.001),
            dict(driver_name="b", partner_cancellation=1, distance_travelled_while_idle_in_kms=5.0),
            dict(driver_name="c", partner_cancellation=0, distance_travelled_while_idle_in_kms=50)]
    out = I.rogue_detection(frame(spark, rows)).collect()
    assert [(r["driver_name"], r["idle_km"], r["partner_cancels"]) for r in out] == [("a", 5.0, 1)]
    assert out[0]["status"] == I.ROGUE_STATUS


def test_score_floor_and_status_from_unrounded(spark):
    rows = [dict(driver_name="f", total_login_time_in_hrs=10, time_spent_idle_in_hrs=13,
                 pct_notifs_missed_overall=120)]
    s = I.integrity_scores(act(spark, rows), P).first()
    # idle 130% and missed 120% floor at 0: 100*.3 + 0 + 0 + 100*.15 + 50*.2
    assert s["score"] == 55.0 and s["status"] == I.STATUS_REVIEW


def test_score_39_96_is_intervention_but_displays_40(spark):
    # cancel 50% -> 0, idle 100% -> 0, missed 0.27% -> 99.73 * .15, km 0/order -> 15, earnings 0 -> 10
    rows = [dict(driver_name="g", allocated_orders=10, partner_cancellation=5, total_login_time_in_hrs=1,
                 time_spent_idle_in_hrs=1, pct_notifs_missed_overall=0.27)]
    s = I.integrity_scores(act(spark, rows), P).first()
    final = 0 * 0.30 + 0 * 0.20 + (100 - 0.27) * 0.15 + 100 * 0.15 + 50 * 0.20
    assert final < 40 and round(final, 1) == 40.0
    assert s["score"] == 40.0 and s["status"] == I.STATUS_INTERVENTION and s["score_class"] == "warning"


def test_rankings_window_and_ties(spark):
    rows = [dict(driver_name=n, completed_orders=c, total_login_time_in_hrs=w)
            for n, c, w in (("a", 10, 5), ("b", 10, 5), ("c", 1, 5), ("d", 50, 1), ("e", 5, 5))]
    out = I.rankings(act(spark, rows), Params(ranking_n=2)).collect()
    top = [r["driver_name"] for r in sorted(out, key=lambda r: r["rank"]) if r["rank_type"] == "top_5"]
    bot = [r["driver_name"] for r in sorted(out, key=lambda r: r["rank"]) if r["rank_type"] == "bottom_5"]
    assert top == ["a", "b"]        # tie on key, broken by name; d excluded (window not > 1)
    assert bot == ["c", "e"]


def test_exec_summary_counts_flagged(spark):
    rows = [dict(driver_name="x", allocated_orders=10, partner_cancellation=5), dict(driver_name="y")]
    s = I.integrity_exec_summary(act(spark, rows), P).first()
    assert (s["total_drivers"], s["avg_cancel_pct"], s["risk_count"]) == (2, 25.0, 1)


def test_fleet_average_for_rows_without_date(spark):
    rows = [dict(driver_name="p", completed_orders=10, total_distance_in_kms=10, trip_fare=10000, Date=None),
            dict(driver_name="q", completed_orders=10, total_distance_in_kms=40, trip_fare=10000, Date=None)]
    # the NULL-Date rows form their own snapshot: average 2.5, q at 4.0 > 3.75 is flagged
    assert flags_by_name(spark, rows, ("Date",)) == {"q": [I.FLAG_SUSPICIOUS_KM]}


def test_exact_median_null_group(spark):
    from shiftlake.operators.stats import exact_median
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, value double")
    out = exact_median(df, ["g"], extra=[F.max("_x").alias("mx")]).collect()
    assert {r["g"]: (r["median"], r["mx"]) for r in out} == {None: (2.0, 3.0), "a": (5.0, 5.0)}
