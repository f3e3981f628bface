"""Scan-side cleaning: numeric coercion, trimming, dates, the exclusion filter."""

from pyspark.sql import Observation
from pyspark.sql import functions as F

from shiftlake.functions.schema import resolve_column
from shiftlake.operators import cleaning
from shiftlake.params import Params


def test_numeric_text_like_pandas_to_numeric(spark):
    texts = [" 12 ", "1,000", "5f", "N/A", "", "nan", "-3.5", "1e3", ".5", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(cleaning.numeric_text(F.col("t"))).collect()]
    assert got == [12.0, None, None, None, None, None, -3.5, 1000.0, 0.5, None]


def test_clean_types_trims_and_fills(spark):
    rows = [("2024-01-05", " Ann\t", " 12 ", "1,000", "x", "2024-01-05 07:30:00")]
    df = spark.createDataFrame(rows, "Date string, driver_name string, total_orders string, "
                                     "cash_collected string, trip_fare string, first_recorded_login_time string")
    out = cleaning.clean_driver_day(df).first()
    assert str(out["Date"]) == "2024-01-05"
    assert out["driver_name"] == "Ann"
    assert out["total_orders"] == 12.0
    assert out["cash_collected"] == 0.0      # thousands separator is not numeric -> NaN -> 0
    assert out["trip_fare"] == 0.0           # canonical numeric column, bad text -> 0
    assert out["first_recorded_login_time"].hour == 7


def test_bad_date_becomes_null_and_formats(spark):
    df = spark.createDataFrame([("31/01/2024",), ("2024/02/03",), ("not a date",)], "Date string")
    got = [str(r[0]) if r[0] else None for r in cleaning.clean_driver_day(df).collect()]
    assert got == ["2024-01-31", "2024-02-03", None]


def test_numeric_nan_and_null_filled(spark):
    df = spark.createDataFrame([(float("nan"), None, 3)], "online_hours double, idle_hours double, n int")
    r = cleaning.clean_driver_day(df).first()
    assert (r["online_hours"], r["idle_hours"], r["n"]) == (0.0, 0.0, 3)


def test_filter_vehicle_keeps_null_drops_excluded_and_padded(spark):
    df = spark.createDataFrame([("a", None), ("b", "EV"), ("c", "Car"), ("d", " EV ")], "id string, vehicle_type string")
    obs = Observation("vf")
    out = cleaning.filter_vehicle(cleaning.clean_driver_day(df), "EV", obs)
    assert sorted(r["id"] for r in out.collect()) == ["a", "c"]
    assert obs.get["rows_removed"] == 2


def test_filter_vehicle_missing_column_is_noop(spark):
    df = spark.createDataFrame([("a",)], "id string")
    assert cleaning.filter_vehicle(df, "EV").count() == 1


def test_drop_empty_rows_flag(spark):
    df = spark.createDataFrame([("a", 1.0), (None, None)], "driver_name string, online_hours double")
    assert cleaning.clean_driver_day(df).count() == 2              # reference result: no-op
    assert cleaning.clean_driver_day(df, Params(drop_empty_rows=True)).count() == 1


def test_null_as_text_option(spark):
    df = spark.createDataFrame([(None,)], "driver_geo_region string")
    assert cleaning.clean_driver_day(df, Params(null_as_text=True)).first()[0] == "nan"


def test_resolver_exact_then_substring_in_alias_order():
    cols = ["allocated_orders", "Total_Orders", "online_hours", "idle_hours"]
    assert resolve_column(cols, ["orders_completed", "total_orders", "orders"]) == "Total_Orders"
    assert resolve_column(["allocated_orders", "x"], ["orders_completed", "total_orders", "orders"]) == "allocated_orders"
    assert resolve_column(cols, ["online_hours", "duty_hours", "idle_hours", "hours"]) == "online_hours"
    assert resolve_column(["a"], ["orders"]) is None
    assert resolve_column(cols, ["orders"], "orders", {"orders": "allocated_orders"}) == "allocated_orders"


def test_cancellation_rate_zero_denominators(spark):
    df = spark.createDataFrame([(0.0, 3.0), (0.0, 0.0), (10.0, 2.0)], "total_orders double, orders_cancelled double")
    got = [r["cancellation_rate"] for r in cleaning.with_cancellation_rate(df, Params()).collect()]
    assert got == [0.0, 0.0, 20.0]


def test_params_from_string_config():
    p = Params.from_strings({"MIN_ORDERS_THRESHOLD": "7", "IDLE_HOURS_WARNING": "3.5"})
    assert (p.min_orders, p.idle_hours_warning, p.cancellation_rate_warning) == (7, 3.5, 15.0)
    assert Params.from_strings({}) == Params()
