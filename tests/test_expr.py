"""Pure expressions: rounding, truncation, buckets, guarded ratios, text."""

import math

from pyspark.sql import functions as F

from shiftlake.functions import expr as X


def one(spark, col, rows, schema="x double"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_rnd_is_pythons_round(spark):
    ratios = sorted({a / b * 100.0 for b in range(1, 201) for a in range(b + 1)})
    xs = ratios + [2.675, 0.125, 1.005, 39.96, -1.235, -12.345, 33.333333, -0.001, -0.005, 1e12 + 0.125, 123456.785]
    xs += [-x for x in ratios]
    for n in (1, 2, 3):
        assert one(spark, X.rnd("x", n), [(x,) for x in xs]) == [round(x, n) for x in xs]
    assert one(spark, X.rnd("x", 2), [(None,)]) == [None]
    assert one(spark, X.rnd("x", 2), [(1 / 32 * 100,), (17 / 32 * 100,), (2.675,)]) == [3.12, 53.12, 2.67]


def test_trunc_int_matches_python_int(spark):
    xs = [2.9, -2.9, 0.0, 7.0]
    assert one(spark, X.trunc_int("x"), [(x,) for x in xs]) == [int(x) for x in xs]
    assert one(spark, X.trunc_int("x"), [(float("nan"),), (None,)]) == [0, 0]


def test_hours_bucket_edges(spark):
    rows = [(7.99,), (8.0,), (12.0,), (12.01,), (None,)]
    assert one(spark, X.hours_bucket("x"), rows) == [
        "under_8_hours", "between_8_12_hours", "between_8_12_hours", "over_12_hours", "under_8_hours"]


def test_pct_nonzero_den_inf_and_nan_to_zero(spark):
    df = spark.createDataFrame([(3.0, 0.0), (0.0, 0.0), (1.0, 4.0), (1.0, -4.0)], "c double, o double")
    assert [r[0] for r in df.select(X.pct_nonzero_den("c", "o")).collect()] == [0.0, 0.0, 25.0, -25.0]


def test_ratio_if_pos(spark):
    df = spark.createDataFrame([(3.0, 0.0), (3.0, -1.0), (3.0, 4.0)], "n double, d double")
    assert [r[0] for r in df.select(X.ratio_if_pos("n", "d", 100.0)).collect()] == [0.0, 0.0, 75.0]


def test_exact_sum_is_order_independent(spark):
    vals = [0.1] * 10 + [1e6, -1e6]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    a = df.repartition(7).agg(X.exact_sum("x")).first()[0]
    b = df.coalesce(1).agg(X.exact_sum("x")).first()[0]
    assert a == b == 1.0


def test_signed_text_and_float_text(spark):
    df = spark.createDataFrame([(12.34,), (-0.06,), (0.0,), (15.0,)], "x double")
    assert [r[0] for r in df.select(X.signed_1dp_text("x")).collect()] == ["+12.3", "-0.1", "+0.0", "+15.0"]
    assert [r[0] for r in df.select(X.py_float_text("x")).collect()] == ["12.34", "-0.06", "0.0", "15.0"]


def test_safe_corr_constant_column_is_null_not_error(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 2.0), (5.0, 3.0)], "h double, c double")
    assert df.agg(X.safe_corr("h", "c")).first()[0] is None
    df2 = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.1)], "h double, c double")
    import numpy as np
    want = float(np.corrcoef([1.0, 2.0, 3.0], [2.0, 4.0, 6.1])[0, 1])
    assert math.isclose(df2.agg(X.safe_corr("h", "c")).first()[0], want, rel_tol=1e-12)


def test_change_and_score_classes(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (-1.0,)], "x double")
    assert [r[0] for r in df.select(X.change_class("x")).collect()] == ["positive", "negative", "negative"]
    df = spark.createDataFrame([(39.9,), (40.0,), (59.9,), (60.0,)], "x double")
    assert [r[0] for r in df.select(X.score_band("x")).collect()] == ["negative", "warning", "warning", "positive"]


def test_py_float_text_matches_python_str(spark):
    xs = [30.0, 12.35, 0.0, 10000000.0, 12345678.9, -98765432.25, 123456789012.5, 9999999.99]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(X.py_float_text("x")).collect()]
    assert got == [str(x) for x in xs]
