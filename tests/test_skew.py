"""Hot groups: one Date and one dedup key each holding a third of all rows.

Results are checked against a pandas brute force; plans must combine the
hot group before the shuffle (partial aggregate / partial top-k limit).
"""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shiftlake.operators import drivers, master
from shiftlake.operators.stats import exact_median
from shiftlake.params import Params

N = 30_000
HOT = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(5)
    days = [HOT] * (N // 3) + [dt.date(2024, 1, 2 + int(i)) for i in rng.integers(0, 29, N - N // 3)]
    pdf = pd.DataFrame({
        "Date": days,
        "driver_name": [f"d{i % 997:04d}" for i in range(N)],
        "driver_mobile": [f"m{i:06d}" for i in range(N)],
        "vehicle_number": "V",
        "total_orders": rng.integers(0, 40, N).astype(float),
        "cash_collected": np.round(rng.exponential(300.0, N), 2),
    })
    return pdf, spark.createDataFrame(pdf).repartition(16)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_per_day_top_k_with_hot_day(spark, skewed):
    pdf, df = skewed
    out = drivers.top_performers(df, Params(top_n=10), ("Date",))
    got = sorted((r["Date"], r["rank"], r["driver_mobile"]) for r in out.collect())
    want = []
    for d, g in pdf.groupby("Date"):
        g = g.sort_values(["total_orders", "driver_name", "driver_mobile"], ascending=[False, True, True]).head(10)
        want += [(d, i + 1, m) for i, m in enumerate(g["driver_mobile"])]
    assert got == sorted(want)
    p = plan(out)
    first = p.index("WindowGroupLimit")
    second = p.index("WindowGroupLimit", first + 1)
    # final limit above the shuffle, partial limit below it: a hot day ships k rows per map task
    assert first < p.index("Exchange hashpartitioning(Date", first) < second


def test_exact_median_with_hot_day(spark, skewed):
    pdf, df = skewed
    got = {r["Date"]: r["median"] for r in exact_median(df.select("Date", F.col("cash_collected").alias("value")),
                                                          ["Date"], max_distinct=50).collect()}
    want = pdf.groupby("Date")["cash_collected"].median().to_dict()
    assert set(got) == set(want)
    assert all(abs(got[d] - want[d]) <= 1e-9 * max(1.0, abs(want[d])) for d in want)


def test_keep_last_with_hot_copy_group(spark, skewed):
    pdf, _ = skewed
    # a third of the rows are copies of one key; the copy with the largest order wins
    hot = pdf.iloc[: N // 3].assign(driver_name="HOT", driver_mobile="m-hot", Date=HOT)
    rest = pdf.iloc[N // 3:]
    both = pd.concat([hot, rest], ignore_index=True)
    both["_batch"] = 1
    both["_seq"] = np.arange(len(both))
    df = spark.createDataFrame(both).repartition(16)
    out = master.keep_last(df, master.dedup_keys(df), ["_batch", "_seq"])
    got = out.where(F.col("driver_mobile") == "m-hot").collect()
    assert len(got) == 1 and got[0]["cash_collected"] == hot["cash_collected"].iloc[-1]
    assert out.count() == 1 + len(rest)
    p = plan(out)
    assert "partial_max_by" in p and p.index("partial_max_by") > p.index("Exchange")  # partial below shuffle
