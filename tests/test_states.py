"""Daily states, merged distinct counts, places, exact median and rounding cost."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from shiftlake.functions.expr import rnd
from shiftlake.operators import cleaning, distinct, regions, shifts, stats
from shiftlake.operators.common import ranked
from shiftlake.params import Params
from shiftlake.plans import states
from shiftlake.plans.catalog import P, QUERIES, _dd
from shiftlake.plans.daily import run_daily
from shiftlake.sources import files, tables

DAY = dt.date(2024, 1, 1)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    assert sorted(map(repr, a.select(sorted(a.columns)).collect())) == sorted(map(repr, b.select(sorted(a.columns)).collect()))


def test_any_span_of_days_adds_up_from_states(spark, tmp_shared):
    d = _dd(spark, SF_SMALL)
    states.daily_states(d, P).write.partitionBy("Date").parquet(tmp_shared)
    for first, last in ((1, 31), (5, 9), (7, 7)):
        span = F.col("Date").between(F.lit(dt.date(2024, 1, first)), F.lit(dt.date(2024, 1, last)))
        some, rows = spark.read.parquet(tmp_shared).where(span), d.where(span)
        same(states.shift_durations(some), shifts.shift_durations(rows, P))
        same(states.location_breakdown(some), regions.location_breakdown(rows, P))
        same(states.login_hour_stats(some), shifts.login_hour_stats(rows, P))
        same(states.hours_correlations(some), shifts.hours_correlations(rows, P))
        assert "events" not in plan(states.shift_durations(some))


def test_states_of_no_rows_and_of_constant_columns(spark):
    d = _dd(spark, SF_SMALL)
    none = states.daily_states(d.limit(0), P)
    same(states.shift_durations(none), shifts.shift_durations(d.limit(0), P))
    same(states.hours_correlations(none), shifts.hours_correlations(d.limit(0), P))
    flat = d.withColumn("online_hours", F.lit(8.1))
    assert tuple(states.hours_correlations(states.daily_states(flat, P)).first()) == (0.0, 0.0, 0.0)


def test_daily_run_with_states_gives_the_same_monthly_section(spark, tmp_shared):
    raw = tables.driver_day(spark, SF_SMALL)
    params = P.with_(monthly_days=3)
    for k in (1, 2, 3, 4):
        files.land_csv(raw.where(F.col("Date") == dt.date(2024, 1, k)), f"{tmp_shared}/in/{k}", files=1)
        out = run_daily(spark, files.list_files(spark, f"{tmp_shared}/in/{k}"), tmp_shared + "/m", params, states_path=tmp_shared + "/s")
    rows = cleaning.prepare(raw.where(F.col("Date").between(F.lit(dt.date(2024, 1, 2)), F.lit(dt.date(2024, 1, 4)))), P)
    same(out["location_breakdown"], regions.location_breakdown(rows, P))
    same(out["shift_durations"], shifts.shift_durations(rows, P))
    assert out["report_cash_regions"].count() == rows.select("driver_geo_region").distinct().count()


def test_bitmaps_merge_to_exact_counts(spark):
    rnd_ = random.Random(3)
    rows = [(DAY + dt.timedelta(days=rnd_.choice([0, 1, 2, 9, 10])), rnd_.choice([None, *map(str, range(400))])) for _ in range(3000)]
    rows += [(None, "x"), (DAY + dt.timedelta(days=40), None)]
    df = spark.createDataFrame(rows, "Date date, v string")
    ids = distinct.dense_ids(df, "v")
    assert sorted(r.id for r in ids.collect()) == list(range(1, ids.count() + 1))
    got = {r.Date: (r.unique_1d, r.unique_7d) for r in distinct.unique_in_windows(distinct.daily_bitmaps(df, "v", ids)).collect()}
    days = {d for d, v in rows if d and v}
    assert got == {d: tuple(len({v for e, v in rows if e and v and 0 <= (d - e).days < w}) for w in (1, 7)) for d in days}


def test_places_with_two_hundred_thousand_ties(spark):
    df = spark.range(200_000).select((F.when(F.col("id") % 10 < 9, 50.0).otherwise(F.rand(3) * 100)).alias("score"), F.col("id").alias("name"))
    out = ranked(df.repartition(6), [F.col("score"), F.col("name")])
    assert "Window" not in plan(out.select("score")).split("Join")[0]
    rows = out.collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, 200_001))
    assert [(r.score, r.name) for r in sorted(rows, key=lambda r: r["rank"])] == sorted((r.score, r.name) for r in rows)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 60_000
    assert ranked(df.limit(0), [F.col("score")]).count() == 0


def test_region_comparison_reads_the_fact_once(spark):
    for name, table in (("dod_region", "events"), ("supplier_dod_region", "lineitem")):
        p = plan(QUERIES[name](spark, SF_SMALL))
        assert p.split("== Initial Plan ==")[-1].count(f"{table}.parquet") == 1


def test_a_bad_bracket_still_gives_the_exact_median(spark, monkeypatch):
    values = [float(x) for x in random.Random(1).sample(range(10_000), 3001)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0), ("b", 2.0), ("c", None)], "g string, value double")
    want = {"a": sorted(values)[1500], "b": 1.5}
    for margin in (stats.MARGIN, -0.4, -0.1, 0.6):
        monkeypatch.setattr(stats, "MARGIN", margin)
        assert {r.g: r["median"] for r in stats.exact_median(df, ["g"]).collect()} == want


def test_rounding_is_exact_and_compiles_small(spark):
    r = random.Random(2)
    xs = [r.randint(-10 ** 6, 10 ** 6) / 1000 + r.choice([0, 0.005]) for _ in range(4000)]
    xs += [(r.randint(0, 10 ** 9) + 0.5) / 100 for _ in range(4000)] + [r.uniform(-1, 1) * 10.0 ** r.randint(-12, 20) for _ in range(4000)]
    xs += [k / 1000 for k in range(-50, 50)] + [0.0, -0.0, -0.001, 1e300, -1e308, 2.675, 0.125, 5e-324]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for n in (0, 1, 2, 3, 6):
        got = [q[0] for q in df.select(rnd("x", n)).collect()]
        assert got == [round(x, n) for x in xs]
    ten = spark.range(1).select(*[(F.rand(i) * 100).alias(f"a{i}") for i in range(10)]).select(*[rnd(f"a{i}", 2).alias(f"r{i}") for i in range(10)])
    debug = spark._jvm.org.apache.spark.sql.execution.debug.package
    sizes = [x._3().maxMethodCodeSize() for x in [debug.codegenStringSeq(ten._jdf.queryExecution().executedPlan()).apply(0)]]
    assert max(sizes) < 8000


def _date_file(path, fmt, days):
    import os
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("Date,driver_name\n" + "".join(f"{d.strftime(fmt)},{d}\n" for d in days))
    return path


@pytest.mark.parametrize("fmt,layout", [("%d/%m/%Y", "dd/MM/yyyy"), ("%m/%d/%Y", "MM/dd/yyyy"), ("%d.%m.%Y", "dd.MM.yyyy"), ("%m-%d-%Y", "MM-dd-yyyy")])
def test_dates_follow_their_files_layout(spark, tmp_shared, fmt, layout):
    days = [DAY + dt.timedelta(days=9 * k) for k in range(8)]
    paths = [_date_file(f"{tmp_shared}/in/x.csv", fmt, days), _date_file(f"{tmp_shared}/in/iso.csv", "%Y-%m-%d", days)]
    landed = files.read_landed(spark, paths)
    got = {r._path.rsplit("/")[-1]: (r.layout, r.votes, r.cells, r.ambiguous) for r in cleaning.date_layouts(landed).collect()}
    assert got == {"x.csv": (layout, 8, 8, False), "iso.csv": ("yyyy-MM-dd", 8, 8, False)}
    rows = cleaning.prepare(landed, Params()).collect()
    assert len(rows) == 16 and all(str(r.Date) == r.driver_name for r in rows)


def test_ambiguous_files_are_reported(spark, tmp_shared):
    path = _date_file(f"{tmp_shared}/in/x.csv", "%d/%m/%Y", [dt.date(2024, 3, 4), dt.date(2024, 5, 6)])
    (row,) = cleaning.date_layouts(files.read_landed(spark, [path])).collect()
    assert (row.layout, row.ambiguous) == ("dd/MM/yyyy", True)
