"""The daily run end to end: two landed days, upsert, comparison, report datasets."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import SF_SMALL
from shiftlake.params import Params
from shiftlake.plans.daily import run_daily
from shiftlake.sources import files, tables


def test_two_daily_runs(spark, tmp_shared):
    p = Params(exclude_vehicle_type="MACHINERY")
    raw = tables.driver_day(spark, SF_SMALL)
    d1, d2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    files.land_csv(raw.where(F.col("Date") == d1), tmp_shared + "/in/d1", files=1)
    files.land_csv(raw.where(F.col("Date") == d2), tmp_shared + "/in/d2", files=1)
    m = tmp_shared + "/master"

    first = run_daily(spark, files.list_files(spark, tmp_shared + "/in/d1"), m, p)
    assert "dod_overall" not in first                      # no history yet: section absent
    second = run_daily(spark, files.list_files(spark, tmp_shared + "/in/d2"), m, p,
                       out_dir=tmp_shared + "/out", archive_root=tmp_shared + "/archive")
    ov = second["dod_overall"].first()
    want_cur = raw.where((F.col("Date") == d2) & (F.col("vehicle_type") != "MACHINERY")).count()
    want_prev = raw.where((F.col("Date") == d1) & (F.col("vehicle_type") != "MACHINERY")).count()
    assert (ov["drivers_current"], ov["drivers_previous"]) == (want_cur, want_prev)
    assert {r["Date"] for r in second["insights"].collect()} == {d2}
    assert spark.read.parquet(tmp_shared + "/master").count() == want_cur + want_prev
    assert spark.read.parquet(tmp_shared + "/out/location_performance").count() > 0
    arch = spark.read.parquet(tmp_shared + "/archive")
    assert arch.select("snapshot_date").distinct().count() == 1


def test_cli_daily_run_and_format_dispatch(spark, tmp_shared):
    from shiftlake.__main__ import main
    raw = tables.driver_day(spark, SF_SMALL).where(F.col("Date") == dt.date(2024, 1, 3))
    raw.coalesce(1).write.parquet(tmp_shared + "/in/p")
    paths = [p for p in files.list_files(spark, tmp_shared + "/in/p", "*.parquet")]
    code = main(["daily", "--input", *paths, "--master", tmp_shared + "/m", "--out", tmp_shared + "/o",
                 "--exclude-vehicle-type", "MACHINERY"])
    assert code == 0
    want = raw.where(F.col("vehicle_type") != "MACHINERY").count()
    assert spark.read.parquet(tmp_shared + "/m").count() == want
    assert spark.read.parquet(tmp_shared + "/o/driver_overview").first()["total_drivers"] == want


def test_previous_from_files_picks_newest(spark, tmp_shared):
    import os
    import time

    from shiftlake.plans.daily import previous_from_files
    p = Params(exclude_vehicle_type="MACHINERY")
    hist = tmp_shared.replace("file:", "") + "/hist"
    os.makedirs(hist)
    assert previous_from_files(spark, hist, p) is None
    raw = tables.driver_day(spark, SF_SMALL)
    for i, d in enumerate((dt.date(2024, 1, 1), dt.date(2024, 1, 2))):
        out = tmp_shared + f"/tmp{i}"
        files.land_csv(raw.where(F.col("Date") == d), out, files=1)
        src = files.list_files(spark, out)[0].replace("file:", "")
        os.link(src, f"{hist}/day{i}.csv")
        os.utime(f"{hist}/day{i}.csv", (time.time() - 100 + 50 * i,) * 2)
    prev = previous_from_files(spark, hist, p)
    assert {r["Date"] for r in prev.select("Date").distinct().collect()} == {dt.date(2024, 1, 2)}


def test_cli_fails_cleanly_without_readable_input(spark, tmp_shared):
    from shiftlake.__main__ import main
    assert main(["daily", "--input", tmp_shared + "/nothing.csv", "--master", tmp_shared + "/m"]) == 1


def _landed(folder, name, text):
    import os
    path = folder.replace("file:", "") + "/" + name
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return path


HEAD = "Date,driver_name,driver_mobile,vehicle_number,No. of trips,total_orders"


def test_daily_run_reports_every_row_of_the_file(spark, tmp_shared):
    p, m = Params(), tmp_shared + "/m"
    run_daily(spark, [_landed(tmp_shared, "in/0.csv", f"{HEAD}\n2023-12-31,z,m,v,1,4\n")], m, p)
    text = f'{HEAD}\n2024-01-02,a,m,v,1,5\n2024-01-01,b,m,v,1,6\nsoon,c,m,v,1,7\n2024-01-02,"d\ne",m,v,1,8\n2099-01-01,f,m,v,1,9\n'
    out = run_daily(spark, [_landed(tmp_shared, "in/1.csv", text)], m, p, out_dir=tmp_shared + "/out")
    assert out["driver_overview"].first()["total_drivers"] == 5
    info = spark.read.parquet(tmp_shared + "/out/run_info").first()
    assert tuple(info) == (dt.date(2024, 1, 2), dt.date(2023, 12, 31), 5, 3, 1)
    over = out["dod_overall"].first()
    assert (over["drivers_current"], over["drivers_previous"], over["orders_current"]) == (5, 1, 35)
    assert {r["driver_name"] for r in out["activity_summary"].collect()} == {"a", "b", "c", "d\ne", "f"}


def test_daily_run_without_a_date_column(spark, tmp_shared):
    path = _landed(tmp_shared, "in/1.csv", "driver_name,driver_mobile,total_orders\na,m,5\nb,m,6\n")
    out = run_daily(spark, [path], tmp_shared + "/m", Params(), out_dir=tmp_shared + "/out", archive_root=tmp_shared + "/arch")
    assert out["driver_overview"].first()["total_drivers"] == 2 and "dod_overall" not in out
    assert out["run_info"].first()["snapshot_date"] is None
    run_daily(spark, [path], tmp_shared + "/m", Params())
    assert spark.read.parquet(tmp_shared + "/m").count() == 2


def test_cli_backfill_stream_and_archive(spark, tmp_shared):
    from shiftlake.__main__ import main
    from shiftlake.operators import master
    _landed(tmp_shared, "in/1.csv", f"{HEAD}\n2024-01-02,a,m,v,1,5\n")
    _landed(tmp_shared, "in/2.csv", "driver_name,Date,total_orders\nb,2024-01-03,6\n")
    folder = tmp_shared + "/in"
    assert main(["backfill", "--input", folder, "--master", tmp_shared + "/m1"]) == 0
    assert main(["stream", "--landing", folder, "--master", tmp_shared + "/m2", "--checkpoint", tmp_shared + "/c"]) == 0
    for m in ("/m1", "/m2"):
        assert sorted((r.driver_name, r.total_orders) for r in master.read_master(spark, tmp_shared + m).collect()) == [("a", 5.0), ("b", 6.0)]
    assert main(["archive", "--input", *files.list_files(spark, folder), "--archive", tmp_shared + "/arch"]) == 0
    assert {r.snapshot_date for r in spark.read.parquet(tmp_shared + "/arch").collect()} == {20240102, 20240103}
    assert main(["backfill", "--input", tmp_shared + "/none", "--master", tmp_shared + "/m3"]) == 1
