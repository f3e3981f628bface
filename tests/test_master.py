"""Master dataset: keep-last, upsert idempotence / order independence, backfill, stream."""

import datetime as dt
import os
import time

from pyspark.sql import functions as F

from shiftlake.operators import master
from shiftlake.params import Params
from shiftlake.sources import files
from shiftlake.streaming.file_stream import run_available_now

D1, D2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
SCHEMA = "Date date, driver_name string, driver_mobile string, vehicle_number string, cash_collected double"


def rows_of(df):
    return sorted((str(r["Date"]), r["driver_name"], r["driver_mobile"], r["cash_collected"]) for r in df.collect())


def test_keep_last_with_null_key_parts(spark):
    df = spark.createDataFrame([(D1, "a", None, "v", 1.0, 0, 0), (D1, "a", None, "v", 2.0, 1, 0),
                                (D1, "b", "m", "v", 3.0, 0, 5), (D1, "b", "m", "v", 4.0, 0, 1)],
                               SCHEMA + ", _batch long, _seq long")
    out = master.keep_last(df, master.dedup_keys(df), ["_batch", "_seq"])
    assert rows_of(out) == [("2024-01-01", "a", None, 2.0), ("2024-01-01", "b", "m", 3.0)]


def test_keep_last_without_keys_is_distinct(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (2.0,)], "cash_collected double")
    assert sorted(r[0] for r in master.keep_last(df, [], []).collect()) == [1.0, 2.0]


def test_upsert_keep_last_idempotent_and_partition_scoped(spark, tmp_shared):
    b1 = spark.createDataFrame([(D1, "a", "1", "v", 1.0), (D2, "b", "2", "v", 5.0)], SCHEMA)
    b2 = spark.createDataFrame([(D2, "b", "2", "v", 6.0), (D2, "c", "3", "v", 7.0)], SCHEMA)
    assert master.upsert(tmp_shared, b1, 1)
    assert master.upsert(tmp_shared, b2, 2)
    once = rows_of(spark.read.parquet(tmp_shared))
    assert master.upsert(tmp_shared, b2, 2)          # replay
    assert rows_of(spark.read.parquet(tmp_shared)) == once == [
        ("2024-01-01", "a", "1", 1.0), ("2024-01-02", "b", "2", 6.0), ("2024-01-02", "c", "3", 7.0)]
    assert not master.upsert(tmp_shared, b2.limit(0), 3)   # empty batch: no-op
    assert rows_of(spark.read.parquet(tmp_shared)) == once


def test_upsert_order_independent_for_disjoint_keys(spark, tmp_shared):
    a = spark.createDataFrame([(D1, "a", "1", "v", 1.0)], SCHEMA)
    b = spark.createDataFrame([(D1, "b", "2", "v", 2.0)], SCHEMA)
    p1, p2 = tmp_shared + "/x", tmp_shared + "/y"
    master.upsert(p1, a, 1), master.upsert(p1, b, 2)
    master.upsert(p2, b, 1), master.upsert(p2, a, 2)
    assert rows_of(spark.read.parquet(p1)) == rows_of(spark.read.parquet(p2))


def test_upsert_null_date_partition_is_merged_not_lost(spark, tmp_shared):
    b1 = spark.createDataFrame([(None, "a", "1", "v", 1.0), (D1, "b", "2", "v", 2.0)], SCHEMA)
    b2 = spark.createDataFrame([(None, "c", "3", "v", 3.0)], SCHEMA)
    master.upsert(tmp_shared, b1, 1)
    master.upsert(tmp_shared, b2, 2)
    got = rows_of(spark.read.parquet(tmp_shared))
    assert [r[1] for r in got] == ["b", "a", "c"] or sorted(r[1] for r in got) == ["a", "b", "c"]


def test_small_date_written_as_few_files(spark, tmp_shared):
    rows = [(D1, f"n{i}", str(i), "v", float(i)) for i in range(200)]
    master.upsert(tmp_shared, spark.createDataFrame(rows, SCHEMA).repartition(16), 1)
    part = os.path.join(tmp_shared.replace("file:", ""), "Date=2024-01-01")
    assert 1 <= len([f for f in os.listdir(part) if f.endswith(".parquet")]) <= 3


def test_backfill_groups_headers_and_later_file_wins(spark, tmp_shared):
    a = spark.createDataFrame([(D1, "a", "1", "v", 1.0), (D2, "b", "2", "v", 2.0)], SCHEMA)
    b = spark.createDataFrame([(D2, "b", "2", "v", 9.0, "late")], SCHEMA + ", source string")
    files.land_csv(a, tmp_shared + "/in/a", files=1)
    files.land_csv(b.select(*reversed(b.columns)), tmp_shared + "/in/b", files=1)
    paths = files.list_files(spark, tmp_shared + "/in/a") + files.list_files(spark, tmp_shared + "/in/b")
    assert len({files.read_header(spark, p) for p in paths}) == 2
    from shiftlake.operators.cleaning import prepare
    typed = prepare(files.read_csv_groups(spark, paths), Params(exclude_vehicle_type=None))
    out = master.build_master([typed.withColumn("_batch", F.lit(0).cast("bigint"))
                               .withColumn("_seq", F.monotonically_increasing_id())], tmp_shared + "/m")
    got = {r["driver_name"]: (r["cash_collected"], r["source"]) for r in out.collect()}
    assert got == {"a": (1.0, None), "b": (9.0, "late")}


def test_available_now_stream_equals_batch_and_replay_is_noop(spark, tmp_shared):
    cols = ["Date", "driver_name", "driver_mobile", "vehicle_number", "cash_collected"]
    b1 = spark.createDataFrame([(D1, "a", "1", "v", 1.0), (D2, "b", "2", "v", 2.0)], SCHEMA)
    b2 = spark.createDataFrame([(D2, "b", "2", "v", 3.0)], SCHEMA)
    land, out, ck = tmp_shared + "/land", tmp_shared + "/master", tmp_shared + "/ck"
    p = Params(exclude_vehicle_type=None)
    files.land_csv(b1, land + "/1", files=1)
    run_available_now(spark, land, out, ck, p, cols)
    files.land_csv(b2, land + "/2", files=1)
    run_available_now(spark, land, out, ck, p, cols)
    first = rows_of(spark.read.parquet(out))
    run_available_now(spark, land, out, ck, p, cols)
    assert rows_of(spark.read.parquet(out)) == first == [("2024-01-01", "a", "1", 1.0), ("2024-01-02", "b", "2", 3.0)]


def test_archive_rerun_replaces_partition(spark, tmp_shared):
    raw = spark.createDataFrame([(D1, "a", "1", "v", 1.0)], SCHEMA)
    master.archive_snapshot(raw, tmp_shared, "20240105")
    master.archive_snapshot(raw, tmp_shared, "20240105")
    assert spark.read.parquet(tmp_shared).count() == 1


def test_load_audit_one_row_per_file(spark, tmp_shared):
    raw = spark.createDataFrame([(D1, "a", "1", "v", 1.0), (D2, "b", "2", "v", 2.0)], SCHEMA)
    files.land_csv(raw.repartition(2), tmp_shared, files=None)
    audit = files.load_audit(spark, tmp_shared).collect()
    assert sum(r["total_rows"] for r in audit) == 2 and all(r["total_columns"] == 5 for r in audit)


def test_stream_late_file_rewrites_only_its_date(spark, tmp_shared):
    cols = ["Date", "driver_name", "driver_mobile", "vehicle_number", "cash_collected"]
    p = Params(exclude_vehicle_type=None)
    land, out, ck = tmp_shared + "/land", tmp_shared + "/master", tmp_shared + "/ck"
    days = [dt.date(2024, 1, d) for d in (1, 2, 3)]
    for i, d in enumerate(days):
        files.land_csv(spark.createDataFrame([(d, "a", "1", "v", float(i))], SCHEMA), f"{land}/{i}", files=1)
    run_available_now(spark, land, out, ck, p, cols, max_files_per_trigger=1)
    base = out.replace("file:", "")

    def snapshot(day):
        part = os.path.join(base, f"Date={day}")
        return {f: os.path.getmtime(os.path.join(part, f)) for f in os.listdir(part) if f.endswith(".parquet")}

    before = {d: snapshot(d) for d in days}
    time.sleep(1.1)
    files.land_csv(spark.createDataFrame([(days[0], "a", "1", "v", 99.0)], SCHEMA), f"{land}/late", files=1)
    run_available_now(spark, land, out, ck, p, cols, max_files_per_trigger=1)
    assert snapshot(days[1]) == before[days[1]] and snapshot(days[2]) == before[days[2]]
    assert snapshot(days[0]) != before[days[0]]
    assert rows_of(spark.read.parquet(out)) == [
        ("2024-01-01", "a", "1", 99.0), ("2024-01-02", "a", "1", 1.0), ("2024-01-03", "a", "1", 2.0)]


def test_newest_file_wins_inside_one_batch(spark, tmp_shared):
    """Two files in one daily batch hold the same key: the later-modified file wins,
    whatever order Spark packs the file splits in."""
    from shiftlake.operators.cleaning import prepare
    big = spark.createDataFrame([(D1, "a", "1", "v", 1.0)] + [(D1, f"x{i}", str(i), "v", 0.0) for i in range(2, 300)],
                                SCHEMA)
    small = spark.createDataFrame([(D1, "a", "1", "v", 2.0)], SCHEMA)
    files.land_csv(small, tmp_shared + "/in/s", files=1)
    time.sleep(1.1)
    files.land_csv(big, tmp_shared + "/in/b", files=1)      # newer (and larger) file
    paths = files.list_files(spark, tmp_shared + "/in/s") + files.list_files(spark, tmp_shared + "/in/b")
    batch = prepare(files.read_landed(spark, paths), Params(exclude_vehicle_type=None))
    master.upsert(tmp_shared + "/m", batch, 1)
    got = spark.read.parquet(tmp_shared + "/m")
    assert "_mtime" not in got.columns
    assert got.where("driver_name = 'a'").first()["cash_collected"] == 1.0


def test_backfill_skips_unreadable_files(spark, tmp_shared):
    a = spark.createDataFrame([(D1, "a", "1", "v", 1.0)], SCHEMA)
    files.land_csv(a, tmp_shared + "/in/a", files=1)
    paths = files.list_files(spark, tmp_shared + "/in/a") + [tmp_shared + "/in/missing.csv"]
    got = files.read_csv_groups(spark, paths)
    assert got.count() == 1
    assert files.read_csv_groups(spark, [tmp_shared + "/in/missing.csv"]) is None
