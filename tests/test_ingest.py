"""Landed files load whole or not at all, and bind by header."""

import gzip
import os

import pytest

from shiftlake.operators import cleaning, master
from shiftlake.params import Params
from shiftlake.sources import files
from shiftlake.streaming.file_stream import run_available_now


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return path


def test_quotes_commas_and_dotted_headers(spark, tmp_shared):
    p = _write(f"{tmp_shared}/a.csv", 'name,No. of orders\n"O""Neil, ""Bo""",5\n')
    rows = files.read_landed(spark, [p]).collect()
    assert [(r["name"], r["No. of orders"]) for r in rows] == [('O"Neil, "Bo"', "5")]


def test_missing_or_damaged_input_raises(spark, tmp_shared):
    good = _write(f"{tmp_shared}/a.csv", "x,y\n1,2\n")
    with pytest.raises(Exception):
        files.read_landed(spark, [good, f"{tmp_shared}/absent.csv"]).count()
    whole = gzip.compress(("x,y\n" + "\n".join(f"{i},{i * 7919}" for i in range(20000))).encode())
    with open(f"{tmp_shared}/b.csv.gz", "wb") as f:
        f.write(whole[:len(whole) // 2])
    with pytest.raises(Exception):
        files.read_csv_groups(spark, [f"{tmp_shared}/b.csv.gz"]).count()


HEAD = "Date,driver_name,driver_mobile,vehicle_number,total_orders"


def test_upsert_keeps_columns_of_earlier_batches(spark, tmp_shared):
    p = Params()
    first = _write(f"{tmp_shared}/1.csv", f"{HEAD}\n2024-01-01,a,m1,v1,3\n")
    second = _write(f"{tmp_shared}/2.csv", f"{HEAD},depot\n2024-01-01,b,m2,v2,4,keepme\n")
    third = _write(f"{tmp_shared}/3.csv", f"{HEAD}\n2024-01-01,c,m3,v3,5\n")
    for i, path in enumerate((first, second, third)):
        master.upsert(f"{tmp_shared}/master", cleaning.prepare(files.read_landed(spark, [path]), p), i, p)
    got = {r.driver_name: r.depot for r in master.read_master(spark, f"{tmp_shared}/master").collect()}
    assert got == {"a": None, "b": "keepme", "c": None}


def test_stream_binds_by_header(spark, tmp_shared):
    _write(f"{tmp_shared}/land/1.csv", f"{HEAD}\n2024-01-01,ann,m1,v1,3\n")
    _write(f"{tmp_shared}/land/2.csv", "vehicle_number,driver_name,Date,total_orders,driver_mobile\nv2,bob,2024-01-01,4,m2\n")
    run_available_now(spark, f"{tmp_shared}/land", f"{tmp_shared}/master", f"{tmp_shared}/ckpt", Params(), columns=HEAD.split(","))
    got = {(r.driver_name, r.vehicle_number) for r in master.read_master(spark, f"{tmp_shared}/master").collect()}
    assert got == {("ann", "v1"), ("bob", "v2")}


def test_three_layouts_with_breaks_and_dots_bind_by_name(spark, tmp_shared):
    _write(f"{tmp_shared}/in/1.csv", 'Date,driver_name,No. of trips\n2024-01-01,"Lee, Ann",5\n2024-01-01,"two\nlines",6\n')
    _write(f"{tmp_shared}/in/2.csv", '﻿No. of trips, date ,driver_name,depot\n7,2024-01-02,bob,north\n8,2024-01-02,"x ""y""",\n')
    _write(f"{tmp_shared}/in/3.csv", "driver_name,Date\ncarl,2024-01-03\n")
    _write(f"{tmp_shared}/in/4.csv", "driver_name,Date\n")
    _write(f"{tmp_shared}/in/5.csv", "")
    paths = files.list_files(spark, f"{tmp_shared}/in")
    want = {("2024-01-01", "Lee, Ann", "5", None), ("2024-01-01", "two\nlines", "6", None), ("2024-01-02", "bob", "7", "north"),
            ("2024-01-02", 'x "y"', "8", None), ("2024-01-03", "carl", None, None)}
    for breaks in (None, True):
        df = files.read_landed(spark, paths, multi_line=breaks)
        assert df.columns == ["Date", "driver_name", "No. of trips", "depot", "_mtime", "_path", "_block", "_pos"]
        assert {(r["Date"], r["driver_name"], r["No. of trips"], r["depot"]) for r in df.collect()} == want
    typed = cleaning.prepare(files.read_landed(spark, paths), Params())
    assert sorted(str(r["Date"]) for r in typed.collect()) == ["2024-01-01"] * 2 + ["2024-01-02"] * 2 + ["2024-01-03"]
    split = files.read_landed(spark, paths, multi_line=False).collect()  # as they stand
    assert len(split) == 6


def test_one_csv_scan_and_no_open_on_the_driver(spark, tmp_shared, monkeypatch):
    for i in range(4):
        _write(f"{tmp_shared}/in/{i}.csv", ",".join([f"a{i}", "b", "c"][::1 if i % 2 else -1]) + "\n1,2,3\n")
    monkeypatch.setattr(files, "read_header", None)
    scans = []
    real = files.scan_lines
    monkeypatch.setattr(files, "scan_lines", lambda *a, **k: scans.append(1) or real(*a, **k))
    monkeypatch.setattr(files, "scan_records", None)
    df = files.read_csv_groups(spark, files.list_files(spark, f"{tmp_shared}/in"))
    assert df.count() == 4 and len(scans) == 1
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" not in plan and "FileScan csv" not in plan  # the staged lines are parsed, not the files again


def test_rows_of_many_splits_keep_their_order(spark, tmp_shared):
    _write(f"{tmp_shared}/in/a.csv", "k,v\n" + "\n".join(f"{i},{i * 31}" for i in range(5000)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = files.read_csv_groups(spark, [f"{tmp_shared}/in/a.csv"]).orderBy("_pos").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [int(r["k"]) for r in rows] == list(range(5000)) and len({r["_block"] for r in rows}) > 3


def test_odd_headers_get_names(spark, tmp_shared):
    assert files.header_names(["a", " A ", "", "a", ""]) == ["a", "A.1", "Unnamed: 2", "a.2"]
    p = _write(f"{tmp_shared}/w.csv", '"x\ny",b\n1,2,3\n4\n')
    rows = files.land(spark, [p]).bound(False)
    assert rows.columns == ["x\ny", "b"] and {tuple(r) for r in rows.collect()} == {("1", "2"), ("4", None)}


def test_ledger_has_every_file_and_the_one_before(spark, tmp_shared):
    texts = {"b": "x,y\n1,2\n3,4\n", "a": "z\n", "c": "", "d": "y,x,w\n1,2,\"3\n4\"\n"}
    for k, (name, text) in enumerate(texts.items()):
        path = _write(f"{tmp_shared}/in/{name}.csv", text)
        os.utime(path, (1_700_000_000 + 10 * k,) * 2)
    got = {os.path.basename(r.file_path)[0]: r for r in files.ledger(spark, f"{tmp_shared}/in").collect()}
    assert {k: (r.total_rows, r.total_columns, r["columns"]) for k, r in got.items()} == {
        "b": (2, 2, "x,y"), "a": (0, 1, "z"), "c": (0, 0, None), "d": (1, 3, "y,x,w")}
    assert {k: r.previous_path and os.path.basename(r.previous_path)[0] for k, r in got.items()} == {"b": None, "a": "b", "c": "a", "d": "c"}


def test_replays_in_any_order_give_one_table(spark, tmp_shared):
    p = Params()
    paths = []
    for i in (1, 2, 3):
        rows = "".join(f"2024-01-01,n{j},m,v,{10 * i + j}\n" for j in range(i, i + 3))
        paths.append(_write(f"{tmp_shared}/{i}.csv", f"{HEAD}\n{rows}2024-01-01,n{i},m,v,{100 + i}\n"))
    want = {f"n{j}": float(v) for j, v in {1: 101, 2: 102, 3: 103, 4: 34, 5: 35}.items()}
    for order in ((1, 2, 3), (3, 2, 1), (2, 1, 3, 1, 2), (1, 3, 1, 2)):
        out = f"{tmp_shared}/m{''.join(map(str, order))}"
        for i in order:
            master.upsert(out, cleaning.prepare(files.read_landed(spark, [paths[i - 1]]), p), i, p)
        got = master.read_master(spark, out)
        assert "_version" not in got.columns
        assert {r.driver_name: r.total_orders for r in got.collect()} == want and got.count() == 5


def test_mixed_formats_in_one_batch(spark, tmp_shared):
    old = _write(f"{tmp_shared}/1.csv", f"{HEAD}\n2024-01-01,a,m,v,1\n2024-01-01,b,m,v,2\n2024-01-01,b,m,v,3\n")
    os.utime(old, (1_600_000_000,) * 2)
    spark.sql("select date'2024-01-01' Date, 'a' driver_name, 'm' driver_mobile, 'v' vehicle_number, 9d total_orders "
              "union all select date'2024-01-01', 'c', 'm', 'v', 4d").coalesce(1).write.parquet(f"{tmp_shared}/p")
    new = files.list_files(spark, f"{tmp_shared}/p", "*.parquet")
    master.upsert(f"{tmp_shared}/m", cleaning.prepare(files.read_landed(spark, [old, *new]), Params()), 1)
    got = master.read_master(spark, f"{tmp_shared}/m").collect()
    assert sorted((r.driver_name, r.total_orders) for r in got) == [("a", 9.0), ("b", 3.0), ("c", 4.0)]


def test_merge_is_a_hash_aggregate(spark, tmp_shared):
    df = spark.sql("select date'2024-01-01' Date, 'a' driver_name, 'm' driver_mobile, 'v' vehicle_number, 9d total_orders, "
                   "named_struct('batch', 1L, 'mtime', 0L, 'pos', 5L) _version")
    plan = master.newest(df, master.dedup_keys(df))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "Window" not in plan
