"""Command line: ``python -m shiftlake daily | backfill | stream | archive ...``.

``daily`` runs one daily batch (load, clean, filter, upsert, compare,
analyse) and writes every report dataset as Parquet under ``--out``.
``backfill`` builds the master anew from all files of folders, ``stream``
takes in what has landed in a folder since the last time, ``archive`` keeps
raw rows by date. Thresholds take the same defaults as the library (5 orders,
4 idle hours, 15 % cancels).
"""

from __future__ import annotations

import argparse
import sys

from shiftlake.params import Params


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="shiftlake")
    sub = ap.add_subparsers(dest="cmd", required=True)
    d = sub.add_parser("daily", help="process one landed batch of daily files")
    d.add_argument("--input", nargs="+", required=True, help="landed files (csv / parquet / json)")
    d.add_argument("--master", required=True, help="Date-partitioned master dataset folder")
    d.add_argument("--out", help="folder for the report datasets")
    d.add_argument("--archive", help="folder that keeps the raw rows by snapshot date")
    d.add_argument("--states", help="folder of the daily states that the monthly section is added up from")
    d.add_argument("--min-orders", type=int, default=Params().min_orders)
    d.add_argument("--idle-hours-warning", type=float, default=Params().idle_hours_warning)
    d.add_argument("--cancellation-rate-warning", type=float, default=Params().cancellation_rate_warning)
    f = sub.add_parser("backfill", help="build the master anew from landed files")
    f.add_argument("--input", nargs="+", required=True, help="folders of landed csv files")
    f.add_argument("--pattern", default="*.csv")
    f.add_argument("--master", required=True)
    t = sub.add_parser("stream", help="upsert the files that landed since the last run")
    t.add_argument("--landing", required=True)
    t.add_argument("--master", required=True)
    t.add_argument("--checkpoint", required=True)
    t.add_argument("--max-files-per-trigger", type=int, default=None)
    r = sub.add_parser("archive", help="keep landed rows by their Date")
    r.add_argument("--input", nargs="+", required=True)
    r.add_argument("--archive", required=True)
    for x in (d, f, t, r):
        x.add_argument("--exclude-vehicle-type", default=Params().exclude_vehicle_type)
        x.add_argument("--multi-line", choices=("auto", "yes", "no"), default="auto", help="quoted line breaks in csv files")
        x.add_argument("--master-url", default=None, help="Spark master; default: the session's own")
    a = ap.parse_args(argv)

    from pyspark.sql import SparkSession

    from shiftlake.operators import cleaning, master
    from shiftlake.plans.daily import backfill, run_daily
    from shiftlake.session import SESSION_DEFAULTS, shared_dir
    from shiftlake.sources import files
    from shiftlake.streaming.file_stream import run_available_now

    b = SparkSession.builder.appName(f"shiftlake-{a.cmd}")
    if a.master_url:
        b = b.master(a.master_url)
    for k, v in SESSION_DEFAULTS.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    shared_dir(spark)
    params = Params(exclude_vehicle_type=a.exclude_vehicle_type or None)
    breaks = {"auto": None, "yes": True, "no": False}[a.multi_line]
    try:
        if a.cmd == "daily":
            params = params.with_(min_orders=a.min_orders, idle_hours_warning=a.idle_hours_warning,
                                  cancellation_rate_warning=a.cancellation_rate_warning)
            run_daily(spark, a.input, a.master, params, out_dir=a.out, archive_root=a.archive, multi_line=breaks,
                      states_path=a.states)
        elif a.cmd == "backfill":
            found = [p for folder in a.input for p in files.list_files(spark, folder, a.pattern)]
            if not backfill(spark, found, a.master, params, breaks):
                raise FileNotFoundError(f"no readable file of {len(found)}")
        elif a.cmd == "stream":
            run_available_now(spark, a.landing, a.master, a.checkpoint, params,
                              max_files_per_trigger=a.max_files_per_trigger, multi_line=breaks)
        else:
            raw = files.read_landed(spark, a.input, breaks)
            master.archive_snapshot(cleaning.clean_driver_day(raw, params), a.archive)
    except Exception as e:  # noqa: BLE001 - the exit code reports the failure
        print(f"{a.cmd} run failed: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
