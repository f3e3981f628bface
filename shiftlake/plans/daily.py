"""The daily run: load, clean, upsert, compare, analyse, persist report datasets.

Mirrors the reference's orchestration as one function over Spark frames.
Nothing is collected: every result is a DataFrame, optionally written to
``out_dir/<name>`` (K4 result persistence) as Parquet.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlake.functions.schema import FILE_ORDER
from shiftlake.operators import cleaning, compare, drivers, integrity, master, regions, shifts
from shiftlake.params import Params
from shiftlake.plans import report, states
from shiftlake.sources import files


def analyse(current: DataFrame, previous: DataFrame | None, params: Params, history: DataFrame | None = None,
            by=()) -> dict[str, DataFrame]:
    """All analyses of one snapshot (``by=()``) or of every day (``by=('Date',)``).

    ``previous`` is the prior snapshot for the day-over-day section (None:
    the section is absent, as in the reference). ``history`` feeds the
    monthly section (default: the current frame).
    """
    act = integrity.activity_summary(current, params)
    hist = history if history is not None else current
    out = {
        "driver_overview": drivers.driver_overview(current, params, by),
        "summary_stats": drivers.summary_stats(current, params, by),
        "top_performers": report.top_performers_table(current, params, by),
        "bottom_performers": drivers.bottom_performers(current, params, by),
        "high_cancellation": drivers.high_cancellation(current, params, by),
        "high_idle": drivers.high_idle(current, params, by),
        "location_performance": regions.location_performance(current, params, by),
        "report_summary_cards": report.summary_cards(current, params, by),
        "report_regions": report.regions_table(current, params, by),
        "activity_summary": act,
        "report_activity": report.activity_table(act),
        "risk_flags": integrity.risk_flags(act, params, by),
        "rogue_detection": integrity.rogue_detection(current, params),
        "rankings": integrity.rankings(act, params, by),
        "integrity_scores": integrity.integrity_scores(act, params),
        "integrity_exec_summary": integrity.integrity_exec_summary(act, params, by),
        "shift_durations": shifts.shift_durations(hist, params),
        "hours_correlations": shifts.hours_correlations(hist, params),
        "location_breakdown": regions.location_breakdown(hist, params),
        "login_hour_stats": shifts.login_hour_stats(hist, params),
        "report_cash_regions": report.cash_regions_table(hist, params),
    }
    if previous is not None:
        ov = compare.dod_overall(current, previous, params)
        out["dod_overall"] = ov
        out["report_dod"] = report.dod_table(ov)
        out["dod_region"] = compare.dod_region(current, previous, params)
        out["report_region_changes"] = report.region_changes_table(out["dod_region"])
    return out


def previous_from_files(spark: SparkSession, history_dir: str, params: Params,
                        patterns=("*.csv", "*.parquet", "*.json")) -> DataFrame | None:
    """The previous snapshot as the newest file of a history folder (S4, file rule).

    Picks the file with the latest modification time (a listing, no data
    read), then loads, cleans and filters it. None when the folder holds
    no file, so the day-over-day section is skipped.
    """
    newest = None
    for pat in patterns:
        try:
            cand = files.latest_file(spark, history_dir, pat)
        except Exception:  # noqa: BLE001 - an empty or missing folder
            cand = None
        if cand is not None:
            st = files.modification_time(spark, cand)
            if newest is None or st > newest[1]:
                newest = (cand, st)
    if newest is None:
        return None
    return cleaning.prepare(files.read_landed(spark, [newest[0]]), params)


def run_daily(spark: SparkSession, input_paths, master_path: str, params: Params,
              out_dir: str | None = None, batch_id: int | None = None,
              archive_root: str | None = None, multi_line: bool | None = None,
              states_path: str | None = None) -> dict[str, DataFrame]:
    """One daily run over landed files (CSV, Parquet or JSON).

    load -> clean -> filter -> upsert into the master -> previous snapshot
    from the master -> analyses of the current snapshot, which is every row
    of the batch, whatever its Date (rows without one, and files without the
    column, included). The snapshot's date is the one that most rows have
    (on a tie the latest); the previous snapshot is the latest Date of the
    master before it that is not in the batch. ``run_info`` tells both, the
    number of rows, of Dates and of rows without a Date. The monthly section
    reads the last ``Params.monthly_days`` days of the master, the insight
    lines the two snapshots. With ``archive_root`` the raw rows are also kept
    under ``snapshot_date=<yyyyMMdd of the snapshot's date>`` (a rerun
    replaces it). With ``states_path`` the daily states of the batch's Dates
    are renewed there and the monthly section is added up from states, so it
    does not read the month's rows (see ``plans.states``; the folder must
    hold the earlier Dates, ``states.refresh`` without dates builds it).
    ``multi_line``: see ``sources.files.Landing``.
    """
    raw = files.read_landed(spark, input_paths, multi_line)
    # every analysis below reads the cleaned batch: store it once in the shared
    # checkpoint folder instead of re-parsing the landed files per analysis
    from shiftlake.session import shared_dir
    shared_dir(spark)
    current = cleaning.prepare(raw, params)
    if "Date" not in current.columns:
        current = current.withColumn("Date", F.lit(None).cast("date"))
    current = current.checkpoint(eager=True)
    days = current.groupBy("Date").count().orderBy(F.col("count").desc(), F.col("Date").desc()).collect()  # a row per calendar day
    dates = [r["Date"] for r in days if r["Date"] is not None]
    current_date = dates[0] if dates else None
    bid = batch_id if batch_id is not None else int(current_date.strftime("%Y%m%d")) if current_date else 0
    master.upsert(master_path, current, bid, params)
    table = master.read_master(spark, master_path)
    before, previous = None, None
    if current_date is None:
        results = analyse(current, None, params)
        results["insights"] = report.insights(current, params).limit(0)
    else:
        before = table.where((F.col("Date") < F.lit(current_date)) & ~F.col("Date").isin(dates)).select(F.max("Date")).first()[0]
        previous = table.where(F.col("Date") == F.lit(before)) if before else None
        oldest = current_date - datetime.timedelta(days=params.monthly_days - 1)
        month = table.where(F.col("Date").between(F.lit(oldest), F.lit(current_date)))
        results = analyse(current, previous, params, history=month)
        if states_path:
            states.refresh(spark, master_path, states_path, params, dates)
            span = spark.read.parquet(states_path).where(F.col("Date").between(F.lit(oldest), F.lit(current_date)))
            results.update(states.monthly(span))
            results["report_cash_regions"] = report.cash_regions_rows(results["location_breakdown"])
        snapshot = current.drop(*FILE_ORDER).withColumn("Date", F.lit(current_date))
        pair = master.union_by_name([snapshot, previous]) if previous is not None else snapshot
        results["insights"] = report.insights(pair, params).where(F.col("Date") == F.lit(current_date))
    results["run_info"] = spark.createDataFrame(
        [(current_date, before, sum(r["count"] for r in days), len(dates), sum(r["count"] for r in days if r["Date"] is None))],
        "snapshot_date date, previous_date date, n_rows long, n_dates int, rows_without_date long")
    if archive_root and current_date:
        master.archive_snapshot(raw, archive_root, current_date.strftime("%Y%m%d"))
    if out_dir:
        for name, df in results.items():
            df.write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/{name}")
    return results


def backfill(spark: SparkSession, paths: list[str], master_path: str, params: Params, multi_line: bool | None = None) -> bool:
    """Build the master anew from many daily files (K2): on a key the file modified last wins.

    Files that cannot be read are left out whole, with a warning. False, and
    nothing written, when none is left.
    """
    landed = files.read_csv_groups(spark, paths, multi_line=multi_line)
    if landed is None:
        return False
    typed = cleaning.prepare(landed, params)
    if "Date" not in typed.columns:
        typed = typed.withColumn("Date", F.lit(None).cast("date"))
    master.build_master([master.with_arrival_order(typed, 0)], master_path)
    return True
