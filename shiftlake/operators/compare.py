"""Day-over-day comparison and previous-snapshot lookup.

Totals are aggregated *before* any join, so every join here is between
frames of one row per (date[, region]).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftlake.functions.expr import exact_sum, rnd, trunc_int
from shiftlake.operators.common import quoted, roles, with_total_orders
from shiftlake.params import Params

REGION = "driver_geo_region"


def previous_snapshot(df: DataFrame, current_date=None) -> DataFrame:
    """Rows of the latest Date before ``current_date`` (default: the latest Date).

    Empty (same schema) when there is no earlier date. The previous date is
    one scalar from one pass (the two largest distinct dates, a top-2 over
    one row per date); the row filter on it prunes partitions of a
    Date-partitioned table.
    """
    dated = df.where(F.col("Date").isNotNull())
    if current_date is not None:
        prev = dated.where(F.col("Date") < F.lit(current_date).cast("date")).select(F.max("Date")).scalar()
    else:
        top2 = dated.select("Date").distinct().orderBy(F.col("Date").desc()).limit(2)
        prev = top2.select(F.when(F.count(F.lit(1)) == 2, F.min("Date"))).scalar()
    return df.where(F.col("Date") == prev)


def _totals(df: DataFrame, params: Params, by=()) -> DataFrame:
    d = with_total_orders(df, params)
    cash = roles(d, params)["cash"]
    return d.groupBy(*by).agg(
        exact_sum("total_orders").alias("o"),
        exact_sum(F.col(quoted(cash)) if cash else F.lit(0.0)).alias("c"),
        F.count(F.lit(1)).alias("k"),
    )


def _overall(cur_prev: DataFrame, keys: list) -> DataFrame:
    c = F.col
    och, cch = c("o") - c("po"), c("c") - c("pc")
    return cur_prev.select(
        *keys,
        trunc_int("o").alias("orders_current"),
        trunc_int("po").alias("orders_previous"),
        trunc_int(och).alias("orders_change"),
        F.when(c("po") > 0, rnd(och / c("po") * F.lit(100.0), 2)).otherwise(F.lit(0.0)).alias("orders_pct_change"),
        c("c").alias("cash_current"),
        c("pc").alias("cash_previous"),
        cch.alias("cash_change"),
        F.when(c("pc") > 0, rnd(cch / c("pc") * F.lit(100.0), 2)).otherwise(F.lit(0.0)).alias("cash_pct_change"),
        c("k").alias("drivers_current"),
        c("pk").alias("drivers_previous"),
        (c("k") - c("pk")).alias("drivers_change"),
    )


def dod_overall(current: DataFrame, previous: DataFrame, params: Params) -> DataFrame:
    """Overall totals of one snapshot against another (one output row)."""
    cur = _totals(current, params)
    # the previous totals as one struct-valued scalar subquery (one pass)
    prv = _totals(previous, params).select(F.struct("o", "c", "k")).scalar()
    both = cur.select("*", prv.getField("o").alias("po"), prv.getField("c").alias("pc"),
                      prv.getField("k").alias("pk"))
    return _overall(both, [])


def dod_overall_by_day(df: DataFrame, params: Params) -> DataFrame:
    """Every date against its previous snapshot date, in one aggregation pass.

    The totals hold exactly one row per snapshot date, so ``lag`` over them
    *is* the previous snapshot date (no self-join); that window sees one
    row per calendar day, never the driver rows.
    """
    t = _totals(df.where(F.col("Date").isNotNull()), params, ("Date",))
    w = Window.orderBy("Date")
    both = t.select(
        "Date", "o", "c", "k",
        F.lag("Date").over(w).alias("prev_Date"),
        F.lag("o").over(w).alias("po"),
        F.lag("c").over(w).alias("pc"),
        F.lag("k").over(w).alias("pk"),
    ).where(F.col("prev_Date").isNotNull())
    return _overall(both, ["Date", "prev_Date"])


def _region_changes(cur: DataFrame, prv: DataFrame, keys: list) -> DataFrame:
    c = F.col
    on = [k for k in keys if k in prv.columns] + ["region"]
    return _changes(cur.join(prv, on, "left").withColumn("p", F.coalesce(c("p"), F.lit(0.0))), keys)


def _changes(j: DataFrame, keys: list) -> DataFrame:
    """Orders ``o`` against ``p`` by region, with the rank by absolute change."""
    c = F.col
    ch = c("o") - c("p")
    out = j.select(
        *[k for k in keys], "region",
        trunc_int("o").alias("current_orders"),
        trunc_int("p").alias("previous_orders"),
        trunc_int(ch).alias("change"),
        F.when(c("p") > 0, rnd(ch / c("p") * F.lit(100.0), 2)).otherwise(F.lit(0.0)).alias("pct_change"),
    )
    part = [k for k in keys if k != "prev_Date"]
    w = Window.partitionBy(*part).orderBy(F.abs(c("change")).desc(), c("region").asc_nulls_first())
    return out.withColumn("rank", F.row_number().over(w))


def _region_totals(df: DataFrame, params: Params, by=()) -> DataFrame:
    d = with_total_orders(df, params)
    return d.where(F.col(REGION).isNotNull()).groupBy(*by, F.col(REGION).alias("region")).agg(
        exact_sum("total_orders").alias("o"))


def dod_region(current: DataFrame, previous: DataFrame, params: Params) -> DataFrame:
    """Region orders of one snapshot against another; regions only in the
    previous snapshot are dropped, regions new today compare against 0."""
    if REGION not in current.columns:  # no region: the full columns, no rows
        current = current.withColumn(REGION, F.lit(None).cast("string"))
    cur = _region_totals(current, params)
    prv = _region_totals(previous, params).withColumnRenamed("o", "p") if REGION in previous.columns \
        else cur.select("region", F.lit(0.0).alias("p")).where(F.lit(False))
    return _region_changes(cur, prv, [])


def dod_region_by_day(df: DataFrame, params: Params) -> DataFrame:
    """Region changes for every date against its previous snapshot date, in one scan.

    The (Date, region) totals become one map region -> orders per date, and
    ``lag`` over the dates hands each its predecessor's map, so a region
    absent the day before compares against 0. Rows without a region keep
    their date in the calendar but no entry. The window sees one row per
    calendar day; a map holds the regions of a day.
    """
    d = with_total_orders(df.where(F.col("Date").isNotNull()), params)
    region = F.col(REGION) if REGION in d.columns else F.lit(None).cast("string")
    totals = d.groupBy("Date", region.alias("region")).agg(exact_sum("total_orders").alias("o"))
    entry = F.when(F.col("region").isNotNull(), F.struct("region", "o"))
    w = Window.orderBy("Date")
    days = totals.groupBy("Date").agg(F.map_from_entries(F.collect_list(entry)).alias("now"))
    pairs = days.select("Date", "now", F.lag("Date").over(w).alias("prev_Date"), F.lag("now").over(w).alias("before"))
    rows = pairs.where(F.col("prev_Date").isNotNull()).select(
        "Date", "prev_Date", "before", F.explode("now").alias("region", "o"))
    return _changes(rows.select("Date", "prev_Date", "region", "o",
                                F.coalesce(F.try_element_at("before", F.col("region")), F.lit(0.0)).alias("p")), ["Date", "prev_Date"])
