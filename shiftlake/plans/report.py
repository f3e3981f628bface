"""Report datasets: the data behind each report section.

HTML/PNG rendering is not built; each section is a typed DataFrame that a
renderer (or a BI tool) can read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftlake.functions.expr import change_class, py_fixed, py_float_text, rnd, signed_1dp_text
from shiftlake.operators import drivers, regions
from shiftlake.operators.cleaning import with_cancellation_rate
from shiftlake.operators.common import metric, roles, top_k
from shiftlake.params import Params

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's report text.
# ---------------------------------------------------------------------------
CHART_NAME_CHARS = 20
REGION_TABLE_ROWS = 15
REGION_CHART_ROWS = 10
CARDS = [
    ("active_drivers", "Total Active Drivers"),
    ("drivers_over_12_hours", "Logged in 12+ Hours"),
    ("drivers_under_8_hours", "Logged in < 8 Hours"),
    ("drivers_8_to_12_hours", "Logged in 8-12 Hours"),
    ("total_regions", "Active Regions"),
]
DOD_METRICS = [
    ("total_orders", "Total Orders"),
    ("total_cash", "Total Cash"),
    ("driver_count", "Active Drivers"),
]
CURRENCY = "₹"
INSIGHT_OVER_12 = "⏰ {n} drivers logged in for 12+ hours (High Duty)"
INSIGHT_UNDER_8 = "⏳ {n} drivers logged in for < 8 hours (Part Time)"
INSIGHT_HIGH_CANCEL = "⚠️ {n} drivers have cancellation rates above {t}% - requires attention"
INSIGHT_HIGH_IDLE = "⏱️ {n} drivers have idle time exceeding {t} hours - potential efficiency issue"
INSIGHT_TOP_REGION = "🏆 Top performing region: {r} with {n} total orders"
INSIGHT_ORDERS_CHANGE = "Total orders {d} by {n} ({p}%) compared to previous day"
DIRECTION_UP = "📈 increased"
DIRECTION_DOWN = "📉 decreased"


def _fmt(template: str, **cols) -> F.Column:
    """Fill ``{name}`` slots of a fixed template with column values."""
    parts, rest = [], template
    while "{" in rest:
        pre, rest = rest.split("{", 1)
        key, rest = rest.split("}", 1)
        parts += [F.lit(pre), cols[key].cast("string")]
    parts.append(F.lit(rest))
    return F.concat(*parts)


def summary_cards(df: DataFrame, params: Params, by=()) -> DataFrame:
    """Active, >12 h, <8 h, 8-12 h, regions as (card, ord, label, value) rows (one aggregate)."""
    ov = drivers.driver_overview(df, params, by, extra=[regions.region_count_expr(df).alias("total_regions")])
    stack = "stack(%d, %s) as (card, ord, label, value)" % (len(CARDS), ", ".join(
        f"'{k}', {i + 1}, '{lab}', cast({k} as bigint)" for i, (k, lab) in enumerate(CARDS)))
    return ov.select(*by, F.expr(stack)).withColumn("ord", F.col("ord").cast("int"))


def top_performers_table(df: DataFrame, params: Params, by=()) -> DataFrame:
    """R2: ranked top-N table plus the 20-character chart label."""
    t = drivers.top_performers(df, params, by)
    return t.withColumn("chart_label", F.substring("driver_name", 1, CHART_NAME_CHARS)).withColumn(
        "cash_text", F.concat(F.lit(CURRENCY), py_fixed("cash_collected", 2)))


def regions_table(df: DataFrame, params: Params, by=()) -> DataFrame:
    """Top 15 regions by orders for the table; the first 10 feed the chart."""
    lp = regions.location_performance(df, params, by)
    ranked = top_k(lp, [F.col("total_orders").desc(), F.col("region").asc_nulls_first()], REGION_TABLE_ROWS, by)
    return ranked.select(
        "*", (F.col("rank") <= REGION_CHART_ROWS).alias("in_chart"),
        py_fixed("avg_orders_per_driver", 1, commas=False).alias("avg_orders_text"),
        F.concat(F.lit(CURRENCY), py_fixed("total_cash", 2)).alias("total_cash_text"),
        F.concat(py_fixed("cancellation_rate", 1, commas=False), F.lit("%")).alias("cancellation_rate_text"))


def dod_table(overall: DataFrame) -> DataFrame:
    """Overall changes in long format with direction class.

    ``in_table`` is false for driver_count (the table skips it, the chart
    shows it as 'Active Drivers').
    """
    keys = [k for k in ("Date", "prev_Date") if k in overall.columns]
    stack = ("stack(3, "
             "'total_orders', 1, cast(orders_previous as double), cast(orders_current as double), "
             "cast(orders_change as double), orders_pct_change, "
             "'total_cash', 2, cash_previous, cash_current, cash_change, cash_pct_change, "
             "'driver_count', 3, cast(drivers_previous as double), cast(drivers_current as double), "
             "cast(drivers_change as double), cast(null as double)"
             ") as (metric, ord, previous, current, change, pct_change)")
    long = overall.select(*keys, F.expr(stack))
    chart = F.when(F.col("metric") == "total_orders", F.lit(DOD_METRICS[0][1])) \
        .when(F.col("metric") == "total_cash", F.lit(DOD_METRICS[1][1])).otherwise(F.lit(DOD_METRICS[2][1]))
    return long.select(
        *keys, "metric", F.col("ord").cast("int").alias("ord"),
        F.initcap(F.regexp_replace("metric", "_", " ")).alias("label"),
        chart.alias("chart_label"),
        "previous", "current", "change", "pct_change",
        change_class("change").alias("change_class"),
        (F.col("metric") != "driver_count").alias("in_table"),
        py_fixed("previous", 0).alias("previous_text"),
        py_fixed("current", 0).alias("current_text"),
        F.concat(F.when(F.col("change") > 0, F.lit("+")).otherwise(F.lit("")), py_fixed("change", 0)).alias("change_text"),
        F.concat(signed_1dp_text("pct_change"), F.lit("%")).alias("pct_text"),
    )


def region_changes_table(region_changes: DataFrame, n: int = 10) -> DataFrame:
    """Top-N region changes (by |change|) with direction class."""
    return region_changes.where(F.col("rank") <= n).select(
        "*", change_class("change").alias("change_class"),
        F.concat(F.when(F.col("change") > 0, F.lit("+")).otherwise(F.lit("")), F.col("change").cast("string"))
        .alias("change_text"),
        F.concat(signed_1dp_text("pct_change"), F.lit("%")).alias("pct_text"))


def ordered_regions(df: DataFrame, params: Params, by=()) -> DataFrame:
    """All regions with their place by orders."""
    lp = regions.location_performance(df, params, by)
    w = Window.partitionBy(*by).orderBy(F.col("total_orders").desc(), F.col("region").asc_nulls_first())
    return lp.withColumn("rank", F.row_number().over(w))  # a row per region


def ordered_breakdown(df: DataFrame, params: Params, by=()) -> DataFrame:
    """All regions of the monthly breakdown with their place by cash."""
    lb = regions.location_breakdown(df, params, by)
    w = Window.partitionBy(*by).orderBy(F.col("total_cash").desc(), F.col("region").asc_nulls_first())
    return lb.withColumn("rank", F.row_number().over(w))


def activity_table(act: DataFrame) -> DataFrame:
    """R7 activity table: the activity rows with the highlight classes
    (cancel % over 20 and idle % over 40 are shown as negative)."""
    return act.select(
        "*",
        F.when(F.col("cancel_pct") > 20, F.lit("negative")).otherwise(F.lit("")).alias("cancel_class"),
        F.when(F.col("idle_pct") > 40, F.lit("negative")).otherwise(F.lit("")).alias("idle_class"),
    )


def cash_regions_table(df: DataFrame, params: Params, by=(), n: int = 10) -> DataFrame:
    """Top-N regions by total cash from the monthly breakdown."""
    return cash_regions_rows(regions.location_breakdown(df, params, by), by, n)


def cash_regions_rows(lb: DataFrame, by=(), n: int = 10) -> DataFrame:
    """R8 from the breakdown's rows."""
    ranked = top_k(lb, [F.col("total_cash").desc(), F.col("region").asc_nulls_first()], n, by)
    return ranked.select(
        "*", F.concat(F.lit(CURRENCY), py_float_text("total_cash")).alias("total_cash_text"),
        F.concat(F.lit(CURRENCY), py_float_text("avg_cash")).alias("avg_cash_text"))


def insights(df: DataFrame, params: Params) -> DataFrame:
    """The insight lines for every Date, compared with the previous date.

    Rows (ord, kind, value, value_total, text). The two list counts are
    capped at top_n as the reference's lists are; ``value_total`` keeps the
    uncapped count. Only rules whose condition holds emit a row.

    One aggregation pass over the rows at (Date, region) grain, a rollup to
    one row per Date (region totals give the top region), and ``lag`` over
    those per-date rows for the previous snapshot: no join, one scan.
    """
    d = with_cancellation_rate(df.where(F.col("Date").isNotNull()), params)
    r = roles(d, params)
    ic, hc = r["idle"], r["hours"]
    has_c = r["cancelled"] is not None
    hot_c = (F.col("cancellation_rate") > params.cancellation_rate_warning) & \
        (F.col("total_orders") >= params.min_orders) & F.lit(has_c)
    hot_i = (metric(d, ic) > params.idle_hours_warning) & F.lit(ic is not None)
    h = metric(d, hc)
    region = F.col("driver_geo_region") if "driver_geo_region" in d.columns else F.lit(None).cast("string")
    cnt = lambda cond: F.count_if(cond)
    dec = F.col("total_orders").cast("decimal(18,4)")
    a1 = d.groupBy("Date", region.alias("region")).agg(
        cnt((h > 12) & F.lit(hc is not None)).alias("over12"),
        cnt((h < 8) & F.lit(hc is not None)).alias("under8"),
        cnt(hot_c).alias("n_cancel"),
        cnt(hot_i).alias("n_idle"),
        F.coalesce(F.sum(dec), F.lit(0).cast("decimal(18,4)")).alias("o"),
    )
    region_orders = F.col("o").cast("double").cast("bigint")
    top_key = F.when(F.col("region").isNotNull(), F.struct((-region_orders).alias("neg"), F.col("region")))
    a2 = a1.groupBy("Date").agg(
        F.sum("over12").alias("over12"), F.sum("under8").alias("under8"),
        F.sum("n_cancel").alias("n_cancel"), F.sum("n_idle").alias("n_idle"),
        F.sum("o").cast("double").alias("o"),
        F.min_by("region", top_key).alias("top_region"),
        F.min_by(region_orders, top_key).alias("top_orders"),
    )
    w = Window.orderBy("Date")  # one row per snapshot date
    po = F.lag("o").over(w)
    j = a2.select("*", (F.col("o") - po).alias("_ch"), po.alias("_po"))
    j = j.select(
        "*", F.when(F.col("_po").isNotNull(), F.col("_ch").cast("bigint")).alias("och"),
        F.when(F.col("_po") > 0, rnd(F.col("_ch") / F.col("_po") * F.lit(100.0), 2))
         .when(F.col("_po").isNotNull(), F.lit(0.0)).alias("opct"))
    by = ("Date",)
    cap = F.lit(params.top_n)
    n_c, n_i = F.least(F.col("n_cancel"), cap), F.least(F.col("n_idle"), cap)
    direction = F.when(F.col("och") > 0, F.lit(DIRECTION_UP)).otherwise(F.lit(DIRECTION_DOWN))
    cw, iw = py_float_text(F.lit(float(params.cancellation_rate_warning))), \
        py_float_text(F.lit(float(params.idle_hours_warning)))
    rows = [
        (1, "over_12_hours", F.col("over12"), F.col("over12"), F.col("over12") > 0,
         _fmt(INSIGHT_OVER_12, n=F.col("over12"))),
        (2, "under_8_hours", F.col("under8"), F.col("under8"), F.col("under8") > 0,
         _fmt(INSIGHT_UNDER_8, n=F.col("under8"))),
        (3, "high_cancellation", n_c, F.col("n_cancel"), F.col("n_cancel") > 0,
         _fmt(INSIGHT_HIGH_CANCEL, n=n_c, t=cw)),
        (4, "high_idle", n_i, F.col("n_idle"), F.col("n_idle") > 0,
         _fmt(INSIGHT_HIGH_IDLE, n=n_i, t=iw)),
        (5, "top_region", F.col("top_orders"), F.col("top_orders"), F.col("top_region").isNotNull(),
         _fmt(INSIGHT_TOP_REGION, r=F.col("top_region"), n=F.col("top_orders"))),
        (6, "orders_change", F.col("och"), F.col("och"), F.col("och").isNotNull(),
         _fmt(INSIGHT_ORDERS_CHANGE, d=direction, n=F.abs(F.col("och")), p=signed_1dp_text(F.col("opct")))),
    ]
    arr = F.array(*[
        F.struct(F.lit(o).alias("ord"), F.lit(k).alias("kind"), v.cast("bigint").alias("value"),
                 vt.cast("bigint").alias("value_total"), cond.alias("emit"), txt.alias("text"))
        for o, k, v, vt, cond, txt in rows
    ])
    ex = j.select(*by, F.inline(arr))
    return ex.where(F.col("emit")).drop("emit")
