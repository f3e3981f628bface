"""ANSI SQL (DuckDB dialect) equivalents of the registered queries.

Each statement runs on the raw tables (pre-registered views) through the
same ``driver_day`` derivation and the same rounding / tie-break rules as
the Spark operators, so results can be compared value for value.
"""

from __future__ import annotations

EXCLUDED = "MACHINERY"

DRIVER_DAY = """
ev AS (
  SELECT user_id, CAST(ts AS DATE) AS d,
    CAST(count(*) AS DOUBLE) AS n,
    CAST(count(*) FILTER (WHERE event_type = 'purchase') AS DOUBLE) AS purchases,
    CAST(count(*) FILTER (WHERE event_type = 'error') AS DOUBLE) AS errors,
    CAST(count(*) FILTER (WHERE event_type = 'view') AS DOUBLE) AS views,
    CAST(count(*) FILTER (WHERE event_type = 'signup') AS DOUBLE) AS signups,
    min(ts) AS min_ts, max(ts) AS max_ts,
    CAST(coalesce(sum(CAST(value AS DECIMAL(18,4))), 0) AS DOUBLE) AS cash,
    CAST(coalesce(sum(CAST(value AS DECIMAL(18,4))) FILTER (WHERE event_type = 'purchase'), 0) AS DOUBLE) AS fare,
    CAST(coalesce(sum(CAST(value AS DECIMAL(18,4))) FILTER (WHERE event_type = 'click'), 0) AS DOUBLE) AS km,
    CAST(coalesce(sum(CAST(value AS DECIMAL(18,4))) FILTER (WHERE event_type = 'error'), 0) AS DOUBLE) AS idle_km
  FROM events GROUP BY 1, 2
),
ev2 AS (
  SELECT *, (epoch_us(max_ts) - epoch_us(min_ts)) / 3.6e9 AS login_hrs FROM ev
),
ev3 AS (
  SELECT *, login_hrs * errors / n AS idle_hrs FROM ev2
),
driver_day_all AS (
  SELECT ev3.d AS "Date", c.c_name AS driver_name, CAST(ev3.user_id AS VARCHAR) AS driver_mobile,
    r.r_name AS driver_geo_region, 'VH-' || CAST(ev3.user_id AS VARCHAR) AS vehicle_number,
    c.c_mktsegment AS vehicle_type,
    n AS allocated_orders, purchases AS completed_orders, errors AS partner_cancellation,
    min_ts AS first_recorded_login_time, max_ts AS last_recorded_login_time,
    login_hrs AS total_login_time_in_hrs, login_hrs - idle_hrs AS time_spent_orders_in_hrs,
    idle_hrs AS time_spent_idle_in_hrs, km AS total_distance_in_kms,
    idle_km AS distance_travelled_while_idle_in_kms, fare AS trip_fare,
    100.0 * signups / n AS pct_notifs_missed_overall,
    n AS total_orders, errors AS orders_cancelled, idle_hrs AS idle_hours, login_hrs AS online_hours,
    cash AS cash_collected, views AS notifications
  FROM ev3
  JOIN customer c ON ev3.user_id = c.c_custkey
  JOIN nation nn ON c.c_nationkey = nn.n_nationkey
  JOIN region r ON nn.n_regionkey = r.r_regionkey
),
dd AS (
  SELECT * FROM driver_day_all WHERE vehicle_type IS DISTINCT FROM '""" + EXCLUDED + """'
)"""


SUPPLIER_DAY = """
li AS (
  SELECT l_suppkey, CAST(l_shipdate AS DATE) AS d, CAST(count(*) AS DOUBLE) AS n,
    CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) AS r,
    CAST(coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,4))), 0) AS DOUBLE) AS cash
  FROM lineitem GROUP BY 1, 2
),
sd AS (
  SELECT li.d AS "Date", s.s_name AS driver_name, CAST(li.l_suppkey AS VARCHAR) AS driver_mobile,
    rg.r_name AS driver_geo_region, 'VH-' || CAST(li.l_suppkey AS VARCHAR) AS vehicle_number,
    CAST(NULL AS VARCHAR) AS vehicle_type, n AS allocated_orders, n - r AS completed_orders,
    r AS partner_cancellation, cash AS trip_fare, n AS total_orders, r AS orders_cancelled, cash AS cash_collected
  FROM li JOIN supplier s ON li.l_suppkey = s.s_suppkey
  JOIN nation nn ON s.s_nationkey = nn.n_nationkey
  JOIN region rg ON nn.n_regionkey = rg.r_regionkey
)"""


def rnd(x: str, n: int) -> str:
    """Every value through its text, which rounds the exact binary value half-even (negative zero becomes zero)."""
    return f"(CAST(format('{{:.{n}f}}', CAST({x} AS DOUBLE)) AS DOUBLE) + 0.0)"


def trunc_int(x: str) -> str:
    return f"CAST(trunc({x}) AS BIGINT)"


def with_dd(body: str) -> str:
    return "WITH " + DRIVER_DAY + (",\n" + body.lstrip() if not body.lstrip().upper().startswith("SELECT") else "\n" + body)


TIE = ("driver_name ASC NULLS FIRST, driver_mobile ASC NULLS FIRST, "
       "vehicle_number ASC NULLS FIRST, \"Date\" ASC NULLS FIRST")


def esum(x: str) -> str:
    return f"CAST(coalesce(sum(CAST({x} AS DECIMAL(18,4))), 0) AS DOUBLE)"


def q(body: str) -> str:
    """Statement over the driver-day CTEs; ``body`` may add more CTEs."""
    body = body.strip()
    if body.upper().startswith("SELECT"):
        return "WITH " + DRIVER_DAY + "\n" + body
    return "WITH " + DRIVER_DAY + ",\n" + body


ACT = """act AS (
  SELECT "Date", driver_name, driver_mobile AS mobile, vehicle_number,
    %(ti_alloc)s AS total_orders, %(ti_comp)s AS completed_orders, %(ti_part)s AS partner_cancels,
    %(cancel)s AS cancel_pct, %(km)s AS total_km, %(earn)s AS total_earnings,
    first_recorded_login_time AS first_activity, last_recorded_login_time AS last_activity,
    %(ww)s AS working_window, %(at)s AS active_time, %(it)s AS idle_time, %(ip)s AS idle_pct,
    %(kpo)s AS km_per_order, %(epk)s AS earnings_per_km, %(oph)s AS orders_per_hour,
    pct_notifs_missed_overall AS missed_notif_pct
  FROM dd
)""" % dict(
    ti_alloc=trunc_int("allocated_orders"), ti_comp=trunc_int("completed_orders"),
    ti_part=trunc_int("partner_cancellation"),
    cancel=rnd("CASE WHEN allocated_orders > 0 THEN partner_cancellation / allocated_orders * 100.0 ELSE 0.0 END", 2),
    km=rnd("total_distance_in_kms", 2), earn=rnd("trip_fare", 2),
    ww=rnd("total_login_time_in_hrs", 2), at=rnd("time_spent_orders_in_hrs", 2), it=rnd("time_spent_idle_in_hrs", 2),
    ip=rnd("CASE WHEN total_login_time_in_hrs > 0 THEN time_spent_idle_in_hrs / total_login_time_in_hrs * 100.0 ELSE 0.0 END", 2),
    kpo=rnd("CASE WHEN completed_orders > 0 THEN total_distance_in_kms / completed_orders ELSE 0.0 END", 2),
    epk=rnd("CASE WHEN total_distance_in_kms > 0 THEN trip_fare / total_distance_in_kms ELSE 0.0 END", 2),
    oph=rnd("CASE WHEN total_login_time_in_hrs > 0 THEN completed_orders / total_login_time_in_hrs ELSE 0.0 END", 2),
)

ACT_COLS = ("total_orders, completed_orders, partner_cancels, cancel_pct, total_km, total_earnings, "
            "first_activity, last_activity, working_window, active_time, idle_time, idle_pct, "
            "km_per_order, earnings_per_km, orders_per_hour, missed_notif_pct")

ITIE = ("driver_name ASC NULLS FIRST, mobile ASC NULLS FIRST, vehicle_number ASC NULLS FIRST, "
        "\"Date\" ASC NULLS FIRST")

# Fixed report texts (same values as the Spark side).
F1 = "🚨 Very High Cancellation Risk (>30%)"
F2 = "⚠️ High Partner Cancellation (>20%)"
F3 = "🕵️ Rogue Pattern: High KM, Low Orders"
F4 = "⏱️ Idle Leakage (>40%)"
F5 = "📍 Suspicious KM per Order (Fleet Deviation)"
F6 = "💰 High KM but Low Earnings"
F7 = "📵 High Notif Miss Rate (Acceptance Manipulation Proxy)"


def _flags_sql(fleet_ref: str) -> str:
    return f"""list_filter([
      CASE WHEN cancel_pct > 30 THEN '{F1}' WHEN cancel_pct > 20 THEN '{F2}' END,
      CASE WHEN total_km > 50 AND completed_orders < 3 AND cancel_pct > 15 THEN '{F3}' END,
      CASE WHEN idle_pct > 40 THEN '{F4}' END,
      CASE WHEN km_per_order > {fleet_ref} * 1.5 AND completed_orders > 0 THEN '{F5}'
           WHEN total_km > 20 AND total_earnings < total_km * 5 THEN '{F6}' END,
      CASE WHEN missed_notif_pct > 50 THEN '{F7}' END
    ], lambda x: x IS NOT NULL)"""


FLEET = """CASE WHEN count(*) FILTER (WHERE completed_orders > 0) > 0
   THEN CAST(sum(CAST(km_per_order AS DECIMAL(18,2))) FILTER (WHERE completed_orders > 0) AS DOUBLE)
        / count(*) FILTER (WHERE completed_orders > 0) ELSE 0.0 END"""

METRICS_TEXT = ("'Cancel: ' || CAST(cancel_pct AS VARCHAR) || '%, Idle: ' || CAST(idle_pct AS VARCHAR) "
                "|| '%, KM/Order: ' || CAST(km_per_order AS VARCHAR)")


def _risk(by_day: bool) -> str:
    if by_day:
        fleet = f"fleet AS (SELECT \"Date\", {FLEET} AS fa FROM act GROUP BY 1)"
        src = "act JOIN fleet USING (\"Date\")"
    else:
        fleet = f"fleet AS (SELECT {FLEET} AS fa FROM act)"
        src = "act, fleet"
    return q(f"""{ACT},
{fleet},
fl AS (SELECT act.*, {_flags_sql('fa')} AS flags FROM {src})
SELECT "Date", driver_name, mobile, vehicle_number, array_to_string(flags, '; ') AS flags_text,
  {METRICS_TEXT} AS metrics
FROM fl WHERE len(flags) > 0""")


def _top(order: str, cols: str, where: str = "TRUE", by_day: bool = False, k: int = 10) -> str:
    part = 'PARTITION BY "Date" ' if by_day else ""
    lead = '"Date", ' if by_day else ""
    return q(f"""SELECT CAST(row_number() OVER ({part}ORDER BY {order}, {TIE}) AS INTEGER) AS rank, {lead}{cols}
FROM dd WHERE {where}
QUALIFY rank <= {k}""")


WHO = "driver_name, driver_mobile, driver_geo_region AS region"

LOCPERF = """lp0 AS (
  SELECT %(by)s driver_geo_region AS region, count(*) AS driver_count,
    %(so)s AS so, %(sc)s AS sc, %(sx)s AS sx
  FROM dd WHERE driver_geo_region IS NOT NULL GROUP BY ALL
),
lp1 AS (
  SELECT %(by)s region, driver_count, %(to)s AS total_orders, so / driver_count AS avg_orders_per_driver,
    sc AS total_cash, sc / driver_count AS avg_cash_per_driver, %(tx)s AS total_cancelled
  FROM lp0
),
lp AS (
  SELECT *, CASE WHEN total_orders > 0 THEN %(rate)s ELSE 0.0 END AS cancellation_rate FROM lp1
)"""


def _locperf(by_day: bool) -> str:
    return LOCPERF % dict(
        by='"Date",' if by_day else "", so=esum("total_orders"), sc=esum("cash_collected"),
        sx=esum("orders_cancelled"), to=trunc_int("so"), tx=trunc_int("sx"),
        rate=rnd("total_cancelled / total_orders * 100.0", 2))


LOCBREAK = f"""lb AS (
  SELECT driver_geo_region AS region, count(*) AS driver_count,
    {rnd(esum('cash_collected'), 2)} AS total_cash,
    {rnd(esum('cash_collected') + ' / count(*)', 2)} AS avg_cash,
    {trunc_int(esum('notifications'))} AS total_notifications,
    {rnd(esum('notifications') + ' / count(*)', 1)} AS avg_notifications,
    {trunc_int(esum('total_orders'))} AS total_orders,
    {rnd(esum('total_orders') + ' / count(*)', 1)} AS avg_orders
  FROM dd WHERE driver_geo_region IS NOT NULL GROUP BY 1
)"""

PAIRS = """dates AS (SELECT DISTINCT "Date" FROM dd WHERE "Date" IS NOT NULL),
pairs AS (SELECT "Date", lag("Date") OVER (ORDER BY "Date") AS prev_Date FROM dates)"""

TOTALS = f"""tot AS (
  SELECT "Date", {esum('total_orders')} AS o, {esum('cash_collected')} AS c, count(*) AS k
  FROM dd WHERE "Date" IS NOT NULL GROUP BY 1
)"""

DOD_OVERALL = f"""{PAIRS},
{TOTALS},
dod AS (
  SELECT p."Date", p.prev_Date,
    {trunc_int('a.o')} AS orders_current, {trunc_int('b.o')} AS orders_previous,
    {trunc_int('a.o - b.o')} AS orders_change,
    CASE WHEN b.o > 0 THEN {rnd('(a.o - b.o) / b.o * 100.0', 2)} ELSE 0.0 END AS orders_pct_change,
    a.c AS cash_current, b.c AS cash_previous, a.c - b.c AS cash_change,
    CASE WHEN b.c > 0 THEN {rnd('(a.c - b.c) / b.c * 100.0', 2)} ELSE 0.0 END AS cash_pct_change,
    a.k AS drivers_current, b.k AS drivers_previous, a.k - b.k AS drivers_change
  FROM pairs p JOIN tot a ON a."Date" = p."Date" JOIN tot b ON b."Date" = p.prev_Date
)"""

DOD_REGION = f"""{PAIRS},
rt AS (
  SELECT "Date", driver_geo_region AS region, {esum('total_orders')} AS o
  FROM dd WHERE "Date" IS NOT NULL AND driver_geo_region IS NOT NULL GROUP BY 1, 2
),
rc0 AS (
  SELECT c."Date", p.prev_Date, c.region, c.o, coalesce(v.o, 0.0) AS pv
  FROM rt c JOIN pairs p ON p."Date" = c."Date" AND p.prev_Date IS NOT NULL
  LEFT JOIN rt v ON v."Date" = p.prev_Date AND v.region = c.region
),
rc1 AS (
  SELECT "Date", prev_Date, region, {trunc_int('o')} AS current_orders, {trunc_int('pv')} AS previous_orders,
    {trunc_int('o - pv')} AS change,
    CASE WHEN pv > 0 THEN {rnd('(o - pv) / pv * 100.0', 2)} ELSE 0.0 END AS pct_change
  FROM rc0
),
rc AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY "Date" ORDER BY abs(change) DESC, region ASC NULLS FIRST)
    AS INTEGER) AS rank FROM rc1
)"""

MASTER_COLS_CASH = "REPLACE (CASE WHEN day(\"Date\") >= 18 THEN cash_collected + 1.0 ELSE cash_collected END AS cash_collected)"

SCORES = f"""sc0 AS (
  SELECT *,
    greatest(CAST(0 AS DOUBLE), 100.0 - cancel_pct * 2) AS cs,
    greatest(CAST(0 AS DOUBLE), 100.0 - idle_pct) AS isc,
    greatest(CAST(0 AS DOUBLE), 100.0 - missed_notif_pct) AS acs,
    CASE WHEN km_per_order < 15 THEN 100.0 ELSE 50.0 END AS kms,
    CASE WHEN total_earnings > 500 THEN 100.0 ELSE 50.0 END AS es
  FROM act
),
sc1 AS (
  SELECT *, CAST(cs AS DOUBLE) * 0.30 + CAST(isc AS DOUBLE) * 0.20 + CAST(acs AS DOUBLE) * 0.15
    + CAST(kms AS DOUBLE) * 0.15 + CAST(es AS DOUBLE) * 0.20 AS final FROM sc0
)"""

ORACLE: dict[str, str] = {}

ORACLE["filter_vehicle"] = q("SELECT * FROM dd")
ORACLE["clean_driver_day"] = q("""SELECT * REPLACE (
  CASE WHEN regexp_full_match(format('{:,.2f}', cash_collected), '[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?')
       THEN CAST(format('{:,.2f}', cash_collected) AS DOUBLE) ELSE 0.0 END AS cash_collected)
FROM dd""")
ORACLE["drop_empty_rows"] = q("SELECT * FROM dd")
ORACLE["scan_driver_day"] = q("SELECT * FROM dd")
ORACLE["canonical_metrics"] = q("""SELECT "Date", driver_name, driver_mobile, vehicle_number, total_orders,
  cash_collected AS cash, notifications, online_hours AS hours, driver_geo_region AS region,
  first_recorded_login_time AS first_login FROM dd""")
ORACLE["cancellation_rate"] = q("""SELECT "Date", driver_name, driver_mobile, vehicle_number, total_orders,
  CASE WHEN total_orders <> 0 THEN orders_cancelled / total_orders * 100.0 ELSE 0.0 END AS cancellation_rate
FROM dd""")
ORACLE["dataset_summary"] = q("""SELECT count(*) AS total_drivers, 24 AS total_columns, min("Date") AS date_start,
  max("Date") AS date_end, count(DISTINCT driver_geo_region) AS unique_regions,
  count(DISTINCT vehicle_type) AS unique_vehicle_types FROM dd""")
ORACLE["distinct_values"] = q("""SELECT DISTINCT 'driver_geo_region' AS column_name, driver_geo_region AS value FROM dd
UNION SELECT DISTINCT 'vehicle_type', vehicle_type FROM dd""")

ORACLE["driver_overview"] = q("""SELECT count(*) AS total_drivers, count(*) AS active_drivers,
  CAST(sum(CASE WHEN online_hours > 12 THEN 1 ELSE 0 END) AS BIGINT) AS drivers_over_12_hours,
  CAST(sum(CASE WHEN online_hours < 8 THEN 1 ELSE 0 END) AS BIGINT) AS drivers_under_8_hours,
  CAST(sum(CASE WHEN online_hours >= 8 AND online_hours <= 12 THEN 1 ELSE 0 END) AS BIGINT) AS drivers_8_to_12_hours,
  count(DISTINCT driver_mobile) AS unique_drivers FROM dd""")
ORACLE["summary_stats"] = q(f"""u AS (
  SELECT 'total_orders' AS metric, total_orders AS value FROM dd
  UNION ALL SELECT 'total_cash', cash_collected FROM dd
  UNION ALL SELECT 'idle_hours', idle_hours FROM dd
  UNION ALL SELECT 'orders_cancelled', orders_cancelled FROM dd
)
SELECT metric, {rnd('avg(value)', 6)} AS mean, {rnd('median(value)', 6)} AS median,
  {rnd('stddev_samp(value)', 6)} AS std, min(value) AS min, max(value) AS max FROM u GROUP BY 1""")
ORACLE["top_performers"] = _top("total_orders DESC", f"{WHO}, {trunc_int('total_orders')} AS orders, cash_collected")
ORACLE["top_performers_by_day"] = _top("total_orders DESC",
                                       f"{WHO}, {trunc_int('total_orders')} AS orders, cash_collected", by_day=True)
ORACLE["bottom_performers"] = _top("total_orders ASC", f"{WHO}, {trunc_int('total_orders')} AS orders",
                                   where="total_orders >= 5")
ORACLE["high_cancellation"] = q(f"""r AS (
  SELECT *, CASE WHEN total_orders <> 0 THEN orders_cancelled / total_orders * 100.0 ELSE 0.0 END AS rate FROM dd
)
SELECT CAST(row_number() OVER (ORDER BY rate DESC, {TIE}) AS INTEGER) AS rank, {WHO},
  {rnd('rate', 2)} AS cancellation_rate, {trunc_int('orders_cancelled')} AS total_cancelled
FROM r WHERE rate > 15.0 AND total_orders >= 5
QUALIFY rank <= 10""")
ORACLE["high_idle"] = _top("idle_hours DESC", f"{WHO}, {rnd('idle_hours', 2)} AS idle_hours",
                           where="idle_hours > 4.0")

ORACLE["location_performance"] = q(_locperf(False) + "\nSELECT * FROM lp")
ORACLE["location_performance_by_day"] = q(_locperf(True) + "\nSELECT * FROM lp")
ORACLE["location_breakdown"] = q(LOCBREAK + "\nSELECT * FROM lb")

ORACLE["activity_summary"] = q(ACT + "\nSELECT * FROM act")
ORACLE["risk_flags"] = _risk(False)
ORACLE["risk_flags_by_day"] = _risk(True)
ORACLE["rogue_detection"] = q(f"""SELECT "Date", driver_name, driver_mobile AS mobile, vehicle_number,
  {trunc_int('partner_cancellation')} AS partner_cancels, {rnd('distance_travelled_while_idle_in_kms', 2)} AS idle_km,
  '⚠ Potential Off-Platform Delivery Risk' AS status
FROM dd WHERE partner_cancellation > 0 AND distance_travelled_while_idle_in_kms > 5""")


def _rankings(by_day: bool) -> str:
    part = 'PARTITION BY "Date" ' if by_day else ""
    return q(f"""{ACT},
a AS (SELECT * FROM act WHERE working_window > 1),
t AS (SELECT 'top_5' AS rank_type, *, orders_per_hour - cancel_pct / 100 - idle_pct / 100 AS rank_key FROM a),
b AS (SELECT 'bottom_5' AS rank_type, *, idle_pct + cancel_pct - orders_per_hour * 10 AS rank_key FROM a),
tr AS (SELECT *, CAST(row_number() OVER ({part}ORDER BY rank_key DESC, {ITIE}) AS INTEGER) AS rank,
  driver_name || ' (' || CAST(orders_per_hour AS VARCHAR) || ' orders/hr)' AS label FROM t QUALIFY rank <= 5),
br AS (SELECT *, CAST(row_number() OVER ({part}ORDER BY rank_key DESC, {ITIE}) AS INTEGER) AS rank,
  driver_name || ' (' || CAST(idle_pct AS VARCHAR) || '% idle)' AS label FROM b QUALIFY rank <= 5)
SELECT * FROM tr UNION ALL SELECT * FROM br""")


ORACLE["rankings"] = _rankings(False)
ORACLE["rankings_by_day"] = _rankings(True)
ORACLE["integrity_scores"] = q(f"""{ACT},
{SCORES}
SELECT "Date", driver_name, mobile, vehicle_number, {rnd('final', 1)} AS score,
  CASE WHEN final < 40 THEN 'Immediate Intervention' WHEN final < 60 THEN 'Needs Review' ELSE 'Good' END AS status,
  CASE WHEN {rnd('final', 1)} < 40 THEN 'negative' WHEN {rnd('final', 1)} < 60 THEN 'warning' ELSE 'positive' END
    AS score_class
FROM sc1""")
ORACLE["integrity_exec_summary"] = q(f"""{ACT},
fleet AS (SELECT {FLEET} AS fa FROM act),
fl AS (SELECT act.*, {_flags_sql('fa')} AS flags FROM act, fleet),
risk AS (SELECT count(*) AS risk_count FROM fl WHERE len(flags) > 0),
base AS (
  SELECT count(*) AS total_drivers,
    CAST(sum(CAST(cancel_pct AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_cancel_pct,
    CAST(sum(CAST(idle_pct AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_idle_pct
  FROM act
)
SELECT total_drivers, avg_cancel_pct, avg_idle_pct, {rnd('avg_cancel_pct', 1)} AS avg_cancel_pct_1dp,
  {rnd('avg_idle_pct', 1)} AS avg_idle_pct_1dp, format('{{:.1f}}', avg_cancel_pct) || '%' AS avg_cancel_pct_text,
  format('{{:.1f}}', avg_idle_pct) || '%' AS avg_idle_pct_text, risk_count FROM base, risk""")


def _shift(by_day: bool) -> str:
    by = '"Date", ' if by_day else ""
    grp = "GROUP BY 1" if by_day else ""
    parts = []
    conds = ["online_hours < 8", "online_hours >= 8 AND online_hours <= 12", "online_hours > 12"]
    names = ["under_8_hours", "between_8_12_hours", "over_12_hours"]
    aggs = ["count(*) AS tot"]
    for i, cnd in enumerate(conds):
        aggs.append(f"CAST(sum(CASE WHEN {cnd} THEN 1 ELSE 0 END) AS BIGINT) AS c{i}")
        aggs.append(f"{esum(f'CASE WHEN {cnd} THEN cash_collected END')} AS s{i}")
        aggs.append(f"{esum(f'CASE WHEN {cnd} THEN total_orders END')} AS o{i}")
    for i, n in enumerate(names):
        parts.append(f"""SELECT {by}'{n}' AS bucket, {i + 1} AS bucket_order, c{i} AS count,
  CASE WHEN tot > 0 THEN {rnd(f'c{i} / tot * 100.0', 1)} ELSE 0.0 END AS pct,
  CASE WHEN c{i} > 0 THEN {rnd(f's{i} / c{i}', 2)} ELSE 0.0 END AS avg_cash,
  CASE WHEN c{i} > 0 THEN {rnd(f'o{i} / c{i}', 2)} ELSE 0.0 END AS avg_orders,
  tot AS total_active_drivers FROM g""")
    return q(f"g AS (SELECT {by}{', '.join(aggs)} FROM dd {grp})\n" + "\nUNION ALL\n".join(parts))


ORACLE["shift_durations"] = _shift(False)
ORACLE["shift_durations_by_day"] = _shift(True)


def _corr(a: str, b: str) -> str:
    den = f"(stddev_samp({a}) * stddev_samp({b}))"
    return rnd(f"coalesce(CASE WHEN {den} <> 0 THEN covar_samp({a}, {b}) / {den} END, 0.0)", 3)


ORACLE["hours_correlations"] = q(f"""SELECT {_corr('online_hours', 'cash_collected')} AS hours_vs_cash,
  {_corr('online_hours', 'notifications')} AS hours_vs_notifications,
  {_corr('online_hours', 'total_orders')} AS hours_vs_orders FROM dd""")
ORACLE["login_hour_stats"] = q(f"""SELECT CAST(hour(first_recorded_login_time) AS INTEGER) AS hour,
  printf('%02d:00', hour(first_recorded_login_time)) AS hour_label, count(*) AS driver_count,
  {rnd(esum('cash_collected') + ' / count(*)', 2)} AS avg_cash,
  {rnd(esum('notifications') + ' / count(*)', 1)} AS avg_notifications
FROM dd WHERE first_recorded_login_time IS NOT NULL GROUP BY 1, 2""")

ORACLE["previous_snapshot"] = q("""SELECT * FROM dd WHERE "Date" = (
  SELECT max("Date") FROM dd WHERE "Date" < (SELECT max("Date") FROM dd))""")
ORACLE["dod_overall"] = q(DOD_OVERALL + "\nSELECT * FROM dod")
ORACLE["dod_region"] = q(DOD_REGION + "\nSELECT * FROM rc")
ORACLE["dod_latest"] = q(DOD_OVERALL + """
SELECT * EXCLUDE ("Date", prev_Date) FROM dod WHERE "Date" = (SELECT max("Date") FROM dd)""")
ORACLE["dod_region_latest"] = q(DOD_REGION + """
SELECT region, current_orders, previous_orders, change, pct_change,
  CAST(row_number() OVER (ORDER BY abs(change) DESC, region ASC NULLS FIRST) AS INTEGER) AS rank
FROM rc WHERE "Date" = (SELECT max("Date") FROM dd)""")

ORACLE["master_upsert"] = q(f"SELECT * {MASTER_COLS_CASH} FROM dd")
ORACLE["stream_master"] = ORACLE["master_upsert"]
ORACLE["master_backfill"] = q("""SELECT * REPLACE (CASE WHEN day("Date") >= 14 THEN cash_collected + 2.0
  ELSE cash_collected END AS cash_collected),
  CASE WHEN day("Date") >= 14 THEN 'late' END AS source_batch FROM dd""")
ORACLE["dedup_all_columns"] = q("""SELECT DISTINCT * EXCLUDE ("Date", driver_name, driver_mobile, vehicle_number)
FROM dd""")
ORACLE["archive_snapshot"] = q("""SELECT *, strftime("Date", '%Y%m%d') AS snapshot_date FROM driver_day_all""")

ORACLE["report_summary_cards"] = q("""o AS (
  SELECT count(*) AS a, CAST(sum(CASE WHEN online_hours > 12 THEN 1 ELSE 0 END) AS BIGINT) AS o12,
    CAST(sum(CASE WHEN online_hours < 8 THEN 1 ELSE 0 END) AS BIGINT) AS u8,
    CAST(sum(CASE WHEN online_hours >= 8 AND online_hours <= 12 THEN 1 ELSE 0 END) AS BIGINT) AS m,
    count(DISTINCT driver_geo_region) AS r FROM dd
)
SELECT 'active_drivers' AS card, 1 AS ord, 'Total Active Drivers' AS label, a AS value FROM o
UNION ALL SELECT 'drivers_over_12_hours', 2, 'Logged in 12+ Hours', o12 FROM o
UNION ALL SELECT 'drivers_under_8_hours', 3, 'Logged in < 8 Hours', u8 FROM o
UNION ALL SELECT 'drivers_8_to_12_hours', 4, 'Logged in 8-12 Hours', m FROM o
UNION ALL SELECT 'total_regions', 5, 'Active Regions', r FROM o""")
ORACLE["report_top_performers"] = q(f"""SELECT CAST(row_number() OVER (ORDER BY total_orders DESC, {TIE}) AS INTEGER)
  AS rank, {WHO}, {trunc_int('total_orders')} AS orders, cash_collected, substring(driver_name, 1, 20) AS chart_label,
  '₹' || format('{{:,.2f}}', cash_collected) AS cash_text
FROM dd QUALIFY rank <= 10""")
ORACLE["report_regions"] = q(_locperf(False) + """
SELECT *, rank <= 10 AS in_chart, format('{:.1f}', avg_orders_per_driver) AS avg_orders_text,
  '₹' || format('{:,.2f}', total_cash) AS total_cash_text,
  format('{:.1f}', CAST(cancellation_rate AS DOUBLE)) || '%' AS cancellation_rate_text FROM (
  SELECT *, CAST(row_number() OVER (ORDER BY total_orders DESC, region ASC NULLS FIRST) AS INTEGER) AS rank FROM lp
  QUALIFY rank <= 15)""")
ORACLE["report_dod"] = q(DOD_OVERALL + """
SELECT "Date", prev_Date, 'total_orders' AS metric, 1 AS ord, 'Total Orders' AS label, 'Total Orders' AS chart_label,
  CAST(orders_previous AS DOUBLE) AS previous, CAST(orders_current AS DOUBLE) AS current,
  CAST(orders_change AS DOUBLE) AS change, orders_pct_change AS pct_change,
  CASE WHEN orders_change > 0 THEN 'positive' ELSE 'negative' END AS change_class, TRUE AS in_table,
  format('{:,.0f}', CAST(orders_previous AS DOUBLE)) AS previous_text,
  format('{:,.0f}', CAST(orders_current AS DOUBLE)) AS current_text,
  CASE WHEN orders_change > 0 THEN '+' ELSE '' END || format('{:,.0f}', CAST(orders_change AS DOUBLE)) AS change_text,
  format('{:+.1f}', orders_pct_change) || '%' AS pct_text FROM dod
UNION ALL SELECT "Date", prev_Date, 'total_cash', 2, 'Total Cash', 'Total Cash', cash_previous, cash_current,
  cash_change, cash_pct_change, CASE WHEN cash_change > 0 THEN 'positive' ELSE 'negative' END, TRUE,
  format('{:,.0f}', cash_previous), format('{:,.0f}', cash_current),
  CASE WHEN cash_change > 0 THEN '+' ELSE '' END || format('{:,.0f}', cash_change),
  format('{:+.1f}', cash_pct_change) || '%' FROM dod
UNION ALL SELECT "Date", prev_Date, 'driver_count', 3, 'Driver Count', 'Active Drivers',
  CAST(drivers_previous AS DOUBLE), CAST(drivers_current AS DOUBLE), CAST(drivers_change AS DOUBLE), NULL,
  CASE WHEN drivers_change > 0 THEN 'positive' ELSE 'negative' END, FALSE,
  format('{:,.0f}', CAST(drivers_previous AS DOUBLE)), format('{:,.0f}', CAST(drivers_current AS DOUBLE)),
  CASE WHEN drivers_change > 0 THEN '+' ELSE '' END || format('{:,.0f}', CAST(drivers_change AS DOUBLE)),
  NULL FROM dod""")
ORACLE["report_region_changes"] = q(DOD_REGION + """
SELECT *, CASE WHEN change > 0 THEN 'positive' ELSE 'negative' END AS change_class,
  CASE WHEN change > 0 THEN '+' ELSE '' END || CAST(change AS VARCHAR) AS change_text,
  format('{:+.1f}', pct_change) || '%' AS pct_text FROM rc WHERE rank <= 10""")
ORACLE["report_cash_regions"] = q(LOCBREAK + """
SELECT *, CAST(row_number() OVER (ORDER BY total_cash DESC, region ASC NULLS FIRST) AS INTEGER) AS rank,
  '₹' || CAST(total_cash AS VARCHAR) AS total_cash_text, '₹' || CAST(avg_cash AS VARCHAR) AS avg_cash_text FROM lb
QUALIFY rank <= 10""")


def _signed(x: str) -> str:
    return f"format('{{:+.1f}}', CAST({x} AS DOUBLE))"


ORACLE["insights"] = q(f"""{DOD_OVERALL},
{_locperf(True)},
r AS (SELECT *, CASE WHEN total_orders <> 0 THEN orders_cancelled / total_orders * 100.0 ELSE 0.0 END AS rate
      FROM dd WHERE "Date" IS NOT NULL),
pd AS (
  SELECT "Date",
    CAST(sum(CASE WHEN online_hours > 12 THEN 1 ELSE 0 END) AS BIGINT) AS over12,
    CAST(sum(CASE WHEN online_hours < 8 THEN 1 ELSE 0 END) AS BIGINT) AS under8,
    CAST(sum(CASE WHEN rate > 15.0 AND total_orders >= 5 THEN 1 ELSE 0 END) AS BIGINT) AS n_cancel,
    CAST(sum(CASE WHEN idle_hours > 4.0 THEN 1 ELSE 0 END) AS BIGINT) AS n_idle
  FROM r GROUP BY 1
),
tr AS (
  SELECT "Date", region AS top_region, total_orders AS top_orders FROM lp
  QUALIFY row_number() OVER (PARTITION BY "Date" ORDER BY total_orders DESC, region ASC NULLS FIRST) = 1
),
j AS (
  SELECT pd.*, tr.top_region, tr.top_orders, dod.orders_change AS och, dod.orders_pct_change AS opct
  FROM pd LEFT JOIN tr USING ("Date") LEFT JOIN dod USING ("Date")
)
SELECT "Date", 1 AS ord, 'over_12_hours' AS kind, over12 AS value, over12 AS value_total,
  '⏰ ' || over12 || ' drivers logged in for 12+ hours (High Duty)' AS text FROM j WHERE over12 > 0
UNION ALL SELECT "Date", 2, 'under_8_hours', under8, under8,
  '⏳ ' || under8 || ' drivers logged in for < 8 hours (Part Time)' FROM j WHERE under8 > 0
UNION ALL SELECT "Date", 3, 'high_cancellation', least(n_cancel, 10), n_cancel,
  '⚠️ ' || least(n_cancel, 10) || ' drivers have cancellation rates above 15.0% - requires attention'
  FROM j WHERE n_cancel > 0
UNION ALL SELECT "Date", 4, 'high_idle', least(n_idle, 10), n_idle,
  '⏱️ ' || least(n_idle, 10) || ' drivers have idle time exceeding 4.0 hours - potential efficiency issue'
  FROM j WHERE n_idle > 0
UNION ALL SELECT "Date", 5, 'top_region', top_orders, top_orders,
  '🏆 Top performing region: ' || top_region || ' with ' || top_orders || ' total orders'
  FROM j WHERE top_region IS NOT NULL
UNION ALL SELECT "Date", 6, 'orders_change', och, och,
  'Total orders ' || CASE WHEN och > 0 THEN '📈 increased' ELSE '📉 decreased' END || ' by ' || abs(och)
  || ' (' || {_signed('opct')} || '%) compared to previous day' FROM j WHERE och IS NOT NULL""")


def on_supplier(sql: str) -> str:
    """The same statement over the lineitem x supplier fact instead of driver_day."""
    assert sql.startswith("WITH " + DRIVER_DAY)
    body = sql[len("WITH " + DRIVER_DAY):]
    body = body.replace("FROM dd", "FROM sd").replace("FROM dd ", "FROM sd ")
    return "WITH " + SUPPLIER_DAY + body


ORACLE["supplier_location_performance"] = on_supplier(ORACLE["location_performance"])
ORACLE["supplier_top_performers_by_day"] = on_supplier(ORACLE["top_performers_by_day"])
ORACLE["supplier_dod_region"] = on_supplier(ORACLE["dod_region"])
ORACLE["supplier_high_cancellation"] = on_supplier(ORACLE["high_cancellation"])
ORACLE["supplier_summary_stats"] = "WITH " + SUPPLIER_DAY + f""",
u AS (
  SELECT 'total_orders' AS metric, total_orders AS value FROM sd
  UNION ALL SELECT 'total_cash', cash_collected FROM sd
  UNION ALL SELECT 'orders_cancelled', orders_cancelled FROM sd
)
SELECT metric, {rnd('avg(value)', 6)} AS mean, {rnd('median(value)', 6)} AS median,
  {rnd('stddev_samp(value)', 6)} AS std, min(value) AS min, max(value) AS max FROM u GROUP BY 1"""


# --- every day at once ------------------------------------------------------------------

ORACLE["driver_overview_by_day"] = q("""SELECT "Date", count(*) AS total_drivers, count(*) AS active_drivers,
  CAST(sum(CASE WHEN online_hours > 12 THEN 1 ELSE 0 END) AS BIGINT) AS drivers_over_12_hours,
  CAST(sum(CASE WHEN online_hours < 8 THEN 1 ELSE 0 END) AS BIGINT) AS drivers_under_8_hours,
  CAST(sum(CASE WHEN online_hours >= 8 AND online_hours <= 12 THEN 1 ELSE 0 END) AS BIGINT) AS drivers_8_to_12_hours,
  count(DISTINCT driver_mobile) AS unique_drivers FROM dd GROUP BY 1""")
ORACLE["summary_stats_by_day"] = q(f"""u AS (
  SELECT "Date", 'total_orders' AS metric, total_orders AS value FROM dd
  UNION ALL SELECT "Date", 'total_cash', cash_collected FROM dd
  UNION ALL SELECT "Date", 'idle_hours', idle_hours FROM dd
  UNION ALL SELECT "Date", 'orders_cancelled', orders_cancelled FROM dd
)
SELECT "Date", metric, {rnd('avg(value)', 6)} AS mean, {rnd('median(value)', 6)} AS median,
  {rnd('stddev_samp(value)', 6)} AS std, min(value) AS min, max(value) AS max FROM u GROUP BY 1, 2""")
ORACLE["bottom_performers_by_day"] = _top("total_orders ASC", f"{WHO}, {trunc_int('total_orders')} AS orders",
                                          where="total_orders >= 5", by_day=True)
ORACLE["high_cancellation_by_day"] = q(f"""r AS (
  SELECT *, CASE WHEN total_orders <> 0 THEN orders_cancelled / total_orders * 100.0 ELSE 0.0 END AS rate FROM dd
)
SELECT CAST(row_number() OVER (PARTITION BY "Date" ORDER BY rate DESC, {TIE}) AS INTEGER) AS rank, "Date", {WHO},
  {rnd('rate', 2)} AS cancellation_rate, {trunc_int('orders_cancelled')} AS total_cancelled
FROM r WHERE rate > 15.0 AND total_orders >= 5
QUALIFY rank <= 10""")
ORACLE["high_idle_by_day"] = _top("idle_hours DESC", f"{WHO}, {rnd('idle_hours', 2)} AS idle_hours",
                                  where="idle_hours > 4.0", by_day=True)
ORACLE["integrity_exec_summary_by_day"] = q(f"""{ACT},
fleet AS (SELECT "Date", {FLEET} AS fa FROM act GROUP BY 1),
fl AS (SELECT act.*, {_flags_sql('fa')} AS flags FROM act JOIN fleet USING ("Date")),
risk AS (SELECT "Date", count(*) AS risk_count FROM fl WHERE len(flags) > 0 GROUP BY 1),
base AS (
  SELECT "Date", count(*) AS total_drivers,
    CAST(sum(CAST(cancel_pct AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_cancel_pct,
    CAST(sum(CAST(idle_pct AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_idle_pct
  FROM act GROUP BY 1
)
SELECT "Date", total_drivers, avg_cancel_pct, avg_idle_pct, {rnd('avg_cancel_pct', 1)} AS avg_cancel_pct_1dp,
  {rnd('avg_idle_pct', 1)} AS avg_idle_pct_1dp, format('{{:.1f}}', avg_cancel_pct) || '%' AS avg_cancel_pct_text,
  format('{{:.1f}}', avg_idle_pct) || '%' AS avg_idle_pct_text, coalesce(risk_count, 0) AS risk_count
FROM base LEFT JOIN risk USING ("Date")""")
ORACLE["location_breakdown_by_day"] = q(LOCBREAK.replace(
    "SELECT driver_geo_region AS region", 'SELECT "Date", driver_geo_region AS region').replace(
    "GROUP BY 1\n)", "GROUP BY 1, 2\n)") + "\nSELECT * FROM lb")
ORACLE["login_hour_stats_by_day"] = q(f"""SELECT "Date", CAST(hour(first_recorded_login_time) AS INTEGER) AS hour,
  printf('%02d:00', hour(first_recorded_login_time)) AS hour_label, count(*) AS driver_count,
  {rnd(esum('cash_collected') + ' / count(*)', 2)} AS avg_cash,
  {rnd(esum('notifications') + ' / count(*)', 1)} AS avg_notifications
FROM dd WHERE first_recorded_login_time IS NOT NULL GROUP BY 1, 2, 3""")
ORACLE["hours_correlations_by_day"] = q(f"""SELECT "Date", {_corr('online_hours', 'cash_collected')} AS hours_vs_cash,
  {_corr('online_hours', 'notifications')} AS hours_vs_notifications,
  {_corr('online_hours', 'total_orders')} AS hours_vs_orders FROM dd GROUP BY 1""")
ORACLE["report_summary_cards_by_day"] = q("""o AS (
  SELECT "Date", count(*) AS a, CAST(sum(CASE WHEN online_hours > 12 THEN 1 ELSE 0 END) AS BIGINT) AS o12,
    CAST(sum(CASE WHEN online_hours < 8 THEN 1 ELSE 0 END) AS BIGINT) AS u8,
    CAST(sum(CASE WHEN online_hours >= 8 AND online_hours <= 12 THEN 1 ELSE 0 END) AS BIGINT) AS m,
    count(DISTINCT driver_geo_region) AS r FROM dd GROUP BY 1
)
SELECT "Date", 'active_drivers' AS card, 1 AS ord, 'Total Active Drivers' AS label, a AS value FROM o
UNION ALL SELECT "Date", 'drivers_over_12_hours', 2, 'Logged in 12+ Hours', o12 FROM o
UNION ALL SELECT "Date", 'drivers_under_8_hours', 3, 'Logged in < 8 Hours', u8 FROM o
UNION ALL SELECT "Date", 'drivers_8_to_12_hours', 4, 'Logged in 8-12 Hours', m FROM o
UNION ALL SELECT "Date", 'total_regions', 5, 'Active Regions', r FROM o""")

ORACLE["report_activity"] = q(ACT + """
SELECT *, CASE WHEN cancel_pct > 20 THEN 'negative' ELSE '' END AS cancel_class,
  CASE WHEN idle_pct > 40 THEN 'negative' ELSE '' END AS idle_class FROM act""")

ORACLE["scan_mixed_headers"] = q("""SELECT "Date", driver_mobile, total_orders AS no_of_orders,
  CASE WHEN dayofyear("Date") % 3 = 0 THEN driver_name || ', "the' || chr(10) || '2nd"' ELSE driver_name END AS driver_name,
  CASE WHEN dayofyear("Date") % 3 = 2 THEN 0.0 ELSE cash_collected END AS cash_collected,
  CASE WHEN dayofyear("Date") % 3 = 1 THEN 'north' END AS depot FROM driver_day_all""")
FILE_COLUMNS = [
    "driver_name", "driver_mobile", "driver_geo_region", "vehicle_number", "vehicle_type", "allocated_orders",
    "completed_orders", "partner_cancellation", "first_recorded_login_time", "last_recorded_login_time",
    "total_login_time_in_hrs", "time_spent_orders_in_hrs", "time_spent_idle_in_hrs", "total_distance_in_kms",
    "distance_travelled_while_idle_in_kms", "trip_fare", "pct_notifs_missed_overall", "total_orders",
    "orders_cancelled", "idle_hours", "online_hours", "cash_collected", "notifications",
]
ORACLE["load_audit"] = q(f"""SELECT "Date", count(*) AS total_rows,
  CAST(CASE WHEN day("Date") > 15 THEN {len(FILE_COLUMNS) + 1} ELSE {len(FILE_COLUMNS)} END AS INTEGER) AS total_columns,
  CASE WHEN day("Date") > 15 THEN '{",".join([*reversed(FILE_COLUMNS), "depot"])}' ELSE '{",".join(FILE_COLUMNS)}' END AS columns
FROM driver_day_all GROUP BY "Date" """)
ORACLE["previous_file_by_mtime"] = q("""SELECT arrival, count(*) AS total_rows,
  CAST(lag(arrival) OVER (ORDER BY arrival) AS INTEGER) AS previous_arrival
FROM (SELECT CAST((day("Date") - 1) // 8 AS INTEGER) AS arrival FROM driver_day_all) GROUP BY arrival""")
ORACLE["master_replay_any_order"] = q(f"""SELECT * {MASTER_COLS_CASH}
FROM dd, (VALUES ('121'), ('21')) a(arrivals)""")
ORACLE["daily_whole_file"] = ORACLE["location_performance"]
ORACLE["integrity_scores_ranked"] = ORACLE["integrity_scores"].replace(
    "AS score_class\nFROM sc1", "AS score_class,\n  row_number() OVER (ORDER BY " + rnd("final", 1) + """, driver_name ASC NULLS FIRST,
    mobile ASC NULLS FIRST, vehicle_number ASC NULLS FIRST, "Date" ASC NULLS FIRST) AS rank\nFROM sc1""")
ORACLE["regions_ranked"] = q(_locperf(False) + """
SELECT *, CAST(row_number() OVER (ORDER BY total_orders DESC, region ASC NULLS FIRST) AS INTEGER) AS rank FROM lp""")
ORACLE["cash_regions_ranked"] = q(LOCBREAK + """
SELECT *, CAST(row_number() OVER (ORDER BY total_cash DESC, region ASC NULLS FIRST) AS INTEGER) AS rank FROM lb""")
ORACLE["unique_drivers_by_window"] = q("""SELECT d."Date", count(DISTINCT CASE WHEN x."Date" = d."Date" THEN x.driver_mobile END) AS unique_1d,
  count(DISTINCT x.driver_mobile) AS unique_7d
FROM (SELECT DISTINCT "Date" FROM dd) d JOIN dd x ON x."Date" BETWEEN d."Date" - 6 AND d."Date" GROUP BY 1""")
ORACLE["clean_mixed_date_layouts"] = q("""SELECT "Date", driver_name, driver_mobile, vehicle_type, total_orders FROM dd""")
ORACLE["monthly_shifts_from_states"] = ORACLE["shift_durations"]
ORACLE["monthly_hours_from_states"] = ORACLE["login_hour_stats"]
ORACLE["monthly_regions_from_states"] = ORACLE["location_breakdown"]
ORACLE["monthly_correlations_from_states"] = ORACLE["hours_correlations"]
