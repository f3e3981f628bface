"""Hand-written driver-day rows for micro-fixture tests."""

import datetime as dt

COLUMNS = {
    "Date": "date", "driver_name": "string", "driver_mobile": "string", "driver_geo_region": "string",
    "vehicle_number": "string", "vehicle_type": "string",
    "allocated_orders": "double", "completed_orders": "double", "partner_cancellation": "double",
    "first_recorded_login_time": "timestamp_ntz", "total_login_time_in_hrs": "double", "time_spent_orders_in_hrs": "double", "time_spent_idle_in_hrs": "double",
    "total_distance_in_kms": "double", "distance_travelled_while_idle_in_kms": "double", "trip_fare": "double",
    "pct_notifs_missed_overall": "double", "total_orders": "double", "orders_cancelled": "double",
    "idle_hours": "double", "online_hours": "double", "cash_collected": "double", "notifications": "double",
}
DAY = dt.date(2024, 1, 10)


def frame(spark, rows):
    """rows: list of dicts; missing fields default to 0 / names derived from 'name'."""
    out = []
    for i, r in enumerate(rows):
        name = r.get("driver_name", f"D{i:02d}")
        base = {c: (0.0 if t == "double" else None) for c, t in COLUMNS.items()}
        base.update(Date=DAY, driver_name=name, driver_mobile=f"m{i:02d}", vehicle_number=f"V{i:02d}",
                    driver_geo_region="R1", vehicle_type="Car")
        base.update({k: (float(v) if COLUMNS.get(k) == "double" and v is not None else v) for k, v in r.items()})
        out.append(tuple(base[c] for c in COLUMNS))
    schema = ", ".join(f"{c} {t}" for c, t in COLUMNS.items())
    return spark.createDataFrame(out, schema)
