"""Canonical driver-day schema, alias roles and the column resolver."""

from __future__ import annotations

import logging

from pyspark.sql import types as T

log = logging.getLogger(__name__)
_warned: set = set()

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's (names, alias priorities,
# name patterns, labels). Kept together and in their natural order.
# ---------------------------------------------------------------------------
KEY_COLUMNS = ["Date", "driver_name", "driver_mobile", "vehicle_number"]

ALIASES = {
    "orders": ["orders_completed", "total_orders", "orders"],
    "hours": ["online_hours", "duty_hours", "idle_hours", "hours"],
    "cancelled": ["orders_cancelled", "cancelled", "driver_cancelled"],
    "cancelled_region": ["orders_cancelled", "cancelled"],
    "idle": ["idle_hours", "idle_time"],
    "cash": ["cash_collected", "cash", "collection"],
    "notifications": ["notifications", "notification_count", "notifs"],
    "region": ["driver_geo_region", "region", "location", "cluster"],
    "first_login": ["first_login_time", "first_login", "login_time", "start_time"],
    "last_login": ["last_login_time", "last_login", "logout_time", "end_time"],
}

# Defaults used by the monthly analysis when a role is not found.
ROLE_FALLBACK_NAMES = {
    "orders": "orders",
    "cash": "cash_collected",
    "notifications": "notifications",
    "hours": "hours",
    "region": "driver_geo_region",
}

NUMERIC_NAME_PATTERNS = [
    "hours", "kms", "collected", "balance", "orders",
    "cancelled", "notifications", "incentive", "penalty",
]

# Tokens pandas' CSV reader turns into NaN by default.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

BUCKET_UNDER_8 = "under_8_hours"
BUCKET_8_12 = "between_8_12_hours"
BUCKET_OVER_12 = "over_12_hours"
BUCKETS = [BUCKET_UNDER_8, BUCKET_8_12, BUCKET_OVER_12]

MISSING_TEXT = "N/A"

# Canonical typed schema of one driver-day row (the union of every column
# the analyses read). Unknown extra columns are carried through untouched.
CANONICAL_TYPES = {
    "Date": T.DateType(),
    "driver_name": T.StringType(),
    "driver_mobile": T.StringType(),
    "driver_geo_region": T.StringType(),
    "vehicle_number": T.StringType(),
    "vehicle_type": T.StringType(),
    "allocated_orders": T.DoubleType(),
    "completed_orders": T.DoubleType(),
    "partner_cancellation": T.DoubleType(),
    "first_recorded_login_time": T.TimestampNTZType(),
    "last_recorded_login_time": T.TimestampNTZType(),
    "total_login_time_in_hrs": T.DoubleType(),
    "time_spent_orders_in_hrs": T.DoubleType(),
    "time_spent_idle_in_hrs": T.DoubleType(),
    "total_distance_in_kms": T.DoubleType(),
    "distance_travelled_while_idle_in_kms": T.DoubleType(),
    "trip_fare": T.DoubleType(),
    "pct_notifs_missed_overall": T.DoubleType(),
    "total_orders": T.DoubleType(),
    "orders_completed": T.DoubleType(),
    "orders_cancelled": T.DoubleType(),
    "idle_hours": T.DoubleType(),
    "online_hours": T.DoubleType(),
    "cash_collected": T.DoubleType(),
    "notifications": T.DoubleType(),
    "first_login_time": T.TimestampNTZType(),
}


def is_numeric_name(name: str) -> bool:
    low = name.lower()
    return any(p in low for p in NUMERIC_NAME_PATTERNS)


def resolve_column(columns: list[str], names: list[str], role: str | None = None,
                   overrides: dict | None = None) -> str | None:
    """Find a column by alias: per alias, case-insensitive exact match first,
    then case-insensitive substring; the first column in frame order wins.

    Pure driver-side metadata lookup (no Spark job). ``overrides`` maps a
    role to an explicit column name and wins over the search.
    """
    if overrides and role in overrides:
        return overrides[role] if overrides[role] in columns else None
    for name in names:
        low = name.lower()
        for c in columns:
            if c.lower() == low:
                return c
        hits = [c for c in columns if low in c.lower()]
        if hits:
            if len(hits) > 1 and (name, tuple(hits)) not in _warned:
                _warned.add((name, tuple(hits)))  # once per ambiguity, not once per call
                log.warning("alias %r matches several columns %s; using %r (set Params.column_overrides "
                            "to choose)", name, hits, hits[0])
            return hits[0]
    return None


def resolve_role(df, role: str, overrides: dict | None = None) -> str | None:
    return resolve_column(df.columns, ALIASES[role], role, overrides)

# Arrival order of rows read from files, set by the scans: modification time, path, block, and the
# place in that order where a scan binds by header.
FILE_ORDER = ["_mtime", "_path", "_block", "_pos"]
