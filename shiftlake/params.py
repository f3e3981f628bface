"""Typed run parameters (thresholds, excluded category, alias roles)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Fixed values that must equal the reference's defaults.
DEFAULT_MIN_ORDERS = 5
DEFAULT_IDLE_HOURS_WARNING = 4.0
DEFAULT_CANCELLATION_RATE_WARNING = 15.0
DEFAULT_EXCLUDED_VEHICLE_TYPE = "3 Wheeler Electric"


@dataclass(frozen=True)
class Params:
    min_orders: int = DEFAULT_MIN_ORDERS
    idle_hours_warning: float = DEFAULT_IDLE_HOURS_WARNING
    cancellation_rate_warning: float = DEFAULT_CANCELLATION_RATE_WARNING
    exclude_vehicle_type: str | None = DEFAULT_EXCLUDED_VEHICLE_TYPE
    top_n: int = 10
    ranking_n: int = 5
    # explicit role -> column overrides for the alias resolver
    column_overrides: dict = field(default_factory=dict)
    # keep NULL text groups as the literal 'nan' (pandas astype(str) behaviour)
    null_as_text: bool = False
    # drop rows whose every column is null before filling (off = reference result)
    drop_empty_rows: bool = False
    # days up to the current snapshot that the monthly section covers
    monthly_days: int = 60
    # upper bound on rows of a side we are willing to broadcast after counting it
    broadcast_max_rows: int = 2_000_000

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)

    @classmethod
    def from_strings(cls, conf: dict) -> "Params":
        """Parse the string config map of a daily run (env-style keys)."""
        return cls(
            min_orders=int(conf.get("MIN_ORDERS_THRESHOLD", DEFAULT_MIN_ORDERS)),
            idle_hours_warning=float(conf.get("IDLE_HOURS_WARNING", DEFAULT_IDLE_HOURS_WARNING)),
            cancellation_rate_warning=float(
                conf.get("CANCELLATION_RATE_WARNING", DEFAULT_CANCELLATION_RATE_WARNING)
            ),
        )
