"""shiftlake: Spark-native analytics over daily per-driver fleet reports.

One row of input is one driver's day. Every operator is a lazy function
``f(df, params, by=()) -> DataFrame`` built from built-in column
expressions; ``by=("Date",)`` runs all days of a multi-day frame in one
job, ``by=()`` treats the whole frame as a single snapshot.
"""

from shiftlake.params import Params

__all__ = ["Params"]
__version__ = "0.1.0"
