"""Filter, clean and project the raw driver-day rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftlake.functions.schema import CANONICAL_TYPES, KEY_COLUMNS, ROLE_FALLBACK_NAMES, is_numeric_name
from shiftlake.operators.common import metric, quoted, roles, text_or, with_total_orders
from shiftlake.functions.schema import FILE_ORDER
from shiftlake.params import Params

# Fixed parsing patterns: a plain decimal number (pandas.to_numeric rejects
# thousands separators and unit suffixes such as '5f'), and the date /
# timestamp layouts accepted for text input, tried in order.
NUMERIC_TEXT = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
DATE_FORMATS = ["yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy", "dd/MM/yyyy", "yyyy-MM-dd HH:mm:ss"]
# Layouts that a file's Dates are tried in; of equal ones the first is taken.
VOTED_FORMATS = ["yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy", "MM-dd-yyyy", "dd/MM/yyyy", "MM/dd/yyyy", "dd.MM.yyyy", "yyyy-MM-dd HH:mm:ss"]
TIMESTAMP_FORMATS = [
    "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "dd-MM-yyyy HH:mm:ss", "dd/MM/yyyy HH:mm:ss",
]
_WS = r"^\s+|\s+$"

NUMERIC_TYPES = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType, T.DecimalType)


def filter_vehicle(df: DataFrame, exclude: str | None, observation: Observation | None = None) -> DataFrame:
    """Drop rows of one vehicle category; rows with a NULL category are kept.

    ``NOT (vehicle_type <=> x)`` keeps NULLs as pandas' ``!=`` does (plain
    ``<>`` would drop them). Absent column -> no-op. With an ``Observation``
    the kept / removed counts are collected by the same job (no extra scan).
    """
    if exclude is None or "vehicle_type" not in df.columns:
        return df
    drop = F.col("vehicle_type").eqNullSafe(F.lit(exclude))
    if observation is not None:
        df = df.observe(
            observation,
            F.count(F.lit(1)).alias("rows_in"),
            F.count_if(drop).alias("rows_removed"),
        )
    return df.where(~drop)


def numeric_text(c: Column) -> Column:
    """Text -> double the way pandas.to_numeric(errors='coerce') reads it; else NULL."""
    t = F.regexp_replace(c.cast("string"), _WS, "")
    return F.when(t.rlike(NUMERIC_TEXT), t.cast("double"))


def _parse_any(c: Column, formats: list[str], to_date: bool) -> Column:
    t = F.regexp_replace(c.cast("string"), _WS, "")
    parsed = [F.try_to_timestamp(t, F.lit(f)) for f in formats]
    ts = F.coalesce(*parsed)
    return F.to_date(ts) if to_date else ts.cast("timestamp_ntz")


def clean_driver_day(df: DataFrame, params: Params | None = None) -> DataFrame:
    """Type and clean one or many days of driver rows.

    Date -> DateType (bad -> NULL); strings trimmed (leading/trailing
    whitespace of any kind); known canonical numerics and any column whose
    name matches a numeric pattern coerced to double (bad text -> NULL);
    every numeric NULL/NaN -> 0. Optional ``drop_empty_rows`` removes rows
    whose every column is NULL, before filling.
    """
    params = params or Params()
    types = dict(df.dtypes)
    exprs = []
    for name in df.columns:
        c, dt = F.col(quoted(name)), types[name]
        want = CANONICAL_TYPES.get(name)
        if name == "Date":
            if dt == "date":
                e = c
            elif dt.startswith("timestamp"):
                e = F.to_date(c)
            else:
                e = _parse_any(c, DATE_FORMATS, to_date=True)
        elif dt == "string" and isinstance(want, T.TimestampNTZType):
            e = _parse_any(c, TIMESTAMP_FORMATS, to_date=False)
        elif dt == "string" and (isinstance(want, T.DoubleType) or is_numeric_name(name)):
            e = numeric_text(c)
        elif dt == "string":
            e = F.regexp_replace(c, _WS, "")
            if params.null_as_text:
                e = F.coalesce(e, F.lit("nan"))
        elif is_numeric_name(name) and dt not in ("double", "float"):
            e = c.cast("double")
        else:
            e = c
        exprs.append(e.alias(name))
    out = df.select(*exprs)
    if params.drop_empty_rows:
        out = drop_empty_rows(out)
    fills = [f.name for f in out.schema.fields if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in FILE_ORDER]
    if fills:
        out = out.select(*[
            (F.coalesce(F.nanvl(F.col(quoted(n)), F.lit(0.0)), F.lit(0.0)).alias(n)
             if n in fills and isinstance(out.schema[n].dataType, (T.DoubleType, T.FloatType))
             else (F.coalesce(F.col(quoted(n)), F.lit(0).cast(out.schema[n].dataType)).alias(n) if n in fills else F.col(quoted(n))))
            for n in out.columns
        ])
    return out


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Remove rows whose every data column is NULL (run before filling); the file order columns of a scan are not data."""
    return df.na.drop(how="all", subset=[f"`{c}`" for c in df.columns if c not in FILE_ORDER])


def date_layouts(df: DataFrame) -> DataFrame:
    """A row per file of a scan with a text Date: the layout that most of its cells fit.

    (_path, layout, votes, cells, ambiguous). On a tie the first of
    VOTED_FORMATS is taken (day before month) and the file is marked
    ambiguous; layout is NULL where no cell fits any.
    """
    t = F.regexp_replace(F.col("Date"), _WS, "")
    votes = df.groupBy("_path").agg(F.count_if(t != "").alias("cells"), *[
        F.count_if(F.try_to_timestamp(t, F.lit(f)).isNotNull()).alias(f"v{i}") for i, f in enumerate(VOTED_FORMATS)])
    most = F.greatest(*[F.col(f"v{i}") for i in range(len(VOTED_FORMATS))])
    layout = F.coalesce(*[F.when((F.col(f"v{i}") == most) & (most > 0), F.lit(f)) for i, f in enumerate(VOTED_FORMATS)])
    winners = sum(((F.col(f"v{i}") == most).cast("int") for i in range(len(VOTED_FORMATS))), F.lit(0))
    return votes.select("_path", layout.alias("layout"), most.alias("votes"), "cells", ((most > 0) & (winners > 1)).alias("ambiguous"))


def read_dates(df: DataFrame) -> DataFrame:
    """Text Dates of a file scan, each read in its file's layout; a cell that does not fit stays for the fixed list."""
    if "_path" not in df.columns or dict(df.dtypes).get("Date") != "string":
        return df
    layouts = date_layouts(df).select(F.col("_path").alias("_file"), F.col("layout").alias("_layout"))
    t = F.regexp_replace(F.col("Date"), _WS, "")
    voted = F.coalesce(*[F.when(F.col("_layout") == f, F.try_to_timestamp(t, F.lit(f))) for f in VOTED_FORMATS])
    date = F.coalesce(F.to_date(voted), _parse_any(F.col("Date"), DATE_FORMATS, to_date=True))
    joined = df.join(layouts, F.col("_path") == F.col("_file"), "left")
    return joined.select(*[date.alias(c) if c == "Date" else F.col(quoted(c)) for c in df.columns])


def prepare(df: DataFrame, params: Params) -> DataFrame:
    """Clean, then filter once (trim first so padded categories are caught). Dates of files follow each file's layout."""
    df = read_dates(df)
    return filter_vehicle(clean_driver_day(df, params), params.exclude_vehicle_type)


def canonical_metrics(df: DataFrame, params: Params) -> DataFrame:
    """Resolved role columns under canonical names, numeric roles coerced to 0."""
    r = roles(df, params)
    d = with_total_orders(df, params)

    def role_num(role):
        name = r[role] or ROLE_FALLBACK_NAMES.get(role)
        return metric(d, name)

    region = r["region"] or ROLE_FALLBACK_NAMES["region"]
    first = r["first_login"]
    return d.select(
        *[text_or(d, k, None).alias(k) if k != "Date" else F.col("Date") for k in KEY_COLUMNS if k in d.columns],
        F.col("total_orders").cast("double").alias("total_orders"),
        role_num("cash").alias("cash"),
        role_num("notifications").alias("notifications"),
        role_num("hours").alias("hours"),
        (F.col(quoted(region)) if region in d.columns else F.lit(None).cast("string")).alias("region"),
        (F.col(quoted(first)).cast("timestamp_ntz") if first else F.lit(None).cast("timestamp_ntz")).alias("first_login"),
    )


def with_cancellation_rate(df: DataFrame, params: Params) -> DataFrame:
    """cancellation_rate = cancelled / orders * 100; NaN and +-inf -> 0."""
    d = with_total_orders(df, params)
    cc = roles(d, params)["cancelled"]
    if cc is None:
        return d.withColumn("cancellation_rate", F.lit(0.0))
    den = F.col("total_orders")
    return d.withColumn(
        "cancellation_rate",
        F.when(den != 0, metric(d, cc) / den * F.lit(100.0)).otherwise(F.lit(0.0)),
    )
