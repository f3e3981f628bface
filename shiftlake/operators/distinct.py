"""Distinct counts that merge (A5, A7): exact bitmaps per Date over dense ids, so any span of dates is an OR."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlake.operators.common import quoted, ranked


def dense_ids(df: DataFrame, column: str) -> DataFrame:
    """(value, id): the different non-NULL values, numbered from 1 without gaps in their order."""
    values = df.select(F.col(quoted(column)).alias("value")).where("value is not null").distinct()
    return ranked(values, [F.col("value")], "id")


def daily_bitmaps(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """(Date, bucket, bitmap): which ids occur on a date, 32,768 of them per bitmap. NULL dates are a group."""
    seen = df.select("Date", F.col(quoted(column)).alias("value")).where("value is not null").distinct()
    known = seen.join(ids, "value")
    return known.groupBy("Date", F.bitmap_bucket_number("id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bitmap"))


def unique_in_windows(bitmaps: DataFrame, windows=(1, 7)) -> DataFrame:
    """Date, unique_1d, unique_7d, ...: distinct values over the calendar days that end with each Date that has rows."""
    dated = bitmaps.where(F.col("Date").isNotNull())
    spans = F.explode(F.array(*[F.lit(w) for w in windows]))
    moved = (dated.withColumn("span", spans).withColumn("ahead", F.explode(F.sequence(F.lit(0), F.col("span") - 1)))
             .select(F.date_add("Date", F.col("ahead")).alias("end"), "span", "bucket", "bitmap"))
    days = dated.select(F.col("Date").alias("end")).distinct()
    merged = moved.join(days, "end", "left_semi").groupBy("end", "span", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    count = F.bitmap_count("bitmap")
    return merged.groupBy(F.col("end").alias("Date")).agg(
        *[F.sum(F.when(F.col("span") == w, count).otherwise(0)).alias(f"unique_{w}d") for w in windows])
