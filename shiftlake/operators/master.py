"""Master dataset: keep-last dedup, upsert, backfill, archive.

The master is a Parquet table partitioned by ``Date``. An upsert rewrites
only the partitions it touches (dynamic partition overwrite). Every row is
stored with its arrival version (batch, modification time, place in the
batch), and a merge keeps the greatest one by key, so batches may come in any
order and any number of times. The overwrite replaces partitions at commit:
a crash inside the commit may lose earlier rows of the touched Dates, which
the archive or a backfill then restores.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shiftlake.functions.schema import FILE_ORDER, KEY_COLUMNS
from shiftlake.params import Params

BATCH = "_batch"
SEQ = "_seq"
VERSION = "_version"  # stored with each master row
VERSION_TYPE = "struct<batch:bigint,mtime:bigint,pos:bigint>"


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """Concatenate by column name; columns missing on one side become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the one with the greatest ``order`` tuple.

    NULL key parts compare equal (a NULL group). Built as an aggregate
    (``max_by``), not a window: the partial aggregate runs before the
    shuffle, so a key with a huge number of copies ships one row per map
    task instead of landing whole in one task. Without keys, exact
    duplicate rows collapse (D2).
    """
    payload = [c for c in df.columns if c not in order]
    if not keys:
        return df.select(*[f"`{c}`" for c in payload]).distinct()
    packed = F.struct(*[F.col(f"`{c}`") for c in payload])
    ordk = F.struct(*[F.col(c) for c in order])
    agg = df.groupBy(*[F.col(k) for k in keys]).agg(F.max_by(packed, ordk).alias("_row"))
    return agg.select([F.col("_row")[c].alias(c) for c in payload])


def newest(df: DataFrame, keys: list[str], by_batch: bool = False) -> DataFrame:
    """One row per key (NULL parts compare equal): the one with the greatest VERSION.

    Orders by (mtime, pos), for rows of one batch, or by (batch, pos). Both
    are packed in one fixed-width number, so the aggregate over the keys is a
    hash aggregate of narrow rows; the wide rows then meet the greatest
    numbers in a semi-join. Numbers must differ between rows of a key.
    Without keys, exact duplicate rows collapse (D2).
    """
    if not keys:
        return df.dropDuplicates([c for c in df.columns if c != VERSION])
    version = F.col(VERSION)
    packed = (version["batch" if by_batch else "mtime"].cast("decimal(18,0)") * F.lit(1 << 62).cast("decimal(19,0)")
              + version["pos"].cast("decimal(19,0)")).cast("decimal(38,0)")
    rows = df.withColumn("_packed", packed)
    best = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max("_packed").alias("_best"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return rows.join(best, [*same, F.col("_packed") == F.col("_best")], "left_semi").drop("_packed")


def with_version(df: DataFrame) -> DataFrame:
    """Replace the arrival columns (BATCH, FILE_ORDER, SEQ) by VERSION."""
    pos = F.coalesce("_pos", SEQ) if "_pos" in df.columns else F.col(SEQ)
    mtime = F.coalesce(F.unix_micros(F.col("_mtime").cast("timestamp")), F.lit(0).cast("long")) if "_mtime" in df.columns else F.lit(0).cast("long")
    version = F.struct(F.col(BATCH).cast("long").alias("batch"), mtime.alias("mtime"), pos.cast("long").alias("pos"))
    return df.withColumn(VERSION, version).drop(BATCH, SEQ, *FILE_ORDER)


def dedup_keys(df: DataFrame) -> list[str]:
    return [c for c in KEY_COLUMNS if c in df.columns]


def with_arrival_order(df: DataFrame, batch_id: int) -> DataFrame:
    """Tag rows with (batch, position) at the source, before any shuffle.

    Rows read from files also carry ``_mtime``, ``_path``, ``_block`` (see
    ``sources.files``), which rank before the position; other frames are
    ordered by ``monotonically_increasing_id`` of their partitions.
    """
    out = df.withColumn(BATCH, F.lit(int(batch_id)).cast("bigint"))
    return out.withColumn(SEQ, F.monotonically_increasing_id())


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and len(fs.listStatus(p)) > 0


def write_by_date(df: DataFrame, path: str, mode: str = "overwrite", dynamic: bool = True) -> None:
    """Date-partitioned Parquet write, distributed by Date with a ``rebalance`` hint.

    AQE sizes the write tasks from the measured shuffle output: a hot Date
    is split over several tasks (several files), small Dates are packed
    together, and no task writes a file for every Date.
    """
    w = df.hint("rebalance", "Date").write.mode(mode)
    if dynamic:
        w = w.option("partitionOverwriteMode", "dynamic")
    w.partitionBy("Date").parquet(path)


def stored_master(spark: SparkSession, master_path: str) -> DataFrame:
    """The master with the columns of all its files and the version of every row (NULL where an earlier release wrote it)."""
    out = spark.read.option("mergeSchema", True).parquet(master_path)
    return out if VERSION in out.columns else out.withColumn(VERSION, F.lit(None).cast(VERSION_TYPE))


def read_master(spark: SparkSession, master_path: str) -> DataFrame:
    """The master with the columns of all its files: a column that came or went with a batch reads as NULL elsewhere."""
    return stored_master(spark, master_path).drop(VERSION)


def _touched(existing: DataFrame, dates: list, has_null: bool) -> DataFrame:
    """Existing master rows of the Dates the batch touches (NULL Date included): a literal filter on the partition column."""
    cond = F.col("Date").isin(dates) if dates else F.lit(False)
    return existing.where(cond | F.col("Date").isNull() if has_null else cond)


def upsert(master_path: str, batch: DataFrame, batch_id: int, params: Params | None = None) -> bool:
    """Merge a batch into the Date-partitioned master, keeping the greatest version per key (K1).

    The batch is tagged with its arrival order and checkpointed once into
    the shared checkpoint folder: it is computed a single time, its order
    is stable if an executor is lost later, and the same job observes its
    row count and the set of Dates it touches (one entry per calendar day).
    Only the touched Date partitions of the master are read (a literal
    partition filter, so the scan prunes directories) and rewritten
    (dynamic partition overwrite). An empty batch returns False and writes
    nothing.

    Only the batch can hold a key twice, so only the batch is aggregated.
    Master rows stay unless a null-safe join with the batch's keys and
    versions says that the batch's row is as new or newer; the batch's rows
    enter unless the master's keys and versions say that its row is newer.
    The same version again (a replay of one file) takes the incoming row.
    Rows of two files with one batch number are ordered by modification time.
    """
    spark = batch.sparkSession
    from shiftlake.session import shared_dir
    shared_dir(spark)  # make sure a checkpoint folder is registered
    seen = Observation("upsert_batch")
    staged = with_arrival_order(batch, batch_id).observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        F.collect_set("Date").alias("dates"),
        F.count_if(F.col("Date").isNull()).alias("null_dates"),
    ).checkpoint(eager=True)
    got = seen.get
    if int(got.get("rows", 0) or 0) == 0:
        return False
    fresh = with_version(staged)
    if _exists(spark, master_path):
        old = _touched(stored_master(spark, master_path), sorted(got["dates"] or []), int(got.get("null_dates", 0) or 0) > 0)
        old, fresh = _with_keys_of(old, fresh), _with_keys_of(fresh, old)
    else:
        old = None
    keys = dedup_keys(fresh)
    if old is None:
        out = newest(fresh, keys)
    elif not keys:
        out = newest(union_by_name([old, fresh]), keys)
    else:
        out = newest(fresh, keys)
        out = union_by_name([_without(old, out, keys, _older), _without(out, old, keys, _newer_there)])
    write_by_date(out, master_path)
    return True


def _with_keys_of(df: DataFrame, other: DataFrame) -> DataFrame:
    """``df`` with NULL in the key columns that only ``other`` has."""
    return df.withColumns({c: F.lit(None).cast(other.schema[c].dataType) for c in dedup_keys(other) if c not in df.columns})


def _order(version):
    return F.struct(version["batch"], version["mtime"])


def _older(mine, theirs):
    return mine.isNull() | (_order(theirs) >= _order(mine))


def _newer_there(mine, theirs):
    return theirs.isNotNull() & (_order(theirs) > _order(mine))


def _without(rows: DataFrame, others: DataFrame, keys: list[str], replaced) -> DataFrame:
    """``rows`` without those that a row of ``others`` with the same key (NULL parts compare equal) replaces."""
    side = others.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(VERSION).alias("_other"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return rows.join(side, [*same, replaced(F.col(VERSION), F.col("_other"))], "left_anti")


def build_master(frames: list[DataFrame], master_path: str) -> DataFrame | None:
    """Backfill: union many batches (later batches win), dedup, full overwrite (K2)."""
    if not frames:
        return None
    tagged = [f if BATCH in f.columns else with_arrival_order(f, i) for i, f in enumerate(frames)]
    combined = with_version(union_by_name(tagged))
    keys = dedup_keys(combined)
    if all("_pos" in f.columns for f in tagged):
        out = newest(combined, keys, by_batch=True)
    else:  # places given by a running id, which a second reading may change
        out = keep_last(combined.withColumn("_order", F.col(VERSION)), keys, ["_order"])
    write_by_date(out, master_path, dynamic=False)
    return read_master(out.sparkSession, master_path)


def archive_snapshot(raw: DataFrame, archive_root: str, snapshot_date=None) -> None:
    """Store raw rows under ``snapshot_date=yyyyMMdd`` (K3).

    ``snapshot_date`` given: every row goes to that partition; otherwise
    each row's own Date names it. A rerun replaces the same partitions.
    """
    tag = (F.lit(snapshot_date) if snapshot_date is not None
           else F.date_format(F.col("Date"), "yyyyMMdd"))
    (raw.drop(*FILE_ORDER).withColumn("snapshot_date", tag.cast("string")).hint("rebalance", "snapshot_date")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(archive_root))
