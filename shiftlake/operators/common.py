"""Small helpers shared by the operators: role lookup, top-k, checked joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftlake.functions.schema import KEY_COLUMNS, MISSING_TEXT, resolve_role
from shiftlake.params import Params
from shiftlake.session import shared_dir


def roles(df: DataFrame, params: Params) -> dict:
    ov = params.column_overrides
    return {r: resolve_role(df, r, ov) for r in (
        "orders", "hours", "cancelled", "cancelled_region", "idle", "cash",
        "notifications", "region", "first_login", "last_login",
    )}


def quoted(name: str) -> str:
    """A column name as it stands, dots and back-ticks included."""
    return "`" + name.replace("`", "``") + "`"


def metric(df: DataFrame, name: str | None) -> Column:
    """Metric column as double with NULL/NaN -> 0; absent column -> 0."""
    if name is None or name not in df.columns:
        return F.lit(0.0)
    c = F.col(quoted(name)).cast("double")
    return F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))


def text_or(df: DataFrame, name: str, default=MISSING_TEXT) -> Column:
    """``row.get(name, default)``: the default applies to an absent column only."""
    if name in df.columns:
        return F.col(quoted(name))
    return F.lit(default).cast("string")


def with_total_orders(df: DataFrame, params: Params) -> DataFrame:
    """Canonical ``total_orders``: the resolved orders column, else 0."""
    oc = roles(df, params)["orders"]
    if oc == "total_orders":
        return df
    return df.withColumn("total_orders", metric(df, oc) if oc else F.lit(0.0))


def tie_break(df: DataFrame) -> list[Column]:
    """Total order after the ranking metric: name, mobile, vehicle, date.

    pandas' stable sort / nlargest keep file order on ties; Spark has no row
    order, so ties are broken explicitly and identically in the SQL oracle.
    """
    return [F.col(c).asc_nulls_first() for c in KEY_COLUMNS[1:] + KEY_COLUMNS[:1] if c in df.columns]


def top_k(df: DataFrame, order: list[Column], k: int, by=(), rank_col: str = "rank") -> DataFrame:
    """Top ``k`` rows by ``order``, globally or per ``by`` group, with a 1-based rank.

    Global: ``orderBy().limit()`` plans as TakeOrderedAndProject (per-partition
    top-k, then a k x partitions merge). Per group: ``row_number() <= k``
    plans with a partial WindowGroupLimit *before* the shuffle, so a hot
    group ships at most k rows per map task.
    """
    if not by:
        lim = df.orderBy(*order).limit(k)
        # rank over at most k rows that survived the limit
        return lim.withColumn(rank_col, F.row_number().over(Window.orderBy(*order)))
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def ranked(df: DataFrame, order: list[Column], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """Number all rows from 1 in ``order``, which should tell every two different rows apart.

    The rows are range-partitioned by the whole order, so a value that many
    rows share is dealt out by the columns that break its ties, sorted inside
    the partitions and written once to the shared checkpoint folder with
    their place. Only the partitions' counts are added up in one task (a row
    per partition); they come back by a join on the partition.
    """
    shared_dir(df.sparkSession)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    part, at = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    rows = place.withColumn("_part", part).withColumn(name, at + 1).drop("_place").checkpoint(eager=True)
    sizes = rows.groupBy(F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_p", before.alias("_before"))
    return (rows.join(offsets, F.col("_part") == F.col("_p")).withColumn(name, F.col(name) + F.col("_before"))
            .drop("_part", "_p", "_before"))


def attach_group_stats(df: DataFrame, stats: DataFrame, by, params: Params) -> DataFrame:
    """Attach per-group aggregate columns of ``stats`` to the rows of ``df``.

    ``by=()``: ``stats`` is one row; each column is attached as a scalar
    subquery (computed once, injected as a value; no join). Otherwise the
    number of groups is counted first (on the checkpointed statistics): up
    to ``params.broadcast_max_rows``
    groups are broadcast; above that a shuffle join is used, where AQE's
    skew-join handling splits hot groups.
    """
    if not by:
        out = df
        for c in stats.columns:
            out = out.withColumn(c, stats.select(c).scalar())
        return out
    # computed once into the shared checkpoint folder: the count below and the
    # join read the stored rows, and a lost executor does not recompute them
    shared_dir(stats.sparkSession)
    stats = stats.checkpoint(eager=True)
    n = stats.count()
    # null-safe keys: a NULL group (e.g. rows without a Date) gets its own statistics
    keyed = stats.select(*[F.col(k).alias(f"_gk{i}") for i, k in enumerate(by)],
                         *[c for c in stats.columns if c not in by])
    side = F.broadcast(keyed) if n <= params.broadcast_max_rows else keyed
    cond = [df[k].eqNullSafe(keyed[f"_gk{i}"]) for i, k in enumerate(by)]
    return df.join(side, cond, "left").drop(*[f"_gk{i}" for i in range(len(by))])
