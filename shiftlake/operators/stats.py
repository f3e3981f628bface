"""Exact median per group without gathering a group in one task.

Spark's built-in ``median`` keeps every distinct value of a group in one
aggregation buffer, so a hot group (one metric over the whole fleet, or a
day holding a third of all rows) ends up whole in one task. Here:

1. per group: count ``n`` and a bracket around rank n/2 from a KLL sketch (a
   mergeable sketch of bounded memory, partially aggregated), in the same
   aggregate as any further figures;
2. a second pruned scan makes a histogram per group: one row counting the
   values below the bracket, one counting those above, one row per distinct
   value inside (a partial aggregate, so duplicates collapse map-side). If
   the counts say that a middle rank lies outside, that side of the bracket
   is opened and the scan repeated, so a poor sketch costs time only;
3. while some group still has more than ``max_distinct`` distinct values
   inside its bracket, the bracket is cut into BUCKETS equal-width buckets
   (spanning the data's own min / max inside it) and narrowed to the
   bucket(s) holding the middle ranks; values are compared by bucket label,
   so no value falls between buckets;
4. a cumulative count over the few remaining rows per group finds the
   values at ranks floor((n-1)/2) and ceil((n-1)/2); the median
   interpolates them as Spark's ``median`` does.

Only brackets and histograms (a few rows per group) are checkpointed; the
input is read again instead of being copied. The loops decide on one number
per round, so they run on Spark; the driver never sees the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftlake.operators.common import attach_group_stats
from shiftlake.params import Params
from shiftlake.session import shared_dir

SKETCH_K = 8192
MARGIN = 0.002  # of the ranks, on either side of the middle: about three times the sketch's usual error
BUCKETS = 4096
MAX_DISTINCT = 100_000  # candidates of a group that are ranked without narrowing first

BELOW, INSIDE, ABOVE = 0, 1, 2


def _narrow(hist: DataFrame, keys: list[str], params: Params) -> DataFrame:
    """One refinement round over (keys, _n, _side, _v, _c) histogram rows.

    Every step is an aggregate or a join with one row per group; windows
    only run over the at most BUCKETS + 2 bucket rows of a group.
    """
    inside = F.col("_side") == INSIDE
    span = hist.where(inside).groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    h = attach_group_stats(hist, span, keys, params)
    width = F.col("_hi") - F.col("_lo")
    bucket = (F.when(F.col("_side") == BELOW, F.lit(-1))
              .when(F.col("_side") == ABOVE, F.lit(BUCKETS))
              .when(width > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / width * BUCKETS), F.lit(BUCKETS - 1)))
              .otherwise(F.lit(0))).cast("int")
    h = h.withColumn("_b", bucket)
    b = h.groupBy(*keys, "_n", "_b").agg(F.sum("_c").alias("_bc"))
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("_before", F.coalesce(F.sum("_bc").over(w), F.lit(0)))
    k_lo, k_hi = F.floor((F.col("_n") - 1) / 2), F.ceil((F.col("_n") - 1) / 2)
    holds = lambda k: (F.col("_before") <= k) & (k < F.col("_before") + F.col("_bc"))
    keep = b.groupBy(*keys).agg(
        F.min(F.when(holds(k_lo), F.col("_b"))).alias("_b1"),
        F.max(F.when(holds(k_hi), F.col("_b"))).alias("_b2"))
    j = attach_group_stats(h, keep, keys, params)
    side = (F.when(F.col("_b") < F.col("_b1"), F.lit(BELOW))
            .when(F.col("_b") > F.col("_b2"), F.lit(ABOVE)).otherwise(F.lit(INSIDE)))
    return j.groupBy(*keys, "_n", side.alias("_side"), F.when(side == INSIDE, F.col("_v")).alias("_v")).agg(
        F.sum("_c").alias("_c"))


def exact_median(long: DataFrame, keys: list[str], value: str = "value", params: Params | None = None,
                 out: str = "median", extra: list | None = None, max_distinct: int = MAX_DISTINCT) -> DataFrame:
    """(keys..., median[, extra...]) for every group of ``long`` with a non-null value.

    ``extra``: further aggregate columns over ``_x`` (the value as double),
    computed in the same first pass as the sketch.
    """
    params = params or Params()
    spark = long.sparkSession
    shared_dir(spark)
    base = long.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x"))
    x = F.col("_x")
    stats = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.kll_sketch_agg_double(x, F.lit(SKETCH_K)).alias("_sketch"), *(extra or []))
    extras = [c for c in stats.columns if c not in (*keys, "_n", "_sketch")]
    ends = [F.kll_sketch_get_quantile_double("_sketch", F.lit(min(1.0, max(0.0, 0.5 + m)))) for m in (-MARGIN, MARGIN)]
    # one row per group, stored once: brackets and further figures are read from here
    stats = stats.select(*keys, "_n", ends[0].alias("_lo"), ends[1].alias("_hi"), *extras).checkpoint(eager=True)
    brackets = stats.select(*keys, "_n", "_lo", "_hi")
    k_lo, k_hi = F.floor((F.col("_n") - 1) / 2), F.ceil((F.col("_n") - 1) / 2)
    while True:
        tagged = attach_group_stats(base, brackets, keys, params)
        side = F.when(x < F.col("_lo"), BELOW).when(x > F.col("_hi"), ABOVE).otherwise(INSIDE)
        hist = tagged.groupBy(*keys, "_n", side.alias("_side"), F.when(side == INSIDE, x).alias("_v")).agg(
            F.count(F.lit(1)).alias("_c")).checkpoint(eager=True)
        counted = hist.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("_side") == z, F.col("_c"))), F.lit(0)).alias(name)
                                            for z, name in ((BELOW, "_below"), (ABOVE, "_above"))])
        judged = attach_group_stats(brackets, counted, keys, params)
        low, high = k_lo < F.col("_below"), k_hi >= F.col("_n") - F.col("_above")
        if judged.where(low | high).limit(1).count() == 0:
            break
        # a side that missed its rank is opened
        brackets = judged.select(*keys, "_n", F.when(low, F.lit(float("-inf"))).otherwise(F.col("_lo")).alias("_lo"),
                                 F.when(high, F.lit(float("inf"))).otherwise(F.col("_hi")).alias("_hi")).checkpoint(eager=True)
    before = None
    while True:
        widest = (hist.where(F.col("_side") == INSIDE).groupBy(*keys).count()
                  .agg(F.max("count")).first()[0])
        if widest is None or widest <= max_distinct or widest == before:
            break
        hist, before = _narrow(hist, keys, params).checkpoint(eager=True), widest
    w = Window.partitionBy(*keys).orderBy("_side", "_v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = hist.withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    inside = lambda k: (F.col("_side") == INSIDE) & (F.col("_before") <= k) & (k < F.col("_before") + F.col("_c"))
    res = ranked.groupBy(*keys).agg(
        F.max(F.when(inside(k_lo), F.col("_v"))).alias("_vlo"),
        F.max(F.when(inside(k_hi), F.col("_v"))).alias("_vhi"),
    )
    res = res.select(*keys, (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.lit(0.5)).alias(out))
    if extras:
        # both sides hold one row per group
        ex = stats.select(*[F.col(k).alias(f"_ek{i}") for i, k in enumerate(keys)], *extras)
        cond = [res[k].eqNullSafe(ex[f"_ek{i}"]) for i, k in enumerate(keys)]  # NULL groups match
        res = res.join(ex, cond, "left").drop(*[f"_ek{i}" for i in range(len(keys))])
    return res
