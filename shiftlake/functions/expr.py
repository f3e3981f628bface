"""Pure Column expressions shared by every operator.

Everything here returns a ``pyspark.sql.Column`` built from built-in
functions, so it stays inside whole-stage codegen (no Python UDFs).
"""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

from shiftlake.functions.schema import BUCKET_8_12, BUCKET_OVER_12, BUCKET_UNDER_8


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def rnd(x, n: int) -> Column:
    """Round to ``n`` decimals as Python's ``round`` does: to the nearest decimal of the exact binary value, half to even.

    The product ``p = x * 10^n`` is rounded itself; its error ``e`` is found
    by splitting both factors in halves whose products are exact. ``p`` is
    rounded to a whole number half to even, which is right unless ``p`` is a
    half and ``e`` tips it: the distance ``p - whole``, moved by one last place
    of a half in the direction of ``e``, is rounded once more. From 2^53 on (``p``) the value is its own nearest
    decimal. Negative zero becomes zero. There are only
    multiplications and sums, no branches and no text, so common parts are
    computed once and ten columns stay one small compiled method.
    """
    scale = float(10 ** n)
    split = float((1 << 27) + 1)
    high = scale * split - (scale * split - scale)  # halves of the scale, known here
    low = scale - high
    v = _c(x).cast("double")
    p = v * F.lit(scale)
    big = v * F.lit(split)
    v_high = big - (big - v)
    v_low = v - v_high
    e = v_high * F.lit(high) - p + v_low * F.lit(high)
    if low:  # 0 for small powers of ten
        e = e + v_high * F.lit(low) + v_low * F.lit(low)
    whole = F.rint(p)
    far = v * F.lit(sys.float_info.max / (1 << 53) * scale)  # infinite where p passes 2^53, else any number
    tipped = F.rint(p - whole + F.signum(e) * F.lit(2.0 ** -53))  # -1, 0 or 1
    out = (whole + tipped + (far - far)) / F.lit(scale)
    return F.nanvl(out, v)


def trunc_int(x) -> Column:
    """Python ``int(x)`` on a float: truncate toward zero, NaN/NULL -> 0."""
    c = _c(x).cast("double")
    return F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)).cast("bigint")


def num0(x) -> Column:
    """Numeric value with NULL and NaN mapped to 0.0 (pandas ``fillna(0)``)."""
    c = _c(x).cast("double")
    return F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))


def ratio_if_pos(num, den, scale: float = 1.0) -> Column:
    """``num / den * scale`` when ``den > 0`` else 0 (guarded ratio)."""
    n, d = _c(num), _c(den)
    v = n / d
    if scale != 1.0:
        v = v * F.lit(scale)
    return F.when(d > 0, v).otherwise(F.lit(0.0))


def pct_nonzero_den(num, den) -> Column:
    """``num / den * 100`` with NaN and +-inf mapped to 0 (den may be negative)."""
    n, d = _c(num), _c(den)
    return F.when(d != 0, n / d * F.lit(100.0)).otherwise(F.lit(0.0))


def exact_sum(x) -> Column:
    """Order-independent sum: add as decimal(18,4), return double.

    Floating-point addition is not associative, so a plain ``sum`` over
    doubles depends on partitioning. Summing fixed-point decimals is exact;
    the single cast back to double is the only rounding step.
    """
    return F.coalesce(F.sum(_c(x).cast("decimal(18,4)")), F.lit(0).cast("decimal(18,4)")).cast("double")


def hours_bucket(hours) -> Column:
    """Shift-duration bucket: <8, 8..12 inclusive, >12 (NULL hours count as 0)."""
    h = num0(hours)
    return (
        F.when(h < 8, F.lit(BUCKET_UNDER_8))
        .when(h <= 12, F.lit(BUCKET_8_12))
        .otherwise(F.lit(BUCKET_OVER_12))
    )


def change_class(change) -> Column:
    """Report direction class: strictly positive change is 'positive'."""
    return F.when(_c(change) > 0, F.lit("positive")).otherwise(F.lit("negative"))


def score_band(score) -> Column:
    return (
        F.when(_c(score) < 40, F.lit("negative"))
        .when(_c(score) < 60, F.lit("warning"))
        .otherwise(F.lit("positive"))
    )


def py_float_text(x) -> Column:
    """Text of a double as Python's ``str(float)`` prints it.

    Spark and Python agree below 1e7 ('30.0', '12.35'); from 1e7 up to 1e16
    Spark switches to scientific notation ('1.0E7') where Python keeps the
    positional form ('10000000.0'), which is rebuilt here from the exact
    decimal expansion of the shortest representation.
    """
    d = _c(x).cast("double")
    big = (F.abs(d) >= F.lit(1e7)) & (F.abs(d) < F.lit(1e16))
    positional = F.regexp_replace(
        F.regexp_replace(d.cast("decimal(38,10)").cast("string"), r"0+$", ""), r"\.$", ".0")
    return F.when(big, positional).otherwise(d.cast("string"))


def py_fixed(x, decimals: int, commas: bool = True, sign: bool = False) -> Column:
    """Python's fixed-point format: ``f'{x:,.Nf}'`` (``commas``), ``f'{x:.Nf}'``, ``f'{x:+.Nf}'`` (``sign``).

    ``format_number`` rounds the exact binary value half-even, as Python's
    formatter does (12.25 -> '12.2', 2.675 -> '2.67', -0.04 -> '-0.0').
    """
    t = F.format_number(_c(x).cast("double"), decimals)
    if not commas:
        t = F.regexp_replace(t, ",", "")
    if sign:
        t = F.when(t.startswith("-"), t).otherwise(F.concat(F.lit("+"), t))
    return t


def signed_1dp_text(x) -> Column:
    """``f'{x:+.1f}'`` exactly as Python prints it."""
    return py_fixed(x, 1, commas=False, sign=True)


def safe_corr(x, y) -> Column:
    """Pearson correlation that yields NULL instead of failing on constant input.

    ``corr`` raises DIVIDE_BY_ZERO under ANSI mode when a column is constant;
    the covariance / (sd * sd) form with ``try_divide`` returns NULL instead.
    """
    return F.try_divide(F.covar_samp(_c(x), _c(y)), F.stddev_samp(_c(x)) * F.stddev_samp(_c(y)))
