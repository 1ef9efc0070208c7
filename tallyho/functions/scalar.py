"""Column-level helpers (F5-F16).  All are built-in Spark expressions, so they stay
inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_even(c, digits: int) -> Column:
    """Round the exact binary value half to even at ``digits`` decimals.

    Spark's ``bround`` rounds the shortest decimal text instead, so 2.675 (in binary
    just below) would become 2.68.  Here the scaled value's rounding error is taken
    into account (the product of the double's upper and lower halves with the scale
    is exact), so only true ties go to even.
    """
    x = col_(c).cast("double")
    scale = F.lit(float(10 ** digits))
    p = x * scale
    wide = x * F.lit(134217729.0)          # 2^27 + 1 splits the 53 bits in two
    high = wide - (wide - x)
    error = (high * scale - p) + (x - high) * scale
    below = F.floor(p).cast("double")
    rest = p - below
    up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & (below % 2.0 != 0))))
    plain = F.abs(x) < F.lit(2.0 ** 52 / 10 ** digits)   # beyond that there are no such decimals
    return F.when(plain, (below + F.when(up, F.lit(1.0)).otherwise(F.lit(0.0))) / scale).otherwise(x)


def fixed(c, digits: int, sign: bool = False) -> Column:
    """Text with ``digits`` decimals of the exact binary value, half to even."""
    return F.format_string(f"%{'+' if sign else ''}.{digits}f", round_half_even(c, digits))


def pct_diff(base, other, points: bool = False) -> Column:
    """``struct(abs_diff, pct_diff, base_zero)`` of ``other`` against ``base``.

    A base of 0 gives (0, 0); in percentage-point mode both fields are the
    plain difference.
    """
    b, o = col_(base).cast("double"), col_(other).cast("double")
    d = o - b
    zero = b == F.lit(0.0)
    pct = d if points else F.try_divide(d, b) * F.lit(100.0)
    return F.struct(F.when(zero, F.lit(0.0)).otherwise(d).alias("abs_diff"),
                    F.when(zero, F.lit(0.0)).otherwise(pct).alias("pct_diff"),
                    zero.alias("base_zero"))


def fmt_duration(seconds) -> Column:
    """Human duration: ``< 1`` -> ``"x.xx ms"``, ``< 60`` -> ``"x.xx s"``, else ``"Xm Y.YYs"``."""
    s = col_(seconds).cast("double")
    mins = F.floor(s / F.lit(60.0)).cast("bigint")
    rest = s - mins * F.lit(60.0)
    return (F.when(s < 1, F.concat(fixed(s * F.lit(1000.0), 2), F.lit(" ms")))
            .when(s < 60, F.concat(fixed(s, 2), F.lit(" s")))
            .otherwise(F.format_string("%dm %ss", mins, fixed(rest, 2))))


def fmt_comparison(value, diff, pct, unit: str = "") -> Column:
    """``"v (±d, ±p%)"`` with three decimals for values, two for percent (F8)."""
    sign = F.when(col_(diff) >= 0, F.lit("+")).otherwise(F.lit(""))
    u = unit.replace("%", "%%")
    return F.format_string(f"%s{u} (%s%s{u}, %s%s%%)", fixed(value, 3), sign, fixed(diff, 3), sign, fixed(pct, 2))


def yes_no(c) -> Column:
    """``"Yes"`` when the value equals 1, else ``"No"``."""
    return F.when(col_(c) == 1, F.lit("Yes")).otherwise(F.lit("No"))


def or_na(c) -> Column:
    """Value as text, ``"N/A"`` when missing."""
    return F.coalesce(col_(c).cast("string"), F.lit("N/A"))


def run_stamp(ts) -> Column:
    """Timestamp -> ``yyyyMMdd_HHmmss``."""
    return F.date_format(col_(ts), "yyyyMMdd_HHmmss")


def impact_direction(c) -> Column:
    """``positive`` when >= 0 else ``negative``."""
    return F.when(col_(c) >= 0, F.lit("positive")).otherwise(F.lit("negative"))


def model_label(c) -> Column:
    """Upper-case model name for headings (F16)."""
    return F.upper(col_(c))
