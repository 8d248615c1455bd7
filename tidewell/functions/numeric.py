"""Small numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def rounded(value: Column | str, places: int = 4) -> Column:
    """Round half up at ``places`` digits with plain double arithmetic.

    ``F.round`` goes through decimals, whose treatment of ties differs between engines. The small
    excess over one half lets an exact tie round up whatever the last bit of the sum behind it.
    """
    scale = float(10**places)
    half = 0.5000001 if places < 7 else 0.501
    return F.floor(as_col(value) * F.lit(scale) + F.lit(half)) / F.lit(scale)


def r4(value: Column | str) -> Column:
    return rounded(value, 4)


def r9(value: Column | str) -> Column:
    return rounded(value, 9)


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom`` and 0 where the divisor is 0 or null."""
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(0.0))


def exact_mean(value: Column | str) -> Column:
    """Mean of decimal figures kept as doubles (probabilities, shares): the same in any order of the rows.

    A sum of doubles depends on how the rows were dealt, so a mean of one half may fall below one half. The
    figures are added as decimals of 18 digits after the point; figures that are no such decimal (NaN, infinite or
    1e10 and above) are left to the plain mean.
    """
    col = as_col(value).cast("double")
    exact = col.try_cast("decimal(28,18)")
    mean = F.sum(exact) / F.count(exact)
    return F.when(F.count(exact) == F.count(col), mean.cast("double")).otherwise(F.avg(col))


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def blank_or_zero(value: Column | str, default: float) -> Column:
    """Null, NaN and 0 all become ``default`` (PRJ14)."""
    col = as_col(value)
    missing = col.isNull() | F.isnan(col.cast("double")) | (col == 0)
    return F.when(missing, F.lit(default)).otherwise(col)


def number_text(value: Column | str) -> Column:
    """A double in the digits a reader expects: 0.00015, not 1.5E-4; beyond 1e-4 and 1e16 as 5e-05 and 1e+16."""
    col = as_col(value).cast("double")
    short = col.cast("string")
    size = F.abs(col)
    plain = F.regexp_replace(col.try_cast("decimal(38,21)").cast("string"), r"(\.[0-9]+?)0+$", "$1")
    parts = F.split(short, "E")
    power = F.get(parts, F.lit(1))
    bare = F.replace(power, F.lit("-"), F.lit(""))
    digits = F.when(F.length(bare) > 2, bare).otherwise(F.lpad(bare, 2, "0"))
    sign = F.when(power.startswith("-"), "-").otherwise("+")
    tiny = F.concat(F.regexp_replace(F.get(parts, F.lit(0)), r"\.0$", ""), F.lit("e"), sign, digits)
    return F.when(~short.contains("E"), short).when((size >= 1e-4) & (size < 1e16), plain).otherwise(tiny)


def seconds(ts: Column | str) -> Column:
    """Seconds since the epoch as a double, microseconds kept."""
    return F.unix_micros(as_col(ts).cast("timestamp")) / F.lit(1e6)


def micros(ts: Column | str) -> Column:
    return F.unix_micros(as_col(ts).cast("timestamp"))


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Whole days between two timestamps (rounded down)."""
    return F.floor((micros(later) - micros(earlier)) / F.lit(86400e6)).cast("long")


def let(value: Column, use) -> Column:
    """Bind a costly expression once and use it several times.

    An expression used inside a lambda is evaluated again for every element; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), use), 0)
