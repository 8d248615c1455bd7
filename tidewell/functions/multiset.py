"""Hash of a table's rows that does not depend on their order and follows added and removed rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES = 4
# hex digits a lane: 52 bits, so that sums over any number of rows stay far below 38 decimal digits
DIGITS = 13


def _field(name: str, kind: str) -> Column:
    """A field as text with its length before it, ``-`` if null; doubles count in units of 1e-9."""
    column = F.col(f"`{name}`")
    text = F.floor(column * 1e9 + 0.5).cast("string") if kind in ("double", "float") else column.cast("string")
    return F.when(column.isNull(), "-").otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text))


def row_digest(df: DataFrame, columns: Sequence[str]) -> Column:
    kinds = dict(df.dtypes)
    return F.sha2(F.concat(*[_field(c, kinds[c]) for c in columns]), 256)


def multiset_state(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``rows, lane_0 ...``: the sums of four parts of every row's SHA-256, as partial aggregates.

    Equal for any order and partitioning; repeated rows count as often as they stand. An empty table has zeros.
    """
    parts = [F.conv(F.substring("_d", 1 + DIGITS * k, DIGITS), 16, 10).cast("decimal(38,0)") for k in range(LANES)]
    zero = F.lit(0).cast("decimal(38,0)")
    return df.select(row_digest(df, columns).alias("_d")).agg(
        F.count("*").alias("rows"), *[F.coalesce(F.sum(p), zero).cast("decimal(38,0)").alias(f"lane_{k}") for k, p in enumerate(parts)])


def updated(state: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """The state after rows were added and removed, from the states of those rows alone; one row each."""
    cols = state.columns
    signed = state.withColumn("_s", F.lit(1))
    for other, sign in ((added, 1), (removed, -1)):
        if other is not None:
            signed = signed.unionByName(other.withColumn("_s", F.lit(sign)))
    return signed.agg(*[F.sum(F.col(c) * F.col("_s")).cast("long" if c == "rows" else "decimal(38,0)").alias(c) for c in cols])


def state_hash() -> Column:
    """One digest of a state's row."""
    return F.sha2(F.concat_ws(":", F.col("rows").cast("string"), *[F.col(f"lane_{k}").cast("string") for k in range(LANES)]), 256)
