"""Join of values with the bands that hold them, without comparing every value with every band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.session import reliable_checkpoint

# a table of bands up to this many rows is sent to every task as it is
BROADCAST_ROWS = 1024
# level of bands without a finite width
UNBOUNDED = 9999
#: Comparisons that a task makes at least, before there are ``MOST_TASKS`` tasks.
COMPARISONS = 2_000_000
MOST_TASKS = 1024


def _bin(value: Column, level: Column) -> Column:
    """Number of the bin of width 2^level; a power of two scales exactly, so order is kept."""
    return F.when(level == UNBOUNDED, F.lit(0).cast("long")).otherwise(F.floor(value / F.pow(F.lit(2.0), level)).cast("long"))


def _levelled(bands: DataFrame, low: str, high: str) -> DataFrame:
    """Each band with the level of the narrowest bins it cannot outgrow: it touches two of them, or three at most."""
    width = F.col(high).cast("double") - F.col(low).cast("double")
    fits = F.ceil(F.log2(width)).cast("int")
    # the logarithm may round down at a power of two, hence the comparison
    level = F.when(F.isnan(width) | (F.abs(width) == float("inf")), UNBOUNDED).when(width <= 2.0**-40, -40).otherwise(
        F.when(F.pow(F.lit(2.0), fits) < width, fits + 1).otherwise(fits))
    return bands.filter(F.col(low) <= F.col(high)).withColumn("_level", level.cast("int"))


def band_join(values: DataFrame, bands: DataFrame, value: str, low: str, high: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """All pairs of a value and a band with ``low <= value <= high`` (JN13).

    Up to ``broadcast_rows`` bands are counted and broadcast. Beyond, a band goes to the two or three bins of its own width
    that it touches and a value to its bin of each width in use, and they meet by an equi-join. Pairs grow with the product of both
    sides, which bytes do not tell, so the tasks go by the pairs that meet in the bins, and the values of a heavy bin are dealt in parts. Widths in use
    are powers of two, so there are few (a double has about 2,100). A band open at an end is compared with all values. Null
    values, bands with a null bound and inverted bands match nothing; repeated rows pair as often as they stand. The columns of
    the two sides must differ.
    """
    holds = (F.col(value) >= F.col(low)) & (F.col(value) <= F.col(high))
    if bands.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return values.join(F.broadcast(bands), holds)
    levelled = _levelled(bands, low, high)
    levels = [r["_level"] for r in levelled.select("_level").distinct().collect()]
    if not levels:
        return values.join(F.broadcast(bands.limit(0)), holds)
    ends = [_bin(F.col(c).cast("double"), F.col("_level")) for c in (low, high)]
    placed = levelled.withColumn("_bin", F.explode(F.sequence(*ends)))
    point = F.col(value).cast("double")
    cells = F.array(*[F.struct(F.lit(v).cast("int").alias("_level"), _bin(point, F.lit(v)).alias("_bin")) for v in levels])

    def placed_values(rows: DataFrame) -> DataFrame:
        return rows.filter(F.col(value).isNotNull()).withColumn("_cell", F.explode(cells)).select(*values.columns, "_cell._level", "_cell._bin")

    cell = ["_level", "_bin"]
    met = placed_values(values).groupBy(*cell).agg(F.count("*").alias("_v")).join(placed.groupBy(*cell).agg(F.count("*").alias("_b")), cell)
    met = reliable_checkpoint(met.select(*cell, (F.col("_v") * F.col("_b")).alias("_n")))
    total = met.agg(F.sum("_n")).first()[0] or 0
    tasks = min(max(1, total // COMPARISONS), MOST_TASKS)
    parts = met.select(*cell, F.ceil(F.col("_n") / F.lit(max(COMPARISONS, total // tasks))).alias("_parts"))
    key = [*cell, "_part"]
    # both sides are dealt out first, as a small file is one task's, which would repeat all its rows
    left = placed_values(values.repartition(tasks, *values.columns)).join(parts, cell).withColumn("_part", F.pmod(F.xxhash64(*values.columns), F.col("_parts"))).drop("_parts")
    right = placed.repartition(tasks, *bands.columns).join(parts, cell).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")
    return left.repartition(tasks, *key).join(right.repartition(tasks, *key), key).filter(holds).drop(*key)
