"""Operators over tables of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import vectors as vx
from tidewell.operators.dataset import zscore_outliers


def norm_outliers(df: DataFrame, row_id: str, v: str, threshold: float = 3.0) -> DataFrame:
    """Vectors whose length stands out (MTH2)."""
    rows = df.filter(F.col(v).isNotNull()).select(row_id, vx.norm(F.col(v)).alias("norm"))
    return zscore_outliers(rows, "norm", threshold)


def first_vector_outliers(df: DataFrame, row_id: str, order=("audio", "text", "visual"), threshold: float = 3.0) -> DataFrame:
    """Outliers on the first available vector of each session (MTH19)."""
    picked = df.select(row_id, F.coalesce(*[F.col(c) for c in order]).alias("v"))
    return norm_outliers(picked, row_id, "v", threshold)


def train_scaled(df: DataFrame, v: str, split: str = "split", train: str = "train") -> DataFrame:
    """One mean and deviation over all training elements, applied to every row (MTH4)."""
    x = F.col(v).cast("array<double>")
    sums = df.filter(F.col(split) == train).select(
        F.size(v).alias("n"), vx.total(F.col(v)).alias("s"), vx.dot(F.col(v), F.col(v)).alias("q")
    ).agg((F.sum("s") / F.sum("n")).alias("_m"), (F.sum("q") / F.sum("n")).alias("_q"))
    stats = sums.select("_m", F.greatest(F.sqrt(F.greatest(F.col("_q") - F.col("_m") * F.col("_m"), F.lit(0.0))), F.lit(1e-8)).alias("_s"))
    return df.crossJoin(F.broadcast(stats)).withColumn("scaled", F.transform(x, lambda e: (e - F.col("_m")) / F.col("_s"))).drop("_m", "_s")


def dimension_stats(df: DataFrame, v: str) -> DataFrame:
    """Mean and deviation per dimension; one row per dimension."""
    return df.select(F.posexplode(v).alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.stddev_pop(F.col("x").cast("double")).alias("s"))


def dimension_scaled(df: DataFrame, v: str) -> DataFrame:
    """Per-dimension z-score (MTH5, MTH7). The broadcast row has one entry per dimension."""
    stats = dimension_stats(df, v).agg(F.array_sort(F.collect_list(F.struct("pos", "m", "s"))).alias("_stats"))
    rows = df.crossJoin(F.broadcast(stats))
    return rows.withColumn(
        "scaled", F.transform(F.col(v).cast("array<double>"), lambda x, i: (x - F.col("_stats")[i]["m"]) / (F.col("_stats")[i]["s"] + 1e-8))
    ).drop("_stats")


def batch_padded(df: DataFrame, batch: str, v: str) -> DataFrame:
    """Pad to the longest vector of the batch, with a mask (ARR1, ARR11)."""
    longest = df.groupBy(batch).agg(F.max(F.size(v)).alias("_len"))
    rows = df.join(longest, batch)
    return rows.withColumns({"padded": vx.padded(F.col(v), F.col("_len")), "mask": vx.mask(F.col(v), F.col("_len"))}).drop("_len")


def fused(df: DataFrame, participant: str = "participant_id", modality: str = "modality", v: str = "v", order: str = "path") -> DataFrame:
    """Concatenate one vector per modality of each participant; eight zeros if none (ARR5).

    The list per participant has at most one entry per modality.
    """
    first = df.groupBy(participant, modality).agg(F.min_by(v, order).alias("v"))
    joined = first.groupBy(participant).agg(F.sort_array(F.collect_list(F.struct(modality, "v"))).alias("_l"))
    flat = F.flatten(F.transform("_l", lambda e: e["v"]))
    zeros = F.array_repeat(F.lit(0.0).cast("float"), 8)
    return joined.select(participant, F.when(F.size(flat) > 0, flat).otherwise(zeros).alias("fused"))


def presence(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Modality flags of a session row (ARR3)."""
    return df.withColumn("modality_mask", F.create_map(*[x for k, c in columns.items() for x in (F.lit(k), F.col(c).isNotNull())]))


def pair_similarity(pairs: DataFrame, series: DataFrame, research: bool = False) -> DataFrame:
    """Cosine of the risk series of given user pairs (ARR9, JN16).

    ``pairs`` has ``a, b``; ``series`` has ``user_id, pos, n, risk``. Values meet by position, so no
    series becomes one array; unequal lengths give 0, a zero norm counts as 1. Comparing users needs
    the research flag.
    """
    if not research:
        raise PermissionError("comparing users needs research=True")
    sizes = series.groupBy("user_id").agg(F.max("n").alias("n"), F.sum(F.col("risk") * F.col("risk")).alias("q"))
    both = pairs.join(sizes.select(F.col("user_id").alias("a"), F.col("n").alias("na"), F.col("q").alias("qa")), "a").join(
        sizes.select(F.col("user_id").alias("b"), F.col("n").alias("nb"), F.col("q").alias("qb")), "b"
    )
    left = series.select(F.col("user_id").alias("a"), "pos", F.col("risk").alias("xa"))
    right = series.select(F.col("user_id").alias("b"), "pos", F.col("risk").alias("xb"))
    equal = both.filter("na = nb").select("a", "b")
    dots = equal.join(left, "a").join(right, ["b", "pos"]).groupBy("a", "b").agg(F.sum(F.col("xa") * F.col("xb")).alias("d"))

    def unit(q: str):
        return F.when(F.col(q) == 0, 1.0).otherwise(F.sqrt(q))

    return both.join(dots, ["a", "b"], "left").select(
        "a", "b", F.coalesce(F.col("d") / (unit("qa") * unit("qb")), F.lit(0.0)).alias("similarity")
    )


def principal_axes(df: DataFrame, v: str, k: int = 2) -> DataFrame:
    """Centred PCA projection (ARR10); each axis is signed so that its largest weight is positive."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.withColumn("_v", array_to_vector(F.col(v).cast("array<double>")))
    centred = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(rows).transform(rows)
    model = PCA(k=k, inputCol="_c", outputCol="_p").fit(centred)
    axes = model.pc.toArray()
    signs = [1.0 if axes[abs(axes[:, j]).argmax(), j] >= 0 else -1.0 for j in range(k)]
    out = model.transform(centred).withColumn("_a", vector_to_array("_p"))
    return out.select(*df.columns, *[(F.col("_a")[j] * F.lit(s)).alias(f"axis{j + 1}") for j, s in enumerate(signs)])
