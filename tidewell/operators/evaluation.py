"""Classifier and regression metrics as aggregates over a table of scored rows.

Input columns: ``label`` (below 0 = unlabelled, dropped), ``pred`` and ``score`` (probability of
class 1). Curves are computed over distinct scores with distributed running totals.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.numeric import ratio
from tidewell.operators.ordered import SLICE_ROWS, exact_quantiles, running_totals
from tidewell.schemas import ERROR_ADVICE, MODALITIES, VARIANTS, VARIANTS_DDL


def labelled(df: DataFrame) -> DataFrame:
    return df.filter(F.col("label") >= 0)


def _counts() -> list[Column]:
    p, y = F.col("pred"), F.col("label")
    return [
        F.count_if((p == 1) & (y == 1)).cast("double").alias("tp"),
        F.count_if((p == 1) & (y == 0)).cast("double").alias("fp"),
        F.count_if((p == 0) & (y == 1)).cast("double").alias("fn"),
        F.count_if((p == 0) & (y == 0)).cast("double").alias("tn"),
        F.count("*").cast("double").alias("support"),
        F.avg((p == y).cast("double")).alias("accuracy"),
    ]


def classification(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy to Cohen's kappa from one pass over the rows (EV1, EV2)."""
    agg = labelled(df).groupBy(*(by or [])).agg(*_counts())
    tp, fp, fn, tn, n = (F.col(c) for c in ("tp", "fp", "fn", "tn", "support"))
    precision, recall, specificity = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fp)
    f1 = ratio(2 * precision * recall, precision + recall)
    f1_neg = ratio(2 * tn, 2 * tn + fn + fp)
    f1_pos = ratio(2 * tp, 2 * tp + fn + fp)
    root = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    expected = ratio((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    return agg.select(
        *(by or []),
        "support", "accuracy",
        ((recall + specificity) / 2).alias("balanced_accuracy"),
        precision.alias("precision"), recall.alias("recall"), specificity.alias("specificity"), f1.alias("f1"),
        (1 - (recall + specificity) / 2).alias("balanced_error_rate"),
        ratio(f1_pos * (tp + fn) + f1_neg * (tn + fp), n).alias("weighted_f1"),
        ((f1_pos + f1_neg) / 2).alias("macro_f1"),
        F.col("accuracy").alias("micro_f1"),
        ratio(tp * tn - fp * fn, root).alias("mcc"),
        ratio(F.col("accuracy") - expected, 1 - expected).alias("cohen_kappa"),
    )


def score_counts(df: DataFrame) -> DataFrame:
    """Positives and negatives per distinct score."""
    return labelled(df).groupBy("score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )


def cumulated(df: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Distinct scores from high to low with counts at or above each, and the totals."""
    counts = score_counts(df)
    totals = counts.agg(F.sum("pos").cast("double").alias("all_pos"), F.sum("neg").cast("double").alias("all_neg"))
    rows = running_totals(counts, "score", ["pos", "neg"], descending=True, slice_rows=slice_rows)
    return rows.crossJoin(F.broadcast(totals)).selectExpr(
        "score", "pos", "neg", "pos_before", "neg_before", "pos_before + pos AS tp", "neg_before + neg AS fp", "all_pos", "all_neg"
    )


def roc_auc(df: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Rank-sum AUC with ties halved (EV3)."""
    rows = cumulated(df, slice_rows)
    wins = F.sum(F.col("pos") * (F.col("all_neg") - F.col("neg_before") - F.col("neg") + F.col("neg") / 2.0))
    return rows.agg(ratio(wins, F.max("all_pos") * F.max("all_neg")).alias("roc_auc"))


def roc_points(df: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    return cumulated(df, slice_rows).selectExpr(
        "score AS threshold", "fp / nullif(all_neg, 0) AS fpr", "tp / nullif(all_pos, 0) AS tpr"
    )


def pr_points(df: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    return cumulated(df, slice_rows).selectExpr(
        "score AS threshold", "CAST(tp AS DOUBLE) / (tp + fp) AS precision", "tp / nullif(all_pos, 0) AS recall"
    )


def average_precision(df: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Sum of precision times the gain in recall (EV5)."""
    gain = F.col("pos") / F.col("all_pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))
    return cumulated(df, slice_rows).agg(F.sum(gain).alias("average_precision"))


def probability_losses(df: DataFrame, floor: float = 2.220446049250313e-16) -> DataFrame:
    """Log loss with clipped probabilities, and the Brier score (EV6)."""
    p = F.greatest(F.lit(floor), F.least(F.lit(1.0 - floor), F.col("score")))
    y = F.col("label")
    return labelled(df).agg(
        F.avg(-F.when(y == 1, F.log(p)).otherwise(F.log(1.0 - p))).alias("log_loss"),
        F.avg((F.col("score") - y) * (F.col("score") - y)).alias("brier_score"),
    )


def per_class(df: DataFrame) -> DataFrame:
    """One-versus-rest figures per class (EV7), from the confusion counts only."""
    cells = labelled(df).groupBy("pred", "label").agg(F.count("*").cast("double").alias("n"))
    actual = cells.groupBy(F.col("label").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("pred") == F.col("label"), F.col("n")).otherwise(0.0)).alias("tp"))
    guessed = cells.groupBy(F.col("pred").alias("class")).agg(F.sum("n").alias("guessed"))
    total = cells.agg(F.sum("n").alias("total"))
    rows = actual.join(guessed, "class", "left").crossJoin(F.broadcast(total))
    fp = F.coalesce("guessed", F.lit(0.0)) - F.col("tp")
    tn = F.col("total") - F.col("support") - fp
    return rows.select(
        "class", ratio(F.col("tp"), F.col("tp") + fp).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(tn, tn + fp).alias("specificity"), "support",
    )


def confusion(df: DataFrame) -> DataFrame:
    """Full class grid with shares by predicted row, actual column and total (EV8)."""
    cells = labelled(df).groupBy("pred", "label").agg(F.count("*").alias("n"))
    classes = cells.select(F.col("pred").alias("c")).union(cells.select("label")).distinct()
    grid = classes.select(F.col("c").alias("pred")).crossJoin(F.broadcast(classes.select(F.col("c").alias("label"))))
    full = grid.join(cells, ["pred", "label"], "left").selectExpr("pred", "label", "coalesce(n, 0) AS n")
    return full.selectExpr(
        "pred", "label", "n",
        "n / greatest(sum(n) OVER (PARTITION BY pred), 1) AS row_share",
        "n / greatest(sum(n) OVER (PARTITION BY label), 1) AS column_share",
        "n / greatest(sum(n) OVER (), 1) AS share",
    )


def calibration_bins(df: DataFrame, bins: int = 10) -> DataFrame:
    """Accuracy and confidence per bin (lo, hi]; confidence is that of the likelier class."""
    conf = F.greatest(F.col("score"), 1.0 - F.col("score"))
    guess = F.when(F.col("score") > 0.5, 1).otherwise(0)
    rows = labelled(df).select(conf.alias("c"), (guess == F.col("label")).cast("double").alias("ok"))
    return rows.filter("c > 0").groupBy((F.ceil(F.col("c") * bins) - 1).cast("long").alias("bin")).agg(
        F.count("*").alias("n"), F.avg("ok").alias("accuracy"), F.avg("c").alias("confidence")
    )


def calibration_error(df: DataFrame, bins: int = 10) -> DataFrame:
    gap = F.abs(F.col("accuracy") - F.col("confidence"))
    total = labelled(df).agg(F.count("*").alias("_all"))
    return calibration_bins(df, bins).crossJoin(F.broadcast(total)).agg(
        F.sum(gap * F.col("n") / F.col("_all")).alias("ece"), F.max(gap).alias("mce")
    )


def regression(df: DataFrame, pred: str = "pred", target: str = "target") -> DataFrame:
    """MAE to median absolute error; non-finite pairs dropped (EV10)."""
    p, y = F.col(pred).cast("double"), F.col(target).cast("double")
    finite = p.isNotNull() & y.isNotNull() & ~F.isnan(p) & ~F.isnan(y) & (F.abs(p) != float("inf")) & (F.abs(y) != float("inf"))
    rows = df.filter(finite).select(p.alias("p"), y.alias("y"), (p - y).alias("e"), F.abs(p - y).alias("a"))
    e = F.col("e")
    out = rows.agg(
        F.avg("a").alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e / (F.col("y") + 1e-8))).alias("mape"),
        (1 - F.sum(e * e) / (F.var_pop("y") * F.count("*") + 1e-12)).alias("r2"),
        (1 - F.var_pop("e") / (F.var_pop("y") + 1e-12)).alias("explained_variance"),
    )
    return out.crossJoin(exact_quantiles(rows, "a", [0.5]).withColumnRenamed("q0", "median_ae"))


def error_analysis(df: DataFrame) -> DataFrame:
    """Error counts by kind and the advice that follows (EV11)."""
    conf = F.greatest(F.col("score"), 1.0 - F.col("score"))
    p, y = F.col("pred"), F.col("label")
    agg = labelled(df).agg(
        F.count_if((p == 1) & (y == 0)).alias("false_positives"),
        F.count_if((p == 0) & (y == 1)).alias("false_negatives"),
        F.count_if(conf < 0.5).alias("low_confidence_count"),
        F.count_if((p != y) & (conf >= 0.8)).alias("high_confidence_errors"),
    )
    advice = F.array_compact(F.array(
        F.when(F.col("false_positives") > F.col("false_negatives"), ERROR_ADVICE["false_positives"]),
        F.when(F.col("false_negatives") > 0, ERROR_ADVICE["false_negatives"]),
        F.when(F.col("high_confidence_errors") > 0, ERROR_ADVICE["overconfident"]),
    ))
    return agg.withColumn("recommendations", F.array_join(advice, " "))


def errors_by(df: DataFrame, column: str) -> DataFrame:
    """Misclassified rows per value of a column (AGG25)."""
    return labelled(df).groupBy(column).agg(F.count_if(F.col("pred") != F.col("label")).alias("errors"))


def descriptive(df: DataFrame, column: str) -> DataFrame:
    """Mean, median, population variance and a normal interval (EV13, EV14)."""
    base = df.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.var_pop(column).alias("variance"), F.stddev_pop(column).alias("std_dev"))
    half = F.when(F.col("n") < 2, 0.0).otherwise(1.96 * F.col("std_dev") / F.sqrt("n"))
    out = base.crossJoin(exact_quantiles(df, column, [0.5]).withColumnRenamed("q0", "median"))
    return out.select("n", "mean", "median", "variance", "std_dev", (F.col("mean") - half).alias("ci_low"), (F.col("mean") + half).alias("ci_high"))


def t_tail(t: float, df: float) -> float:
    """Two-sided p-value of a t statistic: regularised incomplete beta by continued fraction."""
    x = df / (df + t * t)
    a, b = df / 2.0, 0.5
    if x >= 1.0:
        return 1.0
    swap = x > (a + 1) / (a + b + 2)
    if swap:
        a, b, x = b, a, 1.0 - x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1), 1e-300)
    value = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1.0 + top * d)
            c = 1.0 + top / c
            value *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    out = front * value
    return 1.0 - out if swap else out


def paired_t(df: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """t statistic of the paired differences (EV15); ``t_tail`` gives the p-value of the one row."""
    d = F.col(after) - F.col(before)
    return df.select(d.alias("d")).agg(F.count("d").alias("n"), (F.avg("d") / (F.stddev_samp("d") / F.sqrt(F.count("d")))).alias("statistic"))


def paired_t_result(df: DataFrame, before: str = "before", after: str = "after", alpha: float = 0.05) -> DataFrame:
    p_value = F.udf(lambda t, n: None if t is None else t_tail(float(t), float(n - 1)), "double")
    return paired_t(df, before, after).withColumn("p_value", p_value("statistic", "n")).withColumn("significant", F.col("p_value") < alpha)


def wilcoxon(df: DataFrame, before: str = "before", after: str = "after", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Smaller of the signed rank sums with average ranks for ties (EV16)."""
    d = F.col(after) - F.col(before)
    counts = df.select(F.round(d, 12).alias("d")).filter("d <> 0").groupBy(F.abs("d").alias("size")).agg(
        F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("plus")
    )
    ranked = running_totals(counts, "size", ["n"], slice_rows=slice_rows)
    rank = F.col("n_before") + (F.col("n") + 1) / 2.0
    return ranked.agg(
        F.sum("n").alias("n"),
        F.least(F.sum(rank * F.col("plus")), F.sum(rank * (F.col("n") - F.col("plus")))).alias("statistic"),
    )


def mcnemar(df: DataFrame, first: str, second: str) -> DataFrame:
    """Continuity-corrected statistic from the two discordant counts (EV17)."""
    agg = df.agg(
        F.count_if(F.col(first) & ~F.col(second)).alias("only_first"), F.count_if(~F.col(first) & F.col(second)).alias("only_second")
    )
    gap = F.abs(F.col("only_first") - F.col("only_second")) - 1
    return agg.withColumn("statistic", ratio(gap * gap, (F.col("only_first") + F.col("only_second")).cast("double")))


# --- ablation and explanation --------------------------------------------------------------------
def variants(spark) -> DataFrame:
    """The fixed 15-row variant table."""
    return spark.createDataFrame(VARIANTS, VARIANTS_DDL)


def ablated(df: DataFrame, table: DataFrame) -> DataFrame:
    """Every row under every variant with masked modality flags (MAP2); 15 rows per input row."""
    t = table.select(F.col("variant"), *[F.col(m).alias(f"_{m}") for m in MODALITIES], "graph", "temporal")
    keep = [c for c in df.columns if c not in MODALITIES]
    return df.crossJoin(F.broadcast(t)).select(*keep, "variant", *[(F.col(m) & F.col(f"_{m}")).alias(m) for m in MODALITIES], "graph", "temporal")


def contribution(weights: DataFrame) -> DataFrame:
    """Mean weight per modality, scaled to sum 1 (AGG26). ``weights`` has ``modality, weight``."""
    means = weights.groupBy("modality").agg(F.avg("weight").alias("w"))
    total = means.agg(F.sum("w").alias("_t"))
    return means.crossJoin(F.broadcast(total)).select("modality", (F.col("w") / F.when(F.col("_t") == 0, 1.0).otherwise(F.col("_t"))).alias("contribution"))


def checklist(df: DataFrame) -> DataFrame:
    """The evaluation bundle's figures and yes/no list in one row (EV19)."""
    m = classification(df).crossJoin(calibration_error(df)).crossJoin(roc_auc(df)).crossJoin(average_precision(df)).crossJoin(probability_losses(df))
    return m.withColumns({
        "metrics_computed": F.col("support") > 0,
        "calibration_report": F.col("ece").isNotNull(),
        "roc_generated": F.col("roc_auc").isNotNull(),
        "f1_above_baseline": F.col("f1") > 0.5,
    })


def ranked_models(results: DataFrame) -> DataFrame:
    """Runs by f1, else AUC, else 0 (TOP8)."""
    key = F.coalesce("f1", "roc_auc", F.lit(0.0))
    return results.withColumn("rank_key", key).orderBy(F.desc("rank_key"), "model")


def predictions(df: DataFrame, probs: str = "probs") -> DataFrame:
    """Class with the largest probability, first one on a tie (EV23)."""
    return df.filter(F.col("label").isNotNull()).withColumn("pred", (F.array_position(probs, F.array_max(probs)) - 1).cast("long"))
