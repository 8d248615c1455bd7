"""Evaluation metrics over the scored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import vectors as vx
from tidewell.functions.numeric import r9
from tidewell.operators import evaluation as ev
from tidewell.operators import series as sr
from tidewell.operators.ordered import series_summary
from tidewell.plans.registry import add, q9
from tidewell.schemas import MODALITIES, VARIANTS


def rd(df):
    return df.select(*[r9(c).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


LABELLED = "(SELECT * FROM scored WHERE label >= 0)"
CM = ("SELECT {by}count(CASE WHEN pred = 1 AND label = 1 THEN 1 END) * 1e0 AS tp, count(CASE WHEN pred = 1 AND label = 0 THEN 1 END) * 1e0 AS fp, count(CASE WHEN pred = 0 AND label = 1 THEN 1 END) * 1e0 AS fn, "
      "count(CASE WHEN pred = 0 AND label = 0 THEN 1 END) * 1e0 AS tn, count(*) * 1e0 AS n FROM {src} {group}")


def sd(a, b):
    return f"coalesce(({a}) / nullif({b}, 0), 0e0)"


PR, RE, SPEC = sd("tp", "tp + fp"), sd("tp", "tp + fn"), sd("tn", "tn + fp")
F1P, F1N = sd("2 * tp", "2 * tp + fn + fp"), sd("2 * tn", "2 * tn + fn + fp")
EXP = "((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)"
METRICS = {
    "support": "n", "accuracy": "(tp + tn) / n", "balanced_accuracy": f"({RE} + {SPEC}) / 2", "precision": PR, "recall": RE, "specificity": SPEC, "f1": sd(f"2 * {PR} * {RE}", f"{PR} + {RE}"),
    "balanced_error_rate": f"1 - ({RE} + {SPEC}) / 2", "weighted_f1": f"{F1P} * (tp + fn) / n + {F1N} * (tn + fp) / n", "macro_f1": f"({F1P} + {F1N}) / 2", "micro_f1": "(tp + tn) / n",
    "mcc": sd("tp * tn - fp * fn", "sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn)"), "cohen_kappa": sd(f"(tp + tn) / n - {EXP}", f"1 - {EXP}"),
}


def pick(names, by="", src=LABELLED, group=""):
    return f"SELECT {by}" + ", ".join(f'{q9(METRICS[m])} AS "{m}"' for m in names) + f" FROM ({CM.format(by=by, src=src, group=group)})"


EV1 = ["support", "accuracy", "balanced_accuracy", "precision", "recall", "specificity", "f1", "balanced_error_rate"]
EV2 = ["weighted_f1", "macro_f1", "micro_f1", "mcc", "cohen_kappa"]
add("EV1_classification", lambda t: rd(ev.classification(t.scored).select(*EV1)), pick(EV1), "scored")
add("EV2_averaged_f1_mcc_kappa", lambda t: rd(ev.classification(t.scored).select(*EV2)), pick(EV2), "scored")
CUM = (f"SELECT score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS ap, sum(neg) OVER () AS an FROM (SELECT score, count(CASE WHEN label = 1 THEN 1 END) * 1e0 AS pos, "
       f"count(CASE WHEN label = 0 THEN 1 END) * 1e0 AS neg FROM {LABELLED} GROUP BY 1) WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)")
AUC = q9("sum(pos * (an - fp + neg / 2)) / (max(ap) * max(an))")
AP = q9("sum(pos / ap * (tp / (tp + fp)))")
LOSS = (f"{q9('avg(-CASE WHEN label = 1 THEN ln(greatest(2220446049250313e-31, least(1 - 2220446049250313e-31, score))) ELSE ln(1 - greatest(2220446049250313e-31, least(1 - 2220446049250313e-31, score))) END)')} AS log_loss, "
        f"{q9('avg((score - label) * (score - label))')} AS brier_score FROM {LABELLED}")
add("EV3_roc_auc", lambda t: rd(ev.roc_auc(t.scored)), f"SELECT {AUC} AS roc_auc FROM ({CUM})", "scored")
add("EV4_roc_points", lambda t: rd(ev.roc_points(t.scored)), f"SELECT {q9('score')} AS threshold, {q9('fp / an')} AS fpr, {q9('tp / ap')} AS tpr FROM ({CUM})", "scored")
add("EV5_pr_points", lambda t: rd(ev.pr_points(t.scored)), f"SELECT {q9('score')} AS threshold, {q9('tp / (tp + fp)')} AS \"precision\", {q9('tp / ap')} AS recall FROM ({CUM})", "scored")
add("EV5_average_precision", lambda t: rd(ev.average_precision(t.scored)), f"SELECT {AP} AS average_precision FROM ({CUM})", "scored")
add("EV6_probability_losses", lambda t: rd(ev.probability_losses(t.scored)), f"SELECT {LOSS}", "scored")
add("EV7_per_class", lambda t: rd(ev.per_class(t.scored)),
    " UNION ALL ".join(f"SELECT {c} AS class, {q9(sd(tp, f'{tp} + {fp}'))} AS \"precision\", {q9(sd(tp, f'{tp} + {fn}'))} AS recall, {q9(sd(tn, f'{tn} + {fp}'))} AS specificity, {q9(f'{tp} + {fn}')} AS support FROM ({CM.format(by='', src=LABELLED, group='')})"
                       for c, tp, fp, fn, tn in ((1, "tp", "fp", "fn", "tn"), (0, "tn", "fn", "fp", "tp"))), "scored")
add("EV8_confusion_matrix", lambda t: rd(ev.confusion(t.scored)),
    f"SELECT pred, label, n, {q9('n / greatest(sum(n) OVER (PARTITION BY pred), 1)')} AS row_share, {q9('n / greatest(sum(n) OVER (PARTITION BY label), 1)')} AS column_share, {q9('n / sum(n) OVER ()')} AS share FROM "
    f"(SELECT p.v AS pred, l.v AS label, (SELECT count(*) FROM {LABELLED} s WHERE s.pred = p.v AND s.label = l.v) AS n FROM (VALUES (0), (1)) p(v), (VALUES (0), (1)) l(v))", "scored")
BINS = (f"SELECT CAST(ceil(c * 10) - 1 AS BIGINT) AS bin, count(*) AS n, avg(ok) AS accuracy, avg(c) AS confidence FROM (SELECT greatest(score, 1 - score) AS c, CASE WHEN (CASE WHEN score > 5e-1 THEN 1 ELSE 0 END) = label THEN 1e0 ELSE 0e0 END AS ok FROM {LABELLED}) WHERE c > 0 GROUP BY 1")
ECE = f"SELECT {q9(f'sum(abs(accuracy - confidence) * n / (SELECT count(*) FROM {LABELLED}))')} AS ece, {q9('max(abs(accuracy - confidence))')} AS mce FROM ({BINS})"
add("EV9_calibration_error", lambda t: rd(ev.calibration_error(t.scored)), ECE, "scored")
add("EV9_calibration_bins", lambda t: rd(ev.calibration_bins(t.scored)), f"SELECT bin, n, {q9('accuracy')} AS accuracy, {q9('confidence')} AS confidence FROM ({BINS})", "scored")


def pairs(t):
    return t.lineitem.selectExpr("l_extendedprice / 1000 AS pred", "l_quantity AS target")


REG = {"mae": "avg(abs(e))", "mse": "avg(e * e)", "rmse": "sqrt(avg(e * e))", "mape": "avg(abs(e / (y + 1e-8)))", "r2": "1 - sum(e * e) / (var_pop(y) * count(*) + 1e-12)", "explained_variance": "1 - var_pop(e) / (var_pop(y) + 1e-12)", "median_ae": "median(abs(e))"}


def q6(e):
    return f"floor(({e}) * 1e6 + 5000001e-7) / 1e6"


def rd6(df):
    from tidewell.functions.numeric import rounded
    return df.select(*[rounded(c, 6).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


add("EV10_regression", lambda t: rd6(ev.regression(pairs(t))), "SELECT " + ", ".join(f"{q6(e)} AS {n}" for n, e in REG.items()) + " FROM (SELECT l_extendedprice / 1000 - l_quantity AS e, l_quantity AS y FROM lineitem)")
ERR = ("SELECT count(CASE WHEN pred = 1 AND label = 0 THEN 1 END) AS false_positives, count(CASE WHEN pred = 0 AND label = 1 THEN 1 END) AS false_negatives, count(CASE WHEN greatest(score, 1 - score) < 5e-1 THEN 1 END) AS low_confidence_count, "
       f"count(CASE WHEN pred <> label AND greatest(score, 1 - score) >= 8e-1 THEN 1 END) AS high_confidence_errors FROM {LABELLED}")
add("EV11_error_analysis", lambda t: ev.error_analysis(t.scored),
    f"SELECT *, concat_ws(' ', CASE WHEN false_positives > false_negatives THEN '{ev.ERROR_ADVICE['false_positives']}' END, CASE WHEN false_negatives > 0 THEN '{ev.ERROR_ADVICE['false_negatives']}' END, CASE WHEN high_confidence_errors > 0 THEN '{ev.ERROR_ADVICE['overconfident']}' END) AS recommendations FROM ({ERR})", "scored")
add("EV12_predictive_entropy", lambda t: t.scored.select("doc_id", r9(vx.entropy(F.array(F.col("score"), 1 - F.col("score")))).alias("entropy")),
    f"SELECT doc_id, {q9('-(greatest(1e-8, score) * ln(greatest(1e-8, score)) + greatest(1e-8, 1 - score) * ln(greatest(1e-8, 1 - score)))')} AS entropy FROM scored", "scored")
DESC = "count(value) AS n, " + ", ".join(f"{q9(e)} AS {n}" for n, e in {"mean": "avg(value)", "median": "median(value)", "variance": "var_pop(value)", "std_dev": "stddev_pop(value)", "ci_low": "avg(value) - 196e-2 * stddev_pop(value) / sqrt(count(value))", "ci_high": "avg(value) + 196e-2 * stddev_pop(value) / sqrt(count(value))"}.items())
add("EV13_descriptive", lambda t: rd(ev.descriptive(t.events, "value")).select("n", "mean", "median", "variance", "std_dev"), f"SELECT n, mean, median, variance, std_dev FROM (SELECT {DESC} FROM events)")
add("EV14_mean_interval", lambda t: rd(ev.descriptive(t.events, "value")).select("ci_low", "ci_high"), f"SELECT ci_low, ci_high FROM (SELECT {DESC} FROM events)")


def before_after(t):
    s = series_summary(t.score)
    return s.filter("n >= 2").selectExpr("first AS before", "last AS after")


add("EV15_paired_t", lambda t: rd(ev.paired_t(before_after(t))), f"SELECT count(*) AS n, {q9('avg(last - first) / (stddev_samp(last - first) / sqrt(count(*)))')} AS statistic FROM trend WHERE n >= 2", "trend")
add("EV15_paired_t_p_value", lambda t: ev.paired_t_result(before_after(t)))
add("EV16_wilcoxon", lambda t: ev.wilcoxon(before_after(t)),
    "SELECT count(*) AS n, least(sum(CASE WHEN d > 0 THEN r ELSE 0e0 END), sum(CASE WHEN d < 0 THEN r ELSE 0e0 END)) AS statistic FROM (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2e0 AS r FROM "
    "(SELECT round(last - first, 12) AS d FROM trend WHERE n >= 2) WHERE d <> 0)", "trend")
add("EV17_mcnemar", lambda t: rd(ev.mcnemar(ev.labelled(t.scored).select((F.col("pred") == F.col("label")).alias("a"), ((F.col("score") > 0.5).cast("int") == F.col("label")).alias("b")), "a", "b")),
    f"SELECT *, {q9(sd('(abs(only_first - only_second) - 1) * (abs(only_first - only_second) - 1)', 'only_first + only_second'))} AS statistic FROM (SELECT count(CASE WHEN a AND NOT b THEN 1 END) AS only_first, count(CASE WHEN b AND NOT a THEN 1 END) AS only_second "
    f"FROM (SELECT pred = label AS a, (score > 5e-1)::INT = label AS b FROM {LABELLED}))", "scored")


def flags(t):
    return t.scored.selectExpr("doc_id", "label", "pred", "score", "doc_id % 2 = 0 AS audio", "doc_id % 3 = 0 AS visual", "true AS text", "doc_id % 5 = 0 AS image")


VAR = "SELECT * FROM (VALUES " + ", ".join(f"('{v[0]}', " + ", ".join(str(x).lower() for x in v[1:]) + ")" for v in VARIANTS) + ") v(variant, audio, visual, txt, image, graph, temporal)"
MASK = f"SELECT doc_id, label, variant, doc_id % 2 = 0 AND audio AS audio, doc_id % 3 = 0 AND visual AS visual, txt AS text, doc_id % 5 = 0 AND image AS image, graph, temporal, pred, score FROM scored, ({VAR})"
add("MAP2_ablation_masks", lambda t: ev.ablated(flags(t), ev.variants(t.spark)).select("doc_id", "variant", *MODALITIES, "graph", "temporal"), f"SELECT doc_id, variant, audio, visual, text, image, graph, temporal FROM ({MASK})", "scored")


def by_variant(t):
    rows = ev.ablated(flags(t), ev.variants(t.spark))
    any_kept = F.col("audio") | F.col("visual") | F.col("text") | F.col("image")
    return rows.withColumn("pred", F.when(any_kept, F.col("pred")).otherwise(0))


add("EV18_ablation_table", lambda t: rd(ev.classification(by_variant(t), ["variant"]).select("variant", *EV1, *EV2)),
    pick(EV1 + EV2, by="variant, ", src=f"(SELECT variant, label, CASE WHEN audio OR visual OR text OR image THEN pred ELSE 0 END AS pred FROM ({MASK}) WHERE label >= 0)", group="GROUP BY variant"), "scored")
add("EV19_evaluation_bundle", lambda t: rd(ev.checklist(t.scored).select("accuracy", "f1", "ece", "mce", "roc_auc", "average_precision", "log_loss", "brier_score", "metrics_computed", "calibration_report", "roc_generated", "f1_above_baseline")),
    f"SELECT a.accuracy, a.f1, b.ece, b.mce, c.roc_auc, d.average_precision, e.log_loss, e.brier_score, true AS metrics_computed, true AS calibration_report, true AS roc_generated, a.f1 > 5e-1 AS f1_above_baseline FROM ({pick(['accuracy', 'f1'])}) a, ({ECE}) b, "
    f"(SELECT {AUC} AS roc_auc FROM ({CUM})) c, (SELECT {AP} AS average_precision FROM ({CUM})) d, (SELECT {LOSS}) e", "scored")
add("EV21_energy_score", lambda t: t.embeddings.select("vec_id", r9(vx.energy_score(F.col("embedding"))).alias("energy")),
    f"SELECT vec_id, {q9('-(m + ln(list_sum(list_transform(e, lambda x: exp(x - m)))))')} AS energy FROM (SELECT vec_id, e, list_max(e) AS m FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))")


def weights(t):
    return t.checkin.selectExpr("element_at(array('audio', 'visual', 'text', 'image'), CAST(k % 4 AS INT) + 1) AS modality", "k / 100.0D AS weight")


CONTR = "SELECT modality, w / sum(w) OVER () AS c FROM (SELECT ['audio', 'visual', 'text', 'image'][k % 4 + 1] AS modality, avg(k / 1e2) AS w FROM checkin GROUP BY 1)"
add("AGG26_modality_contribution", lambda t: rd(ev.contribution(weights(t))), f"SELECT modality, {q9('c')} AS contribution FROM ({CONTR})", "checkin")
add("EV22_local_explanation", lambda t: sr.history_reasoning(series_summary(t.score)).select("user_id", "trend", "sudden_change", "latest_risk").crossJoin(
        F.broadcast(ev.contribution(weights(t)).agg(F.max_by("modality", "contribution").alias("top_modality")))),
    "SELECT user_id, CASE WHEN n < 2 THEN 'insufficient_history' WHEN last - first > 15e-2 THEN 'risk_increasing' WHEN last - first < -15e-2 THEN 'risk_decreasing' WHEN peak - low < 5e-2 THEN 'stable' ELSE 'fluctuating' END AS trend, "
    f"coalesce(abs(last - prev) >= 25e-2, false) AS sudden_change, last AS latest_risk, (SELECT arg_max(modality, c) FROM ({CONTR})) AS top_modality FROM trend", "trend")
add("EV23_predictions_table", lambda t: ev.predictions(t.scored.select("doc_id", "label", F.array(1 - F.col("score"), F.col("score")).alias("probs"))).select("doc_id", "label", "pred"),
    "SELECT doc_id, label, CASE WHEN score > 1 - score THEN 1 ELSE 0 END AS pred FROM scored", "scored")
add("AGG25_errors_by_language", lambda t: ev.errors_by(t.scored, "language"), f"SELECT language, count(CASE WHEN pred <> label THEN 1 END) AS errors FROM {LABELLED} GROUP BY 1", "scored")
add("TOP8_ranked_models", lambda t: ev.ranked_models(rd(ev.classification(t.scored, ["language"]).selectExpr("language AS model", "IF(language = 'en', NULL, f1) AS f1", "accuracy AS roc_auc"))),
    f"SELECT *, coalesce(f1, roc_auc, 0e0) AS rank_key FROM (SELECT language AS model, CASE WHEN language <> 'en' THEN {q9(METRICS['f1'])} END AS f1, {q9(METRICS['accuracy'])} AS roc_auc FROM ({CM.format(by='language, ', src=LABELLED, group='GROUP BY language')}))", "scored")
