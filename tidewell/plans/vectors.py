"""Vector, array and frame-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import vectors as vx
from tidewell.functions.numeric import r4, r9
from tidewell.operators import signals as sg
from tidewell.operators import vectorsets as vs
from tidewell.operators.similar import top_similar
from tidewell.operators.timelines import weekly_summary
from tidewell.plans.registry import add, q4, q9

DV = "(SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"


def exploded(df, row_id, column):
    return df.select(row_id, F.posexplode(column).alias("pos", "x")).select(row_id, F.col("pos").cast("long").alias("pos"), r9("x").alias("x"))


def unnest(inner, row_id="vec_id", e="s"):
    return f"SELECT {row_id}, pos - 1 AS pos, {q9(f'{e}[pos]')} AS x FROM (SELECT {row_id}, {e}, unnest(range(1, len({e}) + 1)) AS pos FROM ({inner}))"


add("MTH2_norm_outliers", lambda t: vs.norm_outliers(t.embeddings, "vec_id", "embedding", 2.0).select("vec_id", r4("z").alias("z"), "outlier"),
    f"SELECT vec_id, {q4('abs((nm - m) / (s + 1e-8))')} AS z, abs((nm - m) / (s + 1e-8)) > 2 AS outlier FROM (SELECT vec_id, nm, avg(nm) OVER () AS m, stddev_pop(nm) OVER () AS s FROM "
    f"(SELECT vec_id, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS nm FROM {DV}))")
SPLIT = "CASE WHEN vec_id % 10 < 7 THEN 'train' ELSE 'test' END"
add("MTH4_train_scaling", lambda t: exploded(vs.train_scaled(t.embeddings.withColumn("split", F.expr(SPLIT)), "embedding"), "vec_id", "scaled"),
    unnest(f"SELECT vec_id, list_transform(e, lambda x: (x - m) / greatest(sd, 1e-8)) AS s FROM {DV}, (SELECT avg(x) AS m, stddev_pop(x) AS sd FROM (SELECT unnest(e) AS x FROM {DV} WHERE {SPLIT} = 'train'))"))
add("MTH5_dimension_scaling", lambda t: exploded(vs.dimension_scaled(t.embeddings, "embedding"), "vec_id", "scaled"),
    f"SELECT vec_id, pos - 1 AS pos, {q9('(e[pos] - avg(e[pos]) OVER (PARTITION BY pos)) / (stddev_pop(e[pos]) OVER (PARTITION BY pos) + 1e-8)')} AS x FROM (SELECT vec_id, e, unnest(range(1, 65)) AS pos FROM {DV})")
add("MTH7_vector_zscore", lambda t: exploded(t.embeddings.select("vec_id", vx.zscored(F.col("embedding")).alias("s")), "vec_id", "s"),
    f"SELECT vec_id, pos - 1 AS pos, {q9('(x - avg(x) OVER (PARTITION BY vec_id)) / (stddev_pop(x) OVER (PARTITION BY vec_id) + 1e-8)')} AS x FROM (SELECT vec_id, pos, e[pos] AS x FROM (SELECT vec_id, e, unnest(range(1, 65)) AS pos FROM {DV}))")
add("MTH7_vector_minmax", lambda t: exploded(t.embeddings.select("vec_id", vx.min_maxed(F.col("embedding")).alias("s")), "vec_id", "s"),
    unnest(f"SELECT vec_id, list_transform(e, lambda x: (x - list_min(e)) / (list_max(e) - list_min(e) + 1e-8)) AS s FROM {DV}"))
for _m, _f in (("peak", "95e-2 / (list_max(list_transform(e, lambda x: abs(x))) + 1e-8)"), ("rms", "1e-1 / (sqrt(list_sum(list_transform(e, lambda x: x * x)) / len(e)) + 1e-8)"),
               ("lufs", "power(10, -23e0 / 20) * 1e-1 / (sqrt(list_sum(list_transform(e, lambda x: x * x)) / len(e)) + 1e-8)")):
    add(f"MTH8_{_m}_amplitude", lambda t, m=_m: exploded(t.embeddings.select("vec_id", vx.amplitude(F.col("embedding"), m).alias("s")), "vec_id", "s"),
        unnest(f"SELECT vec_id, list_transform(e, lambda x: x * f) AS s FROM (SELECT vec_id, e, {_f} AS f FROM {DV})"))


def audio(t):
    parts = vx.audio_quality(F.transform(F.col("embedding"), lambda x: x * 4), F.col("label") / 10.0, F.col("label"))
    return t.embeddings.select("vec_id", *[r9(c).alias(n) if n != "flags" else c.alias(n) for n, c in parts.items()])


CLIP = "len(list_filter(v, lambda x: abs(x) > 99e-2)) / 64e0"
add("MTH15_audio_quality", audio,
    f"SELECT vec_id, {q9('clip')} AS clipping, {q9('20 * log10((rms + 1e-8) / (nf + 1e-8))')} AS snr, {q9('greatest(0e0, least(1e0, 1 - least(4e-1, clip * 4) - least(3e-1, greatest(0e0, label / 1e1 - 5e-1))))')} AS score, "
    "concat_ws(',', CASE WHEN clip > 5e-2 THEN 'clipping' END, CASE WHEN label / 1e1 > 85e-2 THEN 'excessive_silence' END, CASE WHEN label <= 0 THEN 'zero_duration' END) AS flags FROM "
    f"(SELECT vec_id, label, {CLIP} AS clip, sqrt(list_sum(list_transform(v, lambda x: x * x)) / 64) AS rms, list_aggregate(list_transform(v, lambda x: abs(x)), 'quantile_cont', 1e-1) AS nf FROM "
    "(SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x * 4 AS FLOAT))::DOUBLE[] AS v FROM embeddings))")
add("MTH16_visual_quality", lambda t: t.checkin.select("id", r9(vx.visual_quality(F.col("k"), F.col("k") % 50, F.col("k") % 30, F.when(F.col("k") % 9 != 0, F.col("value")), F.col("value"))).alias("quality")),
    f"SELECT id, {q9('least(1e0, 3e-1 * ((k % 50) / CAST(greatest(k, 1) AS DOUBLE)) + 3e-1 * ((k % 30) / CAST(greatest(k, 1) AS DOUBLE)) + 2e-1 * (1 - CASE WHEN k % 9 = 0 THEN 5e-1 ELSE 1 - least(1e0, value / 5e2) END) + 2e-1 * least(1e0, value / 6e1))')} AS quality FROM checkin", "checkin")
add("MTH19_first_vector_outliers", lambda t: vs.first_vector_outliers(t.embeddings.selectExpr("vec_id", "IF(label < 3, embedding, NULL) AS audio", "IF(label < 6, slice(embedding, 1, 32), NULL) AS text", "slice(embedding, 1, 16) AS visual"), "vec_id", threshold=1.5).select("vec_id", "outlier"),
    "SELECT vec_id, abs((nm - avg(nm) OVER ()) / (stddev_pop(nm) OVER () + 1e-8)) > 15e-1 AS outlier FROM (SELECT vec_id, sqrt(list_sum(list_transform(CASE WHEN label < 3 THEN e WHEN label < 6 THEN e[1:32] ELSE e[1:16] END, lambda x: x * x))) AS nm "
    f"FROM {DV})")
add("MTH20_array_summary", lambda t: t.embeddings.select("vec_id", F.size(F.col("embedding")).cast("long").alias("size"), r9(vx.mean(F.col("embedding"))).alias("mean"), r9(vx.spread(F.col("embedding"))).alias("deviation")),
    f"SELECT vec_id, count(*) AS size, {q9('avg(x)')} AS mean, {q9('stddev_pop(x)')} AS deviation FROM (SELECT vec_id, unnest(e) AS x FROM {DV}) GROUP BY 1")


def ragged(t):
    return t.embeddings.select("vec_id", (F.col("label") % 4).alias("batch"), F.expr("slice(embedding, 1, CAST(vec_id % 13 AS INT) + label)").alias("v"))


RAG = "SELECT vec_id, label % 4 AS batch, embedding[1:(vec_id % 13 + label)]::DOUBLE[] AS v FROM embeddings"
RAGM = f"SELECT vec_id, v, max(len(v)) OVER (PARTITION BY batch) AS m FROM ({RAG})"
add("ARR1_batch_padding", lambda t: vs.batch_padded(ragged(t), "batch", "v").select("vec_id", F.posexplode("padded").alias("pos", "x"), "mask").select("vec_id", F.col("pos").cast("long").alias("pos"), r9(F.col("x").cast("double")).alias("x"), F.get("mask", F.col("pos")).cast("double").alias("m")),
    f"SELECT vec_id, p AS pos, {q9('coalesce(v[p + 1], 0e0)')} AS x, CASE WHEN p < len(v) THEN 1e0 ELSE 0e0 END AS m FROM (SELECT vec_id, v, unnest(range(0, m)) AS p FROM ({RAGM}))")
add("ARR2_matrix_padding", lambda t: t.embeddings.select("vec_id", vx.padded_matrix(F.array(F.slice("embedding", 1, 40), F.slice("embedding", 41, 24)), 3, 48).alias("m")).select("vec_id", F.posexplode("m").alias("row", "r")).select(
        "vec_id", F.col("row").cast("long").alias("row"), F.posexplode("r").alias("c", "x")).select("vec_id", "row", F.col("c").cast("long").alias("c"), r9(F.col("x").cast("double")).alias("x")),
    f"SELECT vec_id, r AS \"row\", c, {q9('CASE WHEN r = 0 AND c < 40 THEN e[c + 1] WHEN r = 1 AND c < 24 THEN e[c + 41] ELSE 0e0 END')} AS x FROM {DV}, (SELECT unnest(range(0, 3)) AS r), (SELECT unnest(range(0, 48)) AS c)")
add("ARR3_presence_flags", lambda t: vs.presence(t.embeddings.selectExpr("vec_id", "IF(label < 3, embedding, NULL) AS a", "embedding AS b"), {"audio": "a", "text": "b"}).select("vec_id", F.explode("modality_mask").alias("modality", "present")),
    "SELECT vec_id, 'audio' AS modality, label < 3 AS present FROM embeddings UNION ALL SELECT vec_id, 'text', true FROM embeddings")
add("ARR4_vector_problems", lambda t: t.embeddings.select("vec_id", F.array_join(vx.problems(F.expr("CASE WHEN vec_id % 9 = 1 THEN NULL WHEN vec_id % 9 = 2 THEN slice(embedding, 1, 10) WHEN vec_id % 9 = 3 THEN concat(embedding, array(CAST('NaN' AS FLOAT))) ELSE embedding END"), 64), ",").alias("problems")),
    "SELECT vec_id, CASE vec_id % 9 WHEN 1 THEN 'missing_array' WHEN 2 THEN 'shape_mismatch' WHEN 3 THEN 'nan_values,shape_mismatch' ELSE '' END AS problems FROM embeddings")


def parts(t):
    return t.embeddings.selectExpr("CAST(vec_id % 50 AS STRING) AS participant_id", "concat('m', label % 3) AS modality", "embedding AS v", "lpad(CAST(vec_id AS STRING), 9, '0') AS path")


add("ARR5_fused_vectors", lambda t: exploded(vs.fused(parts(t)).select("participant_id", F.col("fused").cast("array<double>").alias("fused")), "participant_id", "fused"),
    unnest("SELECT CAST(pid AS VARCHAR) AS participant_id, flatten(list(v ORDER BY m)) AS s FROM (SELECT vec_id % 50 AS pid, label % 3 AS m, arg_min(e, vec_id) AS v FROM " + DV + " GROUP BY 1, 2) GROUP BY 1", "participant_id"))


def neighbours(t):
    a = t.embeddings.select("vec_id", F.col("embedding").alias("a"))
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.when(F.col("label") == 0, F.slice(F.col("embedding"), 1, 10)).otherwise(F.col("embedding")).alias("b"))
    return a.join(b, "vec_id")


add("ARR6_cosine", lambda t: neighbours(t).select("vec_id", r9(vx.cosine(F.col("a"), F.col("b"))).alias("similarity")),
    f"SELECT a.vec_id, {q9('CASE WHEN b.label = 0 THEN 0e0 ELSE list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(a.e, lambda x: x * x))) * sqrt(list_sum(list_transform(b.e, lambda x: x * x)))) END')} AS similarity FROM {DV} a JOIN {DV} b ON b.vec_id = a.vec_id + 1")


def kinds_per_user(t):
    """Distinct event types of the first and second half; at most five names per list."""
    half = F.col("ts") < "2024-01-16"
    return t.checkin.groupBy("user_id").agg(*[F.collect_set(F.when(c, F.concat(F.col("event_type"), (F.col("k") % 2).cast("string")))).alias(n) for n, c in (("sa", half), ("sb", ~half))],
                                            *[F.collect_set(F.when(c, F.col("event_type"))).alias(n) for n, c in (("ea", half & (F.col("k") < 50)), ("eb", ~half & (F.col("k") < 20)))])


KINDS = ("SELECT user_id, coalesce(list(DISTINCT event_type || (k % 2)) FILTER (WHERE h), []) AS sa, coalesce(list(DISTINCT event_type || (k % 2)) FILTER (WHERE NOT h), []) AS sb, coalesce(list(DISTINCT event_type) FILTER (WHERE h AND k < 50), []) AS ea, "
         "coalesce(list(DISTINCT event_type) FILTER (WHERE NOT h AND k < 20), []) AS eb FROM (SELECT *, ts < TIMESTAMP '2024-01-16' AS h FROM checkin) GROUP BY 1")


def jac(a, b):
    u = f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN {u} = 0 THEN 1e0 ELSE len(list_intersect({a}, {b})) / CAST({u} AS DOUBLE) END"


add("ARR7_jaccard", lambda t: kinds_per_user(t).select("user_id", r9(vx.jaccard(F.col("sa"), F.col("sb"))).alias("similarity")), f"SELECT user_id, {q9(jac('sa', 'sb'))} AS similarity FROM ({KINDS})", "checkin")
add("ARR8_session_similarity", lambda t: kinds_per_user(t).select("user_id", r9(vx.session_similarity(F.col("sa"), F.col("sb"), F.col("ea"), F.col("eb"))).alias("similarity")),
    f"SELECT user_id, {q9('((' + jac('sa', 'sb') + ') + (' + jac('ea', 'eb') + ')) / 2')} AS similarity FROM ({KINDS})", "checkin")


def weekly(t):
    w = weekly_summary(t.score).selectExpr("user_id", "week_start AS pos", "mean_risk AS risk")
    return w.join(w.groupBy("user_id").agg(F.count("*").alias("n")), "user_id")


WEEK = "SELECT user_id, CAST(floor(epoch_us(ts) / 604800e6) AS BIGINT) AS pos, avg(risk) AS risk FROM score GROUP BY 1, 2"
add("ARR9_user_similarity", lambda t: vs.pair_similarity(t.user.selectExpr("user_id AS a", "user_id + 1 AS b"), weekly(t), research=True).withColumn("similarity", r9("similarity")),
    f"SELECT a, b, {q9('CASE WHEN na = nb THEN d / (sqrt(qa) * sqrt(qb)) ELSE 0e0 END')} AS similarity FROM (SELECT x.user_id AS a, y.user_id AS b, x.n AS na, y.n AS nb, x.q AS qa, y.q AS qb, coalesce((SELECT sum(l.risk * r.risk) FROM w l JOIN w r ON l.pos = r.pos "
    "WHERE l.user_id = x.user_id AND r.user_id = y.user_id), 0e0) AS d FROM g x JOIN g y ON y.user_id = x.user_id + 1)", "score")
add("JN16_pair_similarity", lambda t: vs.pair_similarity(t.user.selectExpr("user_id AS a", "user_id + 2 AS b"), weekly(t), research=True).filter("similarity > 0.9").select("a", "b"),
    "SELECT a, b FROM (SELECT x.user_id AS a, y.user_id AS b, x.n AS na, y.n AS nb, x.q AS qa, y.q AS qb, coalesce((SELECT sum(l.risk * r.risk) FROM w l JOIN w r ON l.pos = r.pos WHERE l.user_id = x.user_id AND r.user_id = y.user_id), 0e0) AS d "
    "FROM g x JOIN g y ON y.user_id = x.user_id + 2) WHERE na = nb AND d / (sqrt(qa) * sqrt(qb)) > 9e-1", "score")
add("JN16_top_similar", lambda t: top_similar(weekly(t), 5, research=True),
    "SELECT a, b, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS rank FROM (SELECT x.user_id AS a, y.user_id AS b, "
    f"{q9('list_inner_product(x.v, y.v) / (sqrt(x.q) * sqrt(y.q))')} AS similarity FROM lists x JOIN lists y ON len(x.v) = len(y.v) AND x.user_id <> y.user_id)) WHERE rank <= 5", "score")
from tidewell.plans.registry import SQL  # noqa: E402

SQL["JN16_top_similar"] = SQL["JN16_top_similar"].replace(") SELECT a, b", f"), w AS ({WEEK}), lists AS (SELECT user_id, list(risk ORDER BY pos) AS v, sum(risk * risk) AS q FROM w GROUP BY 1) SELECT a, b", 1)

for _n in ("ARR9_user_similarity", "JN16_pair_similarity"):
    _cte = f"w AS ({WEEK}), g AS (SELECT user_id, count(*) AS n, sum(risk * risk) AS q FROM w GROUP BY 1) SELECT a, b"
    SQL[_n] = SQL[_n].replace(") SELECT a, b", "), " + _cte, 1)
add("ARR10_principal_axes", lambda t: vs.principal_axes(t.embeddings, "embedding").select("vec_id", "axis1", "axis2"))
add("ARR11_collation", lambda t: vs.batch_padded(ragged(t), "batch", "v").select("vec_id", F.size("padded").cast("long").alias("length"), vx.total(F.col("mask")).cast("long").alias("held")),
    f"SELECT vec_id, m AS length, len(v) AS held FROM ({RAGM})")


def training(t):
    scaled = vs.train_scaled(t.embeddings.withColumn("split", F.expr(SPLIT)), "embedding")
    return scaled.select("vec_id", "split", F.when(F.col("label") < 5, 1).when(F.col("label") < 9, 0).otherwise(-1).cast("long").alias("label"), r9(vx.mean(F.col("scaled"))).alias("mean"))


add("TW17_training_table", training,
    f"SELECT vec_id, {SPLIT} AS split, CASE WHEN label < 5 THEN 1 WHEN label < 9 THEN 0 ELSE -1 END AS label, {q9('list_avg(list_transform(e, lambda x: (x - m) / greatest(sd, 1e-8)))')} AS mean FROM {DV}, "
    f"(SELECT avg(x) AS m, stddev_pop(x) AS sd FROM (SELECT unnest(e) AS x FROM {DV} WHERE {SPLIT} = 'train'))")


# --- frames ---------------------------------------------------------------------------------------
def frames(t):
    return t.checkin.selectExpr("user_id AS rec", "id AS frame", "k / 1000.0D AS energy")


def runs(t):
    return sg.speech_runs(frames(t), 20.0, 0.05)


RUN = ("SELECT rec, run, any_value(sp) AS speech, (min(p) - 1) * 2e1 AS start, max(p) * 2e1 AS stop, max(n) * 2e1 AS duration FROM (SELECT *, sum(ch) OVER (PARTITION BY rec ORDER BY p) AS run FROM "
       "(SELECT *, CASE WHEN lag(sp) OVER (PARTITION BY rec ORDER BY p) = sp THEN 0 ELSE 1 END AS ch FROM (SELECT user_id AS rec, k / 1e3 >= 5e-2 AS sp, row_number() OVER (PARTITION BY user_id ORDER BY id) AS p, count(*) OVER (PARTITION BY user_id) AS n FROM checkin))) GROUP BY 1, 2")
RUN = f"SELECT rec, CAST(run AS BIGINT) AS run, speech, start, stop, duration FROM ({RUN})"
STATSQ = (f"SELECT rec, {q9('s / d')} AS speech_ratio, {q9('s / greatest(c, 1)')} AS avg_run, {{pauses}} FROM (SELECT rec, sum(CASE WHEN speech THEN stop - start ELSE 0 END) AS s, max(duration) AS d, count(CASE WHEN speech THEN 1 END) AS c, "
          "count(CASE WHEN NOT speech THEN 1 END) AS q, sum(CASE WHEN NOT speech THEN stop - start ELSE 0 END) AS qs, coalesce(arg_min(stop - start, run) FILTER (WHERE NOT speech), 0e0) AS lead, "
          f"coalesce(arg_max(stop - start, run) FILTER (WHERE NOT speech), 0e0) AS trail FROM ({RUN}) GROUP BY 1)")
add("WIN27_speech_runs", lambda t: runs(t), RUN, "checkin")
PAUSES = f"{q9('lead')} AS leading_silence, {q9('trail')} AS trailing_silence, greatest(0, q - 2) AS internal_pauses, {q9('CASE WHEN q > 2 THEN (qs - lead - trail) / (q - 2) ELSE 0e0 END')} AS avg_pause"
add("WIN28_pause_statistics", lambda t: sg.speech_statistics(runs(t)).select("rec", *[r9(c).alias(c) for c in ("speech_ratio", "avg_run", "leading_silence", "trailing_silence")], F.col("internal_pauses"), r9("avg_pause").alias("avg_pause")),
    STATSQ.format(pauses=PAUSES), "checkin")
add("WIN29_speech_chunks", lambda t: sg.chunks(runs(t)).select("rec", "run", F.col("i").cast("long").alias("i"), *[r9(c).alias(c) for c in ("chunk_start", "chunk_stop", "cut_start", "cut_stop")]),
    f"SELECT rec, run, i, {q9('b')} AS chunk_start, {q9('e')} AS chunk_stop, {q9('greatest(0e0, b - 1e-1)')} AS cut_start, {q9('least(duration, e + 1e-1)')} AS cut_stop FROM (SELECT *, start + i * 295e-1 AS b, least(start + i * 295e-1 + 30, stop) AS e FROM "
    f"(SELECT *, unnest(range(0, 200)) AS i FROM ({RUN}) WHERE speech)) WHERE b < stop AND (i = 0 OR start + (i - 1) * 295e-1 + 30 < stop)", "checkin")
add("WIN30_sampled_frames", lambda t: sg.sampled_frames(frames(t), 24.0, 5.0).select("rec", "frame"),
    "SELECT rec, frame FROM (SELECT user_id AS rec, id AS frame, row_number() OVER (PARTITION BY user_id ORDER BY id) AS p FROM checkin) WHERE (p - 1) % 5 = 0", "checkin")


def meshes(t):
    """A 468-point mesh per vector: the embedding values spread over the points."""
    pts = F.expr("transform(sequence(0, 467), i -> array(CAST(embedding[i % 64] AS DOUBLE), CAST(embedding[(i * 7 + 3) % 64] AS DOUBLE), CAST(embedding[(i * 11 + 5) % 64] AS DOUBLE)))")
    return t.embeddings.select((F.col("vec_id") % 20).alias("rec"), (F.col("vec_id") / 20.0).alias("at"), pts.alias("points"))


def point_sql(i):
    return [f"e[{k % 64 + 1}]" for k in (i, i * 7 + 3, i * 11 + 5)]


def distance_sql(i, j):
    return "sqrt(" + " + ".join(f"({a} - {b}) * ({a} - {b})" for a, b in zip(point_sql(i), point_sql(j))) + ")"


def eye_sql(at):
    return f"({distance_sql(at + 1, at + 5)} + {distance_sql(at + 2, at + 4)}) / (2 * ({distance_sql(at, at + 3)} + 1e-8))"


FACE = ("blink_rate", "smile_intensity", "gaze_forward_ratio", "yaw", "pitch", "roll")
TURNED = ", ".join(f"{a} - {b} AS {n}" for n, a, b in zip(("yaw", "pitch", "roll"), point_sql(1), point_sql(152)))
add("MTH17_facial_features", lambda t: sg.facial_features(meshes(t)).select("rec", *[r9(c).alias(c) for c in FACE]),
    f"SELECT rec, {q9('count(CASE WHEN ear < 2e-1 THEN 1 END) / greatest(max(secs), 1e0)')} AS blink_rate, {q9('avg(mar)')} AS smile_intensity, {q9('avg(CASE WHEN ear > 2e-1 THEN 1e0 ELSE 0e0 END)')} AS gaze_forward_ratio, "
    f"{', '.join(f'{q9(f'avg({c})')} AS {c}' for c in FACE[3:])} FROM (SELECT vec_id % 20 AS rec, vec_id / 2e1 AS secs, ({eye_sql(33)} + {eye_sql(263)}) / 2 AS ear, "
    f"{distance_sql(13, 14)} / ({distance_sql(61, 291)} + 1e-8) AS mar, {TURNED} FROM {DV}) GROUP BY 1")
