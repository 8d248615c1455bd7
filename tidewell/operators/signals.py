"""Frame tables: speech runs, pauses, chunks, sampling and facial ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.ordered import SLICE_ROWS, sequenced


def speech_runs(frames: DataFrame, frame_seconds: float = 0.03, threshold: float = 0.02, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Runs of equal voice flag per recording (WIN27). ``frames`` has ``rec, frame, energy``.

    Only the frames where the flag changes matter: each one's number and the next change bound a run.
    """
    flagged = frames.selectExpr("rec", "frame", f"energy >= CAST({threshold!r} AS DOUBLE) AS speech")
    marked = sequenced(flagged, ["rec"], ["frame"], {"_was": "speech"}, "_p", "_n", slice_rows)
    starts = marked.filter("_was IS NULL OR _was <> speech").selectExpr("rec", "_p", "_n", "speech")
    # numbered from the end, so that "previous" is the next change
    back = sequenced(starts.selectExpr("*", "-_p AS _q"), ["rec"], ["_q"], {"_next": "_p"}, "_r", "_runs", slice_rows)
    unit = f"CAST({frame_seconds!r} AS DOUBLE)"
    return back.selectExpr(
        "rec", "_runs - _r + 1 AS run", "speech", f"(_p - 1) * {unit} AS start", f"(coalesce(_next, _n + 1) - 1) * {unit} AS stop", f"_n * {unit} AS duration"
    )


def speech_statistics(runs: DataFrame) -> DataFrame:
    """Speech ratio and mean run; leading, trailing and inner pauses (WIN27, WIN28)."""
    length = F.col("stop") - F.col("start")
    spoken = F.sum(F.when(F.col("speech"), length).otherwise(0.0))
    quiet = ~F.col("speech")
    agg = runs.groupBy("rec").agg(
        spoken.alias("_s"), F.max("duration").alias("_d"), F.count_if("speech").alias("speech_runs"), F.count_if(quiet).alias("_q"),
        F.sum(F.when(quiet, length).otherwise(0.0)).alias("_qs"),
        F.min_by(F.when(quiet, length), F.when(quiet, F.col("run"))).alias("leading_silence"),
        F.max_by(F.when(quiet, length), F.when(quiet, F.col("run"))).alias("trailing_silence"),
    )
    inner = F.greatest(F.lit(0), F.col("_q") - 2)
    rest = F.col("_qs") - F.col("leading_silence") - F.col("trailing_silence")
    return agg.select(
        "rec",
        (F.col("_s") / F.col("_d")).alias("speech_ratio"),
        (F.col("_s") / F.greatest("speech_runs", F.lit(1))).alias("avg_run"),
        F.coalesce("leading_silence", F.lit(0.0)).alias("leading_silence"),
        F.coalesce("trailing_silence", F.lit(0.0)).alias("trailing_silence"),
        inner.alias("internal_pauses"),
        F.when(inner > 0, rest / inner).otherwise(0.0).alias("avg_pause"),
    )


def chunks(runs: DataFrame, longest: float = 30.0, overlap: float = 0.5, shortest: float = 0.5, padding: float = 0.1) -> DataFrame:
    """Overlapping chunks of each speech run, padded inside the recording (WIN29)."""
    step = longest - overlap
    length = F.col("stop") - F.col("start")
    count = F.greatest(F.lit(1), F.ceil((length - longest) / step) + 1).cast("int")
    rows = runs.filter(F.col("speech") & (length >= shortest)).withColumn("i", F.explode(F.sequence(F.lit(0), count - 1)))
    begin = F.col("start") + F.col("i") * step
    end = F.least(begin + longest, F.col("stop"))
    out = rows.select("rec", "run", "i", begin.alias("chunk_start"), end.alias("chunk_stop"),
                      F.greatest(F.lit(0.0), begin - padding).alias("cut_start"), F.least(F.col("duration"), end + padding).alias("cut_stop"))
    return out.filter((F.col("chunk_start") < F.col("chunk_stop")) & (F.col("cut_stop") - F.col("cut_start") >= shortest))


def sampled_frames(frames: DataFrame, fps: Column | float, target: float = 1.0, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Every k-th frame, k = round(fps / target), at least 1 (WIN30). ``frames`` has ``rec, frame``."""
    step = F.greatest(F.lit(1), F.round((F.lit(fps) if isinstance(fps, float) else fps) / target)).cast("long")
    return sequenced(frames, ["rec"], ["frame"], slice_rows=slice_rows).filter((F.col("pos") - 1) % step == 0).drop("pos")


def _distance(p: Column, q: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(p, q, lambda a, b: (a - b) * (a - b)), F.lit(0.0).cast("double"), lambda s, x: s + x))


def eye_ratio(points: Column) -> Column:
    """Mean aspect ratio of both eyes; 0.3 when the mesh is too small."""
    def one(at: int) -> Column:
        p = [F.get(points, at + i) for i in range(6)]
        return (_distance(p[1], p[5]) + _distance(p[2], p[4])) / (2.0 * (_distance(p[0], p[3]) + 1e-8))

    return F.when(F.size(points) < 400, 0.3).otherwise((one(33) + one(263)) / 2.0)


def mouth_ratio(points: Column) -> Column:
    wide = _distance(F.get(points, 61), F.get(points, 291)) + 1e-8
    return F.when(F.size(points) < 300, 0.2).otherwise(_distance(F.get(points, 13), F.get(points, 14)) / wide)


def facial_features(landmarks: DataFrame, closed: float = 0.2) -> DataFrame:
    """Blink rate, mouth opening, gaze share and mean head pose per video (MTH17).

    ``landmarks`` has ``rec, at, points`` with points as an array of [x, y, z].
    """
    pts = F.col("points")
    chin = F.coalesce(F.get(pts, 152), F.element_at(pts, -1))
    nose = F.get(pts, 1)
    rows = landmarks.select(
        "rec", "at", eye_ratio(pts).alias("ear"), mouth_ratio(pts).alias("mar"),
        *[(F.get(nose, i) - F.get(chin, i)).alias(n) for i, n in enumerate(("yaw", "pitch", "roll"))],
    )
    return rows.groupBy("rec").agg(
        (F.count_if(F.col("ear") < closed) / F.greatest(F.max("at"), F.lit(1.0))).alias("blink_rate"),
        F.avg("mar").alias("smile_intensity"),
        F.avg((F.col("ear") > closed).cast("double")).alias("gaze_forward_ratio"),
        F.avg("yaw").alias("yaw"), F.avg("pitch").alias("pitch"), F.avg("roll").alias("roll"),
    )
