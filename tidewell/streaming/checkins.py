"""Structured Streaming over check-ins: ingest, running trends, timers, windows and audits.

The windowed functions take a batch or a streaming DataFrame alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tidewell.operators.mutations import inference_rows
from tidewell.operators.series import alerts
from tidewell.session import work_folder

WATERMARK = "7 days"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def arriving_files(spark: SparkSession, folder: str, ddl: str, pattern: str | None = None, per_batch: int = 1000) -> DataFrame:
    """Files picked up once each (STR11)."""
    reader = spark.readStream.schema(ddl).option("maxFilesPerTrigger", per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(folder)


def run_available(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process all that has arrived, then stop."""
    query = stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Write each micro-batch under its number: a replayed batch replaces itself."""
    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


# --- ingest -------------------------------------------------------------------------------------
def ingest(records: DataFrame, folder: str, checkpoint: str) -> None:
    """Nested inference records fanned out into fact and edge tables (STR1)."""
    def write(df: DataFrame, batch: int) -> None:
        df.persist()
        try:
            for name, table in inference_rows(df).items():
                table.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")
        finally:
            df.unpersist()

    run_available(records, write, checkpoint)


def once_per_batch_id(stream: DataFrame, column: str = "batch_id", ts: str = "ts", watermark: str = WATERMARK) -> DataFrame:
    """Queued offline batches applied once (STR4); batch input is plainly deduplicated."""
    if not stream.isStreaming:
        return stream.groupBy(column).agg(F.min_by(F.struct("*"), F.struct(ts)).alias("_r")).select("_r.*")
    return stream.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([column])


# --- windows ------------------------------------------------------------------------------------
def _marked(df: DataFrame, watermark: str) -> DataFrame:
    return df.withWatermark("ts", watermark) if df.isStreaming else df


def period_summary(score: DataFrame, days: int = 7, watermark: str = WATERMARK) -> DataFrame:
    """Tumbling daily, weekly or 30-day summaries (STR5)."""
    return (
        _marked(score, watermark)
        .groupBy("user_id", F.window("ts", f"{days} days").alias("w"))
        .agg(F.count("*").alias("n"), F.avg("risk").alias("mean_risk"), F.max("risk").alias("peak_risk"))
        .select("user_id", F.col("w.start").alias("start"), "n", "mean_risk", "peak_risk")
    )


def trailing_summary(score: DataFrame, days: int = 30, step_days: int = 1, watermark: str = WATERMARK) -> DataFrame:
    """Sliding windows of ``days`` ending every ``step_days`` (STR6), from panes of one step each.

    A batch merges panes: the steps are cut into blocks as long as a window, so a window is the end of one
    block and the start of the next. Running totals from both ends of the blocks give every window as the
    sum of two rows, whatever its length; nothing is copied per window and nothing is subtracted. A pane
    row is moved once, by user, of whom there is one row per active step. A stream reduces rows to panes
    first as well, and spreads the panes. ``days`` must be a multiple of ``step_days``.
    """
    steps = days // step_days
    if steps < 1 or steps * step_days != days:
        raise ValueError("days must be a multiple of step_days")
    if score.isStreaming:
        panes = _marked(score, watermark).groupBy("user_id", F.window("ts", f"{step_days} days").alias("w")).agg(F.count("*").alias("n"), F.sum("risk").alias("s"), F.max("risk").alias("peak_risk"))
        rows = panes.groupBy("user_id", F.window(F.window_time("w"), f"{days} days", f"{step_days} days").alias("w")).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("peak_risk").alias("peak_risk"))
        return rows.select("user_id", F.col("w.end").alias("until"), "n", (F.col("s") / F.col("n")).alias("mean_risk"), "peak_risk")
    panes = score.groupBy("user_id", F.window("ts", f"{step_days} days")["end"].alias("end")).agg(F.count("*").alias("n"), F.sum("risk").alias("s"), F.max("risk").alias("m"))
    panes = panes.withColumn("p", F.floor(F.unix_date(F.to_date("end")) / step_days)).withColumn("b", F.floor(F.col("p") / steps))
    user, block = Window.partitionBy("user_id"), Window.partitionBy("user_id", "b")
    start = block.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    end = block.orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    total = lambda w: F.struct(F.sum("n").over(w).alias("n"), F.sum("s").over(w).alias("s"), F.max("m").over(w).alias("m"))
    panes = panes.select("user_id", "end", "p", "b", total(start).alias("head"), total(end).alias("tail"), F.lead("p").over(user.orderBy("p")).alias("after"), F.lag("p").over(user.orderBy("p")).alias("before"))
    last = F.least(F.col("after") - 1, (F.col("b") + 1) * steps - 1)  # the pane is the latest one for these steps of its block
    first = F.greatest(F.col("before") + 1, F.col("b") * steps + 1)  # and the earliest one of its block for windows that begin at these
    spread = lambda low, high, part: F.transform(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>")), lambda k: F.struct(k.alias("k"), F.col(part).alias("v")))
    at = F.concat(spread(F.lit(0).cast("long"), last - F.col("p"), "head"), spread(first - F.col("p") + steps - 1, F.lit(steps - 1).cast("long"), "tail"))
    rows = panes.select("user_id", "end", F.explode(at).alias("w"))
    rows = rows.select("user_id", (F.col("end") + F.make_dt_interval((F.col("w.k") * step_days).cast("int"))).alias("until"), "w.v.*")
    return rows.groupBy("user_id", "until").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean_risk"), F.max("m").alias("peak_risk"))


def bursts(score: DataFrame, gap: str = "7 days", watermark: str = WATERMARK) -> DataFrame:
    """Check-ins between gaps (STR7)."""
    return (
        _marked(score, watermark)
        .groupBy("user_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("n"), F.avg("risk").alias("mean_risk"))
        .select("user_id", F.col("w.start").alias("start"), "n", "mean_risk")
    )


# --- running trend ------------------------------------------------------------------------------
#: Sums over the scores older than the watermark, the time of the user's timer, and whether it has fired.
SUMS_DDL = ("n BIGINT, sx DOUBLE, six DOUBLE, x1 DOUBLE, x2 DOUBLE, x3 DOUBLE, ema DOUBLE, high BIGINT, last_us BIGINT, n_gaps BIGINT, "
            "confidence DOUBLE, timer BIGINT, warned BOOLEAN")
TREND = ("event STRING, n BIGINT, current_risk DOUBLE, average_risk DOUBLE, slope DOUBLE, moving_average DOUBLE, "
         "exponential_trend DOUBLE, step DOUBLE, high BIGINT, n_gaps BIGINT, last_confidence DOUBLE")
SUMS = (0, 0.0, 0.0, np.nan, np.nan, np.nan, 0.0, 0, 0, 0, np.nan)
DAY_US = 86_400_000_000


def fold_scores(sums: tuple, rows: list[tuple], alpha: float = 0.3, high: float = 0.7, gap_days: int = 7) -> tuple:
    """Add scores, given in order as (time in us, id, risk, confidence), to the sums of a series."""
    if not rows:
        return sums
    n, sx, six, x1, x2, x3, ema, hits, last_us, gaps, _ = sums
    x = np.array([r[2] for r in rows])
    at = np.array([r[0] for r in rows] if n == 0 else [last_us, *(r[0] for r in rows)])
    m = len(x)
    six += float(np.dot(np.arange(n, n + m), x))
    decay = (1 - alpha) ** np.arange(m - 1, -1, -1)
    if n == 0:
        ema = float(x[0] * decay[0] + alpha * np.dot(decay[1:], x[1:]))
    else:
        ema = float(ema * (1 - alpha) ** m + alpha * np.dot(decay, x))
    gaps += int((np.diff(at) // DAY_US > gap_days).sum())
    tail = ([x3, x2, x1] + list(x))[-3:]
    confidence = np.nan if rows[-1][3] is None else float(rows[-1][3])
    return (n + m, sx + float(x.sum()), six, float(tail[2]), float(tail[1]), float(tail[0]), ema, hits + int((x >= high).sum()), int(at[-1]), gaps, confidence)


def trend_of(user: int, s: tuple, event: str) -> dict:
    n, sx, six, x1, x2, x3, ema, hits, _, gaps, confidence = s
    slope = (six - (n - 1) / 2 * sx) / (n * (n * n - 1) / 12) if n > 1 else 0.0
    last = [v for v in (x1, x2, x3) if not np.isnan(v)]
    return {"user_id": user, "event": event, "n": n, "current_risk": x1, "average_risk": sx / n, "slope": slope, "moving_average": sum(last) / len(last),
            "exponential_trend": ema, "step": x1 - x2 if n > 1 else 0.0, "high": hits, "n_gaps": gaps, "last_confidence": float(confidence)}


class TrendProcessor(StatefulProcessor):
    """Keeps a user's sums, the scores younger than the watermark, and one event-time timer.

    The first timer says that the user stays away; the second, at the expiry, ends the state. New scores
    replace either.
    """

    def __init__(self, id_type: str, gap_ms: int, expire_ms: int, alert_gap_days: int):
        self.id_type, self.gap_ms, self.expire_ms, self.alert_gap_days = id_type, gap_ms, expire_ms, alert_gap_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", SUMS_DDL)
        self.waiting = handle.getListState("waiting", f"us BIGINT, id {self.id_type}, risk DOUBLE, confidence DOUBLE")

    def _held(self) -> tuple[tuple, int | None, bool]:
        held = self.sums.get()
        return (SUMS, None, False) if held is None else (tuple(held[:11]), held[11], held[12])

    def _keep(self, sums: tuple, old: int | None, timer: int, warned: bool) -> None:
        if old is not None and old != timer:
            self.handle.deleteTimer(old)
        if old != timer:
            self.handle.registerTimer(timer)
        self.sums.update((*sums, timer, warned))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now_ms = timerValues.getCurrentWatermarkInMs()
        sums, timer, _ = self._held()
        fresh = []
        for part in rows:
            part = part.dropna(subset=["risk", "us"])
            confidence = part["confidence"].astype(float)
            fresh += zip(part["us"].astype("int64").tolist(), part["id"].tolist(), part["risk"].astype(float).tolist(), confidence.astype(object).where(confidence.notna(), None).tolist())
        waiting = list(self.waiting.get())
        ends = max([sums[8], *(r[0] for r in waiting)]) + self.expire_ms * 1000
        if fresh and (sums[0] or waiting) and ends <= now_ms * 1000 and ends <= min(r[0] for r in fresh):
            sums, waiting = SUMS, []  # the state has ended, though its timer had no batch to fire in
            self.waiting.clear()
        waiting = sorted(waiting + fresh, key=lambda r: (r[0], r[1] is not None, r[1]))
        if not waiting and sums[0] == 0:
            return
        ripe = sum(r[0] < now_ms * 1000 for r in waiting)
        if ripe:
            sums, waiting = fold_scores(sums, waiting[:ripe], gap_days=self.alert_gap_days), waiting[ripe:]
            if waiting:
                self.waiting.put(waiting)
            else:
                self.waiting.clear()
        elif fresh:
            self.waiting.appendList(fresh)
        now = fold_scores(sums, waiting, gap_days=self.alert_gap_days)
        self._keep(sums, timer, max(now[8] // 1000 + self.gap_ms, now_ms + 1), False)
        yield pd.DataFrame([trend_of(key[0], now, "score")])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        sums, timer, warned = self._held()
        if timer != expiredTimerInfo.getExpiryTimeInMs():
            return
        waiting = sorted(self.waiting.get(), key=lambda r: (r[0], r[1] is not None, r[1]))
        now = fold_scores(sums, waiting, gap_days=self.alert_gap_days)
        self.waiting.clear()
        if warned:
            self.sums.clear()
            return
        # the fired timer is removed by Spark
        self._keep(now, None, max(now[8] // 1000 + self.expire_ms, timerValues.getCurrentWatermarkInMs() + 1), True)
        yield pd.DataFrame([trend_of(key[0], now, "missing_checkins")])

    def close(self) -> None:
        pass


def running_trend(score: DataFrame, gap_days: float = 7, watermark: str = WATERMARK, expire_days: float = 365, alert_gap_days: int = 7) -> DataFrame:
    """Trend after each micro-batch, and a ``missing_checkins`` row once a user stays away (STR2, STR3).

    Scores may arrive in any order within the watermark: those younger than it wait in a list state, so
    each row given is the trend over all scores in time order, as in a batch. Older ones are held as
    sums, so the state grows with the watermark and not with the history; it ends once the watermark is
    ``expire_days`` past the user's last score, and a later score begins a new series. A batch appends its scores to the list, and writes the list anew only when the
    watermark has passed some of it. ``score`` has ``user_id, id, ts, risk`` and may have ``confidence``;
    rows without time or risk are left out. State of this kind needs the RocksDB store, which is set on the session.
    """
    score.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    types = dict(score.dtypes)
    gap_ms, expire_ms = int(gap_days * 86_400_000), int(max(expire_days, gap_days) * 86_400_000)
    confidence = F.col("confidence").cast("double") if "confidence" in score.columns else F.lit(None).cast("double")
    marked = score.select("user_id", "id", F.col("ts").cast("timestamp").alias("ts"), F.col("risk").cast("double").alias("risk"), confidence.alias("confidence")).withWatermark("ts", watermark)
    return marked.withColumn("us", F.unix_micros("ts")).groupBy("user_id").transformWithStateInPandas(
        TrendProcessor(types["id"], gap_ms, expire_ms, alert_gap_days), f"user_id {types['user_id']}, {TREND}", "append", "EventTime"
    )


def trend_alerts(trend: DataFrame, **thresholds) -> DataFrame:
    """Alerts that each new trend row raises, stateless, so a stream can write them as they come (STR2).

    Negative mood is a separate stream of emotions and raises nothing here.
    """
    inputs = trend.filter("event = 'score'").select(
        "user_id", "n", F.col("current_risk").alias("last"), (F.col("current_risk") - F.col("step")).alias("prev"), F.col("high").alias("n_high"), "slope", "n_gaps",
        "last_confidence", F.lit(0).alias("mood_n"), F.lit(None).cast("double").alias("mood_mean"),
    )
    return alerts(inputs, **thresholds)


def incremental_profile(checkins: DataFrame) -> DataFrame:
    """Additive profile parts kept by built-in aggregates in update mode (STR10)."""
    return checkins.groupBy("user_id").agg(
        F.count("*").alias("sessions"), F.avg("risk").alias("average_risk"), F.max("risk").alias("peak_risk"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.least(F.lit(1.0), F.count("*") / 12.0).alias("engagement_score"),
    )


def newest_update(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Latest update per key over the numbered micro-batches."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")


# --- late rows and audit ------------------------------------------------------------------------
def late_splitter(folder: str, key: str = "user_id", ts: str = "ts") -> Callable[[DataFrame, int], None]:
    """Rows older than what the user already delivered in earlier batches go to a side table (STR8).

    ``marks/batch=n`` holds one row per user seen up to batch n, so a batch reads only the table of the
    batch before it.
    """
    def write(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        kind = dict(df.dtypes)[ts]
        if batch > 0:
            seen = spark.read.schema(f"{key} {dict(df.dtypes)[key]}, mark {kind}").parquet(f"{folder}/marks/batch={batch - 1}")
        else:
            seen = df.select(F.col(key), F.lit(None).cast(kind).alias("mark")).limit(0)
        rows = df.join(seen, key, "left")
        late = F.coalesce(F.col(ts) < F.col("mark"), F.lit(False))
        rows.filter(late).drop("mark").write.mode("overwrite").parquet(f"{folder}/late/batch={batch}")
        rows.filter(~late).drop("mark").write.mode("overwrite").parquet(f"{folder}/on_time/batch={batch}")
        marks = seen.unionByName(df.select(key, F.col(ts).alias("mark"))).groupBy(key).agg(F.max("mark").alias("mark"))
        marks.write.mode("overwrite").parquet(f"{folder}/marks/batch={batch}")

    return write


def audit_stream(entries: DataFrame, path: str, checkpoint: str) -> None:
    """Append-only audit sink (STR9)."""
    query = entries.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def stream_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return its numbered output."""
    spark = stream.sparkSession
    folder = work_folder(spark, name)
    run_available(stream, batch_writer(f"{folder}/out"), f"{folder}/checkpoint", mode)
    return spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out")
