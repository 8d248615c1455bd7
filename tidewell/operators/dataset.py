"""Dataset indexing, statistics, set checks and normalisation over modality rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.multiset import multiset_state, state_hash
from tidewell.functions.numeric import blank_or_zero, r4
from tidewell.functions.quality import sync_score
from tidewell.operators.ordered import SLICE_ROWS, exact_quantiles, sequenced


def session_index(index: DataFrame) -> DataFrame:
    """One wide row per (participant, session, dataset) from flat modality rows (AGG1).

    The first row of a group is the one with the smallest file path.
    """
    modality = F.lower("modality")
    first = F.min_by(
        F.struct("split", "label", "language", "audio_length", "transcript_length", "quality_score", "sync_score"), "file_path"
    )

    def path(test: Column) -> Column:
        return F.coalesce(F.min(F.when(test, F.col("file_path"))), F.lit(""))

    picture = F.col("modality").isin("video", "visual", "facial_features")
    grouped = index.groupBy("participant_id", "session_id", "dataset").agg(
        first.alias("f"),
        F.max(F.col("modality") == "audio").alias("has_audio"),
        F.max(F.col("modality").contains("transcript")).alias("has_transcript"),
        F.max(picture).alias("has_visual"),
        path(F.col("modality") == "audio").alias("audio_path"),
        path(modality.contains("transcript")).alias("transcript_path"),
        path(modality.rlike("video|visual|facial")).alias("video_path"),
    )
    return grouped.select(
        "participant_id",
        "session_id",
        "dataset",
        F.coalesce("f.split", F.lit("unknown")).alias("split"),
        F.coalesce("f.label", F.lit("unknown")).alias("label"),
        F.coalesce("f.language", F.lit("en")).alias("language"),
        "has_audio",
        "has_transcript",
        "has_visual",
        "audio_path",
        "transcript_path",
        "video_path",
        blank_or_zero("f.audio_length", 0.0).alias("audio_length"),
        F.coalesce("f.transcript_length", F.lit(0)).cast("long").alias("transcript_length"),
        blank_or_zero("f.quality_score", 0.8).alias("quality_score"),
        blank_or_zero("f.sync_score", 1.0).alias("sync_score"),
    )


def grouped_counts(index: DataFrame, columns: Sequence[str] = ("dataset", "modality", "label", "language", "split")) -> DataFrame:
    """Counts per value of several columns in one pass (AGG7); a null split is ``unassigned``."""
    pairs = F.explode(
        F.array(*[
            F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c), F.lit("unassigned" if c == "split" else "unknown")).alias("value"))
            for c in columns
        ])
    )
    return index.select(pairs.alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("n"))


def present_only(name: str) -> Column:
    """The value where it is set and not 0, else null."""
    return F.when(F.col(name) != 0, F.col(name))


def participant_statistics(participants: DataFrame) -> DataFrame:
    """Counts, mean, median and total hours; zeros and nulls skipped (AGG8)."""
    d = present_only("audio_length")
    median = exact_quantiles(participants.select(d.alias("x")), "x", [0.5]).select(F.col("q0").alias("median_duration"))
    return participants.agg(
        F.count("*").alias("participant_count"),
        F.count_distinct("session_id").alias("session_count"),
        F.avg(d).alias("average_duration"),
        (F.sum(d) / 3600.0).alias("total_hours"),
        F.avg(present_only("transcript_length")).alias("avg_transcript_length"),
    ).crossJoin(median)


def session_statistics(sessions: DataFrame) -> DataFrame:
    """Means, missing modalities and the quality description (AGG9)."""
    q = "quality_score"
    middle = exact_quantiles(sessions, q, [0.25, 0.5, 0.75]).toDF("quality_q25", "quality_q50", "quality_q75")
    return sessions.agg(
        F.count_distinct("participant_id").alias("participants"),
        F.count("*").alias("sessions"),
        F.avg("audio_length").alias("avg_audio_length"),
        F.avg("transcript_length").alias("avg_transcript_length"),
        F.count_if(~F.col("has_audio")).alias("missing_audio"),
        F.count_if(~F.col("has_visual")).alias("missing_visual"),
        F.count_if(~F.col("has_transcript")).alias("missing_text"),
        F.avg(q).alias("quality_mean"),
        F.stddev_samp(q).alias("quality_std"),
        F.min(q).alias("quality_min"),
        F.max(q).alias("quality_max"),
    ).crossJoin(middle)


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Moments and quartiles per column, sample forms with bias correction (AGG10)."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("x")) for c in columns])).alias("p")).select("p.*")
    agg = long.filter("x IS NOT NULL AND NOT isnan(x)").groupBy("field").agg(
        F.count("*").alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("variance"), F.stddev_samp("x").alias("std"),
        F.skewness("x").alias("g1"), F.kurtosis("x").alias("g2"),
    )
    quartiles = exact_quantiles(long, "x", [0.25, 0.5, 0.75], by=["field"])
    agg = agg.join(quartiles, "field")
    n = F.col("n").cast("double")
    skew = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(0.0)
    kurt = F.when(n > 3, ((n + 1) * F.col("g2") + 6) * (n - 1) / ((n - 2) * (n - 3))).otherwise(0.0)
    return agg.select(
        "field", "n", "mean", F.col("q1").alias("median"), "variance", "std",
        F.coalesce(skew, F.lit(0.0)).alias("skewness"), F.coalesce(kurt, F.lit(0.0)).alias("kurtosis"),
        F.col("q0").alias("q25"), F.col("q2").alias("q75"),
    )


def class_distribution(df: DataFrame, label: str = "label", low: float = 0.15) -> DataFrame:
    """Smallest and largest class share and a sampling advice (AGG11)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    share = F.min("n") / F.sum("n")
    return counts.agg(
        F.sum("n").alias("total"),
        F.count("*").alias("classes"),
        (F.min("n") / F.max("n")).alias("imbalance_ratio"),
        share.alias("minority_pct"),
        (F.max("n") / F.sum("n")).alias("majority_pct"),
        F.when(share < low, "weighted_sampler").otherwise("random").alias("recommended_sampling"),
    )


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """n / (classes * class size) over labels from 0 up (AGG12)."""
    counts = df.filter(F.col(label) >= 0).groupBy(label).agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    return counts.select(label, "n", (F.sum("n").over(every) / (F.count("*").over(every) * F.col("n"))).alias("weight"))


def sample_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Inverse class frequency per row, 0 for unlabelled rows; the joined table has one row per class."""
    counts = df.filter(F.col(label) >= 0).groupBy(label).agg(F.count("*").alias("_n"))
    return df.join(F.broadcast(counts), label, "left").withColumn("sample_weight", F.coalesce(1.0 / F.col("_n"), F.lit(0.0))).drop("_n")


def extents(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.avg(column).alias("avg_duration"), F.max(column).alias("max_duration"), F.min(column).alias("min_duration"))


def manifest(index: DataFrame) -> DataFrame:
    """Sample count, class and language counts and an order-free content hash (AGG22).

    The maps hold one entry per class and per language, both closed lists.
    """
    def counts(column: str) -> DataFrame:
        return index.groupBy(column).agg(F.count("*").alias("n")).agg(
            F.sum("n").alias("sample_count"),
            F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", F.coalesce(column, F.lit("unknown")), F.col("n").cast("string")))), ",").alias(f"{column}s"),
        )

    content = multiset_state(index, ("participant_id", "file_path")).select(state_hash().alias("content_hash"))
    return counts("label").crossJoin(counts("language").drop("sample_count")).crossJoin(content)


def passport(sessions: DataFrame, approved: bool | None = None) -> DataFrame:
    """The dataset's identity card in one row (AGG23)."""
    content = multiset_state(sessions, sessions.columns).select(state_hash().alias("content_hash"))
    return sessions.agg(
        F.count("*").alias("num_samples"),
        F.count_distinct("participant_id").alias("participants"),
        F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"),
        r4(F.avg("quality_score")).alias("quality_score"),
        F.lit("approved" if approved in (None, True) else "rejected").alias("validation_status"),
    ).crossJoin(content)


# --- first rows, duplicates and splits -----------------------------------------------------------
def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """First record per key by a stable order, as a grouped minimum (SET3, SRC8)."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("_f")).select(*keys, "_f.*")


def metadata_tables(index: DataFrame, order: Sequence[str] = ("file_path",)) -> dict[str, DataFrame]:
    """Participants, sessions, files by modality, labels and languages of an index (SNK5).

    The first record by ``order`` speaks for a participant or session. A duration of 0 or null is left
    empty. Null ids form one participant and one session of their own.
    """
    people = first_per(index, ["participant_id"], order, ["dataset", "label", "language"])
    return {
        "participants": people,
        "sessions": first_per(index, ["session_id"], order, ["participant_id", "dataset"]),
        "files": index.select("modality", "sample_id", "participant_id", "file_path", F.when(F.col("duration_seconds") != 0, F.col("duration_seconds")).alias("duration_seconds")),
        "labels": people.select("participant_id", "label"),
        "languages": people.select("participant_id", "language"),
    }


def best_file(files: DataFrame) -> DataFrame:
    """First file per (participant, modality); transcripts prefer names with "transcript" (SRC8)."""
    rank = F.when((F.col("modality") == "transcript") & ~F.lower("file_path").contains("transcript"), 1).otherwise(0)
    return files.groupBy("participant_id", "modality").agg(F.min_by("file_path", F.struct(rank, F.col("file_path"))).alias("file_path"))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once (SET4, SET5, SET7, SET8, SET9)."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def split_sets(df: DataFrame) -> DataFrame:
    """Per participant: in which of the three splits it occurs."""
    return df.filter("split IS NOT NULL").groupBy("participant_id").agg(
        *[F.max(F.col("split") == s).alias(s) for s in ("train", "dev", "test")], F.count_distinct("split").alias("splits")
    )


def split_overlap(df: DataFrame) -> DataFrame:
    """Participants shared by two splits (SET1)."""
    sets = split_sets(df)
    parts = [
        F.when(F.col(a) & F.col(b), F.lit(f"{a}/{b}")) for a, b in (("train", "dev"), ("train", "test"), ("dev", "test"))
    ]
    return sets.select("participant_id", F.explode(F.array_compact(F.array(*parts))).alias("pair"))


def split_leakage(df: DataFrame) -> DataFrame:
    return split_sets(df).filter("splits > 1").select("participant_id", "splits")


def conflicting_labels(df: DataFrame, source: str) -> DataFrame:
    """Participants whose official labels differ between sources (SET12)."""
    return df.filter("label <> 'unknown'").groupBy("participant_id").agg(
        F.count_distinct("label").alias("labels"),
        F.min(F.struct("label", source)).alias("a"),
        F.max(F.struct("label", source)).alias("b"),
    ).filter("labels > 1").select(
        "participant_id", F.concat_ws(" ", F.col("a.label"), F.lit("vs"), F.col("b.label")).alias("conflict")
    )


def split_summary(assigned: DataFrame, known: DataFrame) -> DataFrame:
    """Counts per split, overlaps, unassigned, and the verdict (DQ16)."""
    sets = split_sets(assigned)
    counts = sets.agg(
        *[F.count_if(s).alias(f"{s}_count") for s in ("train", "dev", "test")],
        F.count_if(F.col("splits") > 1).alias("overlapping"),
    )
    free = known.select("participant_id").distinct().join(sets.select("participant_id"), "participant_id", "left_anti").agg(
        F.count("*").alias("unassigned")
    )
    return counts.crossJoin(free).withColumn("valid", F.col("overlapping") == 0)


# --- set-wide statistics used row by row ---------------------------------------------------------
def with_totals(df: DataFrame, aggs: Sequence[Column]) -> DataFrame:
    """Attach a one-row aggregate of the table to each of its rows."""
    return df.crossJoin(F.broadcast(df.agg(*aggs)))


def zscore_outliers(df: DataFrame, column: str, threshold: float = 3.0, min_n: int = 3) -> DataFrame:
    """Absolute z above the threshold, population deviation, no flags below ``min_n`` rows (MTH1)."""
    kept = df.filter(F.col(column).isNotNull())
    rows = with_totals(kept, [F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"), F.count("*").alias("_n")])
    z = F.abs((F.col(column) - F.col("_m")) / (F.col("_s") + 1e-8))
    return rows.withColumn("z", z).withColumn("outlier", (F.col("_n") >= min_n) & (z > threshold)).drop("_m", "_s", "_n")


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair as rows, from one aggregate (MTH3)."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)]
    return one.select(F.explode(F.array(*cells)).alias("p")).select("p.*")


def scaled(df: DataFrame, column: str, method: str = "zscore") -> DataFrame:
    """minmax, robust, quantile or z-score scaling of a column (MTH6)."""
    x = F.col(column).cast("double")
    if method == "minmax":
        rows = with_totals(df, [F.min(column).alias("_a"), F.max(column).alias("_b")])
        out = (x - F.col("_a")) / (F.col("_b") - F.col("_a") + 1e-8)
    elif method == "robust":
        rows = df.crossJoin(F.broadcast(exact_quantiles(df, column, [0.25, 0.5, 0.75])))
        out = (x - F.col("q1")) / (F.col("q2") - F.col("q0") + 1e-8)
    elif method == "quantile":
        rows = df.crossJoin(F.broadcast(exact_quantiles(df, column, [0.05, 0.95])))
        raw = (x - F.col("q0")) / (F.col("q1") - F.col("q0") + 1e-8)
        out = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    else:
        rows = with_totals(df, [F.avg(column).alias("_a"), F.stddev_pop(column).alias("_b")])
        out = (x - F.col("_a")) / (F.col("_b") + 1e-8)
    return rows.withColumn("scaled", out).drop("_a", "_b", "q0", "q1", "q2")


def sync_by_session(utterance: DataFrame, durations: DataFrame) -> DataFrame:
    """Characters per session against its duration (MTH18)."""
    chars = utterance.groupBy("session_id").agg(F.sum(F.length("text")).alias("chars"))
    return durations.join(chars, "session_id").select(
        "session_id", "seconds", "chars", sync_score(F.col("seconds"), F.col("chars"), F.lit(0)).alias("sync_score")
    )


def feature_choice(sessions: DataFrame, features: DataFrame) -> DataFrame:
    """First match over priority-ordered candidates per (participant, modality) (JN17).

    ``features`` has ``participant_id, modality, priority, path``.
    """
    best = features.groupBy("participant_id", "modality").agg(F.min_by("path", F.struct("priority", "path")).alias("path"))
    return sessions.select("participant_id").distinct().join(best, "participant_id")


def stratified_oversample(df: DataFrame, label: str, row_id: str, seed: int = 42) -> DataFrame:
    """Rows repeated so that each class reaches about the largest class (TOP10).

    The whole part of the ratio is exact; the fraction is drawn by a hash of the row id.
    """
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    counts = counts.crossJoin(F.broadcast(counts.agg(F.max("_n").alias("_top"))))
    ratio = F.col("_top") / F.col("_n")
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(row_id)), F.lit(1_000_000)) / 1e6
    copies = (F.floor(ratio) + F.when(draw < ratio - F.floor(ratio), 1).otherwise(0)).cast("int")
    return df.join(F.broadcast(counts), label).withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).drop("_n", "_top")


def uniform(seed: str, number: Column) -> Column:
    """A number in [0, 1) from a seed and a row number; 52 bits of an MD5, so that other engines can draw the same."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-"), number.cast("string"))), 1, 13), 16, 10).cast("long") / float(1 << 52)


def weighted_sample(df: DataFrame, label: str, row_id: str, draws: int | None = None, seed: int = 42, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Sampling with replacement by inverse class frequency: ``draw`` from 0 and the row drawn (TOP10).

    Every draw takes a class, all alike, then a row of it, all alike; as many draws as rows, unless told.
    Draws and rows meet by (class, position in the class), so a row that is drawn very often is many rows of
    the draws' side of a join, which Spark can split, and no row is repeated by one task. Rows without a
    label are not drawn; draws are seeded and positions follow ``row_id``, so a run can be repeated.
    """
    rows = df.filter(F.col(label).isNotNull())
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    classes = counts.select(label, "_n", (F.row_number().over(Window.orderBy(label)) - 1).alias("_class"), F.count("*").over(Window.partitionBy()).alias("_k"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    known = classes.agg(F.max("_k"), F.max("_all")).first()  # classes and rows: two numbers
    if not known[0]:
        return rows.withColumn("draw", F.lit(0).cast("long")).limit(0)
    numbers = df.sparkSession.range(known[1] if draws is None else draws).withColumnRenamed("id", "draw")
    drawn = numbers.withColumn("_class", F.floor(uniform(f"{seed}-class", F.col("draw")) * known[0]).cast("int"))
    drawn = drawn.join(classes.select(label, "_n", "_class"), "_class")
    drawn = drawn.select("draw", label, (F.floor(uniform(f"{seed}-row", F.col("draw")) * F.col("_n")) + 1).alias("_pos"))
    placed = sequenced(rows, [label], [row_id], position="_pos", slice_rows=slice_rows)
    return drawn.join(placed, [label, "_pos"]).drop("_pos")


def kfold(df: DataFrame, row_id: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Seeded fold number from a hash of the row id (TOP11)."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), F.col(row_id)), F.lit(folds)))


def held_out(df: DataFrame, subject: str, held: str | int) -> DataFrame:
    """Leave-one-subject-out view for one held-out subject (TOP12)."""
    return df.withColumn("is_validation", F.col(subject) == F.lit(held))


def held_out_sizes(df: DataFrame, subject: str) -> DataFrame:
    """Validation and training size of every leave-one-subject-out fold, without writing the folds out."""
    counts = df.groupBy(subject).agg(F.count("*").alias("validation_rows"))
    total = df.agg(F.count("*").alias("_all"))
    return counts.crossJoin(F.broadcast(total)).select(
        F.col(subject).alias("held"), "validation_rows", (F.col("_all") - F.col("validation_rows")).alias("training_rows")
    )
