"""Quality, sync and label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.numeric import blank_or_zero, r4, rounded
from tidewell.schemas import LABEL_INTS, LABEL_TEXTS


def label_class(raw: Column) -> Column:
    """Normalise a label text to one of four classes (PRJ8)."""
    text = F.lower(F.trim(raw))
    out = None
    for name, texts in LABEL_TEXTS.items():
        out = F.when(text.isin(*texts), name) if out is None else out.when(text.isin(*texts), name)
    return out.otherwise("unknown")


def label_int(label: Column, mapping: dict[str, int] | None = None) -> Column:
    """Label to integer through a map, -1 for anything else (PRJ9)."""
    mapping = LABEL_INTS if mapping is None else mapping
    pairs = [F.lit(v) for kv in mapping.items() for v in kv]
    return F.coalesce(F.create_map(*pairs)[label], F.lit(-1)).cast("long")


def category(score: Column) -> Column:
    """Quality band (PRJ10)."""
    return (
        F.when(score >= 0.85, "excellent")
        .when(score >= 0.70, "good")
        .when(score >= 0.50, "acceptable")
        .when(score >= 0.30, "poor")
        .otherwise("rejected")
    )


def positive_label(raw: Column) -> Column:
    """Prediction label to 0/1 (PRJ13)."""
    return F.lower(raw).isin("high", "1", "depressed", "positive").cast("int").cast("long")


def participant_quality(
    quality: Column, sync: Column, has_audio: Column, has_visual: Column, has_text: Column, participant: Column
) -> dict[str, Column]:
    """Component scores and the weighted total of one session (MTH12)."""
    q = blank_or_zero(quality, 0.8)
    audio = F.when(has_audio, q).otherwise(0.0)
    video = F.when(has_visual, q).otherwise(0.0)
    text = F.when(has_text, q).otherwise(0.0)
    tie = blank_or_zero(sync, 1.0)
    meta = F.when(F.coalesce(participant, F.lit("")) != "", 0.9).otherwise(0.5)
    total = 0.25 * audio + 0.2 * video + 0.25 * text + 0.15 * tie + 0.15 * meta
    return {"audio": r4(audio), "video": r4(video), "transcript": r4(text), "sync": r4(tie), "overall": r4(total)}


def session_quality(
    quality: Column, sync: Column, has_audio: Column, has_visual: Column, has_text: Column, has_metadata: Column, modalities: int = 5
) -> Column:
    """Weighted total scaled by the share of present modalities (MTH11)."""
    def part(flag: Column) -> Column:
        return F.when(flag, quality).otherwise(0.0)

    base = (
        0.25 * part(has_audio) + 0.2 * part(has_visual) + 0.25 * part(has_text) + 0.15 * sync
        + 0.15 * F.when(has_metadata, 1.0).otherwise(0.5)
    )
    present = has_audio.cast("int") + has_visual.cast("int") + has_text.cast("int")
    return F.least(F.lit(1.0), base * (0.5 + 0.5 * (present / float(modalities))))


def parser_quality(
    audio_len: Column, video_len: Column, text_len: Column, text_quality: Column, sync: Column,
    has_audio: Column, has_video: Column, has_text: Column,
) -> dict[str, Column]:
    """Mean of five component scores incl. completeness (MTH13)."""
    def there(length: Column) -> Column:
        return F.coalesce(length, F.lit(0)) != 0

    audio = F.when(has_audio & there(audio_len), 1.0).otherwise(0.0)
    video = F.when(has_video & there(video_len), 1.0).otherwise(0.0)
    text = F.coalesce(text_quality, F.when(has_text, 1.0).otherwise(0.0))
    tie = F.coalesce(sync, F.lit(0.0))
    expected = has_audio.cast("int") + has_video.cast("int") + has_text.cast("int")
    present = there(audio_len).cast("int") + there(video_len).cast("int") + there(text_len).cast("int")
    complete = F.when(expected > 0, present / expected).otherwise(0.0)
    return {"metadata_completeness": r4(complete), "overall": r4((audio + video + text + tie + complete) / 5.0)}


def sample_quality(exists: Column, label: Column, errors: Column) -> dict[str, Column]:
    """File, label and corruption score of one sample (MTH14)."""
    there = F.when(exists, 1.0).otherwise(0.0)
    labelled = F.when(label.isin("unknown", "excluded"), 0.3).otherwise(1.0)
    corruption = F.greatest(F.lit(0.0), 1.0 - errors * 0.25)
    return {"corruption": corruption, "confidence": labelled, "overall": r4((there + labelled + corruption + there) / 4.0)}


def sync_score(seconds: Column, chars: Column, frames: Column) -> Column:
    """Expected 15 characters and 30 frames per second (MTH9)."""
    def share(count: Column, rate: float) -> Column:
        expected = seconds * rate
        return F.least(count, expected) / F.greatest(expected, F.lit(1.0))

    picture = F.when(frames > 0, share(frames, 30.0)).otherwise(1.0)
    return F.when(seconds <= 0, 0.0).otherwise(r4(0.6 * share(chars, 15.0) + 0.4 * picture))


def alignment(durations: Column) -> dict[str, Column]:
    """Offset and ratio of a list of durations; halved beyond 30 seconds (MTH10)."""
    kept = F.filter(durations, lambda d: d.isNotNull() & (d != 0))
    offset = rounded(F.array_max(kept) - F.array_min(kept), 3)
    base = r4(F.least(F.lit(1.0), F.when(F.array_max(kept) > 0, F.array_min(kept) / F.array_max(kept)).otherwise(0.0)))
    score = F.when(offset > 30.0, r4(base * 0.5)).otherwise(base)
    few = F.size(kept) < 2
    return {
        "offset": F.when(~few, offset),
        "score": F.when(few, F.when(F.size(kept) == 1, 1.0).otherwise(0.0)).otherwise(score),
    }
