"""Array expressions for vectors and sample arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.numeric import let


def _d(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(_d(v), F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(_d(a), _d(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def mean(v: Column) -> Column:
    return F.when(F.size(v) > 0, total(v) / F.size(v)).otherwise(0.0)


def spread(v: Column) -> Column:
    """Population deviation."""
    def squares(m: Column) -> Column:
        return F.aggregate(_d(v), F.lit(0.0), lambda a, x: a + (x - m) * (x - m))

    return F.when(F.size(v) > 0, F.sqrt(let(mean(v), squares) / F.size(v))).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty or unequal lengths; a zero norm counts as 1 (ARR6)."""
    def safe(v: Column) -> Column:
        n = norm(v)
        return F.when(n == 0, 1.0).otherwise(n)

    usable = (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(usable, dot(a, b) / (safe(a) * safe(b))).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over united elements; two empty sets count as equal (ARR7)."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def session_similarity(symptoms_a: Column, symptoms_b: Column, emotions_a: Column, emotions_b: Column) -> Column:
    """Mean of both Jaccard values (ARR8)."""
    return (jaccard(symptoms_a, symptoms_b) + jaccard(emotions_a, emotions_b)) / 2.0


def padded(v: Column, length: Column | int) -> Column:
    """Cut or zero-pad to a length (ARR1)."""
    length = F.lit(length) if isinstance(length, int) else length
    v = F.coalesce(v, F.expr("CAST(array() AS ARRAY<FLOAT>)"))
    return F.concat(F.slice(v, F.lit(1), length), F.array_repeat(F.lit(0.0).cast("float"), F.greatest(length - F.size(v), F.lit(0))))


def mask(v: Column, length: Column | int) -> Column:
    length = F.lit(length) if isinstance(length, int) else length
    held = F.least(F.coalesce(F.size(v), F.lit(0)), length)
    one, zero = F.lit(1.0).cast("float"), F.lit(0.0).cast("float")
    return F.concat(F.array_repeat(one, held), F.array_repeat(zero, length - held))


def padded_matrix(m: Column, rows: int, width: int) -> Column:
    """Pad rows and columns of a matrix (ARR2)."""
    body = F.transform(F.slice(m, 1, rows), lambda r: padded(r, width))
    empty = F.array_repeat(F.lit(0.0).cast("float"), width)
    return F.concat(body, F.array_repeat(empty, F.greatest(F.lit(rows) - F.size(m), F.lit(0))))


def has_nan(v: Column) -> Column:
    return F.exists(v, lambda x: F.isnan(x))


def has_inf(v: Column) -> Column:
    return F.exists(v, lambda x: F.abs(x) == float("inf"))


def problems(v: Column, dim: Column | int) -> Column:
    """Names of what is wrong with a vector (ARR4)."""
    dim = F.lit(dim) if isinstance(dim, int) else dim
    return F.array_compact(
        F.array(
            F.when(v.isNull(), "missing_array"),
            F.when(has_nan(v), "nan_values"),
            F.when(has_inf(v), "inf_values"),
            F.when(F.size(v) != dim, "shape_mismatch"),
            F.when(dim <= 0, "invalid_dimension"),
        )
    )


def zscored(v: Column) -> Column:
    """Vector minus its mean over its deviation (MTH7)."""
    stats = F.struct(mean(v).alias("m"), (spread(v) + 1e-8).alias("s"))
    return let(stats, lambda t: F.transform(_d(v), lambda x: (x - t["m"]) / t["s"]))


def min_maxed(v: Column) -> Column:
    ends = F.struct(F.array_min(_d(v)).alias("a"), F.array_max(_d(v)).alias("b"))
    return let(ends, lambda t: F.transform(_d(v), lambda x: (x - t["a"]) / (t["b"] - t["a"] + 1e-8)))


def l2_scaled(v: Column) -> Column:
    return let(F.greatest(norm(v), F.lit(1e-8)), lambda n: F.transform(_d(v), lambda x: x / n))


def amplitude(v: Column, method: str = "peak") -> Column:
    """Peak, RMS or loudness scaling of samples (MTH8)."""
    rms = F.sqrt(dot(v, v) / F.size(v)) + 1e-8
    if method == "rms":
        factor = F.lit(0.1) / rms
    elif method == "lufs":
        factor = F.lit(10 ** (-23.0 / 20) * 0.1) / rms
    else:
        factor = F.lit(0.95) / (F.array_max(F.transform(_d(v), F.abs)) + 1e-8)
    return let(factor, lambda f: F.transform(_d(v), lambda x: x * f))


def energy_score(logits: Column) -> Column:
    """Minus log-sum-exp (EV21)."""
    def total_from(top: Column) -> Column:
        return top + F.log(F.aggregate(_d(logits), F.lit(0.0), lambda a, x: a + F.exp(x - top)))

    return -let(F.array_max(_d(logits)), total_from)


def entropy(probs: Column, floor: float = 1e-8) -> Column:
    """Shannon entropy with a lower clip (EV12)."""
    clipped = F.transform(_d(probs), lambda p: F.greatest(F.lit(floor), F.least(F.lit(1.0), p)))
    return -F.aggregate(clipped, F.lit(0.0), lambda a, p: a + p * F.log(p))


def audio_quality(v: Column, silence_ratio: Column, seconds: Column) -> dict[str, Column]:
    """Clipping, noise floor, SNR, score and flags of a sample array (MTH15)."""
    size = F.size(v)
    clipping = F.when(size > 0, F.size(F.filter(v, lambda x: F.abs(x) > 0.99)) / size).otherwise(0.0)
    sorted_abs = F.array_sort(F.transform(_d(v), F.abs))
    at = (size - 1) * 0.1
    low = F.get(sorted_abs, F.floor(at).cast("int"))
    high = F.get(sorted_abs, F.ceil(at).cast("int"))
    floor_ = F.when(size > 0, low + (high - low) * (at - F.floor(at))).otherwise(0.0)
    rms = F.when(size > 0, F.sqrt(dot(v, v) / size)).otherwise(0.0)
    snr = 20.0 * F.log10((rms + 1e-8) / (floor_ + 1e-8))
    score = 1.0 - F.least(F.lit(0.4), clipping * 4) - F.least(F.lit(0.3), F.greatest(F.lit(0.0), silence_ratio - 0.5))
    flags = F.array_compact(
        F.array(F.when(clipping > 0.05, "clipping"), F.when(silence_ratio > 0.85, "excessive_silence"), F.when(seconds <= 0, "zero_duration"))
    )
    return {"clipping": clipping, "snr": snr, "score": F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), "flags": F.array_join(flags, ",")}


def visual_quality(frames: Column, faces: Column, landmarks: Column, blur: Column, seconds: Column) -> Column:
    """Face rate, landmark rate, sharpness and length (MTH16)."""
    n = F.greatest(frames, F.lit(1))
    blur_score = F.when(blur.isNull(), 0.5).otherwise(1.0 - F.least(F.lit(1.0), blur / 500.0))
    return F.least(
        F.lit(1.0), 0.3 * (faces / n) + 0.3 * (landmarks / n) + 0.2 * (1.0 - blur_score) + 0.2 * F.least(F.lit(1.0), seconds / 60.0)
    )
