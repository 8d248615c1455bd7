"""Transcript tables: metrics per conversation and the text feature table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import text as tx
from tidewell.functions.numeric import r4, rounded


def transcript_metrics(utterance: DataFrame, key: str = "conv_id") -> DataFrame:
    """Words, vocabulary, odd tokens and the quality score per conversation (TXT18).

    Utterances are counted per row; the vocabulary is a two-step distinct count over tokens.
    """
    toks = tx.words(F.lower("text"))
    odd = F.filter(toks, lambda w: ~w.rlike(r"^[\p{L}\p{N}]+$") & ~w.isin("'", "-"))
    rows = utterance.select(key, F.size(toks).cast("long").alias("w"), F.size(odd).cast("long").alias("o"), toks.alias("t"))
    sums = rows.groupBy(key).agg(
        F.count("*").alias("utterances"),
        F.sum("w").alias("word_count"),
        F.count_if(F.col("w") > 0).alias("sentence_count"),
        F.sum("o").alias("unknown_tokens"),
    )
    vocab = rows.select(key, F.explode("t").alias("t")).distinct().groupBy(key).agg(F.count("*").alias("vocabulary_size"))
    out = sums.join(vocab, key, "left").withColumn("vocabulary_size", F.coalesce("vocabulary_size", F.lit(0)))
    score = F.least(F.lit(1.0), F.col("utterances") / 10.0 * 0.3 + F.col("vocabulary_size") / 100.0 * 0.3 + 0.4)
    return out.select(
        key, "utterances", "word_count", "sentence_count",
        rounded(F.col("word_count") / F.greatest("sentence_count", F.lit(1)), 2).alias("avg_sentence_length"),
        "vocabulary_size", "unknown_tokens",
        r4(score).alias("quality_score"),
    )


def text_features(documents: DataFrame, row_id: str, raw: str = "text", keep_columns: tuple[str, ...] = (), nfkc: bool = True) -> DataFrame:
    """All text stages in one projection, one row out per text (TXT21).

    ``stages`` lists each stage with its outcome, as an array of (stage, success, errors).
    """
    base = documents.select(row_id, *keep_columns, F.col(raw).alias("raw_text"), tx.clean(F.col(raw), nfkc=nfkc).alias("cleaned_text"))
    text = F.col("cleaned_text")
    # cleaned text holds single blanks only
    tokens = F.when(text == "", F.expr("CAST(array() AS ARRAY<STRING>)")).otherwise(F.split(text, " "))
    base = base.withColumns({"sentences": tx.sentences(text), "tokens": tokens})
    lang = tx.language_columns(text)
    flags = tx.encoding_errors(F.col("raw_text"))
    base = base.withColumns({
        "language": lang["primary"], "language_confidence": lang["confidence"], "mixed": lang["mixed"],
        **{f"sentiment_{k}": v for k, v in tx.sentiment(text).items() if k in ("label", "compound")},
        "emotions": tx.emotions(text),
        "keywords": tx.keyword_hits(text),
        "digest": tx.digest(F.col("raw_text")),
        "encoding_valid": flags["valid"],
        **tx.psycholinguistic(text, F.col("sentences"), F.col("tokens")),
    })

    def stage(name: str, ok: Column, error: str) -> Column:
        return F.struct(F.lit(name).alias("stage"), ok.alias("success"), F.when(~ok, F.array(F.lit(error))).otherwise(F.expr("CAST(array() AS ARRAY<STRING>)")).alias("errors"))

    stages = F.array(
        stage("encoding", F.col("encoding_valid"), "corrupted_characters"),
        stage("cleaning", F.length("cleaned_text") > 0, "empty_text"),
        stage("language", F.col("language") != "unknown", "unknown_language"),
        stage("segmentation", F.size("sentences") > 0, "no_sentences"),
        stage("tokenization", F.size("tokens") > 0, "no_tokens"),
    )
    return base.withColumns({
        "top_emotion": tx.top_entry(F.col("emotions")),
        "quality_score": tx.quality(text, F.col("language_confidence")),
        "stages": stages,
    })


def corpus_statistics(features: DataFrame) -> DataFrame:
    """Counts per language, sentiment and top emotion, mean tokens and quality (AGG14) as rows."""
    pairs = F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(c).alias("value"))
        for f, c in (("language", "language"), ("sentiment", "sentiment_label"), ("emotion", "top_emotion"))
    ])
    return features.select(F.explode(pairs).alias("p"), F.size("tokens").alias("n"), "quality_score").groupBy("p.field", "p.value").agg(
        F.count("*").alias("texts"), F.avg("n").alias("avg_tokens"), F.avg("quality_score").alias("avg_quality")
    )


def summaries(documents: DataFrame, row_id: str, raw: str = "text") -> DataFrame:
    """Language by script, words and characters (TXT24)."""
    text = F.col(raw)
    return documents.select(row_id, tx.first_script(text).alias("language"), F.size(tx.words(text)).cast("long").alias("words"), F.length(text).cast("long").alias("chars"))
