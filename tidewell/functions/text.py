"""Transcript text expressions. All of them work on whole texts and stay in the JVM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.numeric import let, r4
from tidewell.schemas import (
    EMOTION_LABELS, EMOTION_TERMS, LEXICONS, MENTIONS, NEGATION_WORDS, NEGATIVE_WORDS, POSITIVE_WORDS, PRONOUN_WORDS,
)

CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
TAMIL, HINDI, LATIN = r"[஀-௿]", r"[ऀ-ॿ]", "[a-zA-Z]"
SPACE = r"(?U)\s+"


def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFKC")


def compose(text: Column) -> Column:
    """Unicode NFKC, a no-op for ASCII rows.

    A Python function is evaluated before the condition around it, so ASCII texts are kept from it by a null.
    """
    normalise = F.pandas_udf(_nfkc, "string")
    return F.coalesce(normalise(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean(text: Column, keep_punctuation: bool = True, cap_repeats: bool = True, nfkc: bool = True) -> Column:
    """Drop control characters, fold quotes and spaces, cap long repeats at three (TXT1, TXT2)."""
    out = F.replace(F.when(text.rlike(CONTROL), F.regexp_replace(text, CONTROL, "")).otherwise(text), F.lit("�"), F.lit(""))
    if nfkc:
        out = compose(out)
    out = F.replace(F.replace(out, F.lit("''"), F.lit("'")), F.lit('""'), F.lit('"'))
    out = F.trim(F.regexp_replace(out, SPACE, " "))
    if not keep_punctuation:
        out = F.regexp_replace(out, r"(?U)[^\w\s.,!?'-]", "")
    if cap_repeats:
        out = F.regexp_replace(out, r"(.)\1{4,}", "$1$1$1")
    return out


def encoding_errors(text: Column) -> dict[str, Column]:
    """Corruption flags of a text (TXT3)."""
    corrupted = text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F�]")
    return {"corrupted_characters": corrupted, "valid": ~corrupted}


def words(text: Column) -> Column:
    """Whitespace tokens of a text; empty for a blank one."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def tokens(text: Column, limit: int | None = None) -> Column:
    """Tokens of the trimmed text, optionally cut to a sequence length (TXT10)."""
    split = F.when(text == "", F.expr("CAST(array() AS ARRAY<STRING>)")).otherwise(F.split(_trim(text), SPACE))
    return F.slice(split, 1, limit) if limit else split


def token_language(token: Column) -> Column:
    return F.when(token.rlike(TAMIL), "ta").when(token.rlike(HINDI), "hi").when(token.rlike(LATIN), "en").otherwise("unknown")


def first_script(text: Column) -> Column:
    """First matching script decides (TXT6)."""
    return token_language(text)


def code_mix(text: Column) -> Column:
    """Map from token to its language (TXT7); equal tokens have equal tags."""
    return F.map_from_entries(F.transform(F.array_distinct(words(text)), lambda w: F.struct(w, token_language(w))))


def _kept(text: Column, pattern: str) -> Column:
    """Number of characters of a class; most texts have none of a foreign script."""
    return F.when(text.rlike(pattern), F.length(text) - F.length(F.regexp_replace(text, pattern + "+", ""))).otherwise(0)


def language(text: Column) -> Column:
    """Script shares, mixed flag, primary language and confidence as one struct (TXT5)."""
    counts = F.struct(
        _kept(text, TAMIL).alias("ta"), _kept(text, HINDI).alias("hi"), _kept(text, LATIN).alias("en"), (_trim(text) == "").alias("blank")
    )

    def shares(c: Column) -> Column:
        total = c["ta"] + c["hi"] + c["en"] + 1
        return F.struct(*[(c[k] / total).alias(k) for k in ("ta", "hi", "en")], (c["ta"] > 0).alias("has_ta"), (c["en"] > 0).alias("has_en"), c["blank"].alias("blank"))

    def decide(s: Column) -> Column:
        mixed = sum(((s[k] > 0.15).cast("int") for k in ("ta", "hi", "en")), F.lit(0)) > 1
        top = F.greatest(s["ta"], s["hi"], s["en"])
        single = F.when(s["ta"] == top, "ta").when(s["hi"] == top, "hi").otherwise("en")
        primary = F.when(s["blank"], "unknown").when(mixed & s["has_en"] & s["has_ta"], "tanglish").when(mixed, "mixed").otherwise(single)
        sure = F.when(s["blank"], 0.0).otherwise(r4(F.least(F.lit(1.0), F.when(mixed, 0.7).otherwise(top) + 0.2)))
        return F.struct(
            primary.alias("primary"), (mixed & ~s["blank"]).alias("mixed"), sure.alias("confidence"),
            *[r4(s[k]).alias(f"share_{k}") for k in ("ta", "hi", "en")],
        )

    return let(let(counts, shares), decide)


def language_columns(text: Column) -> dict[str, Column]:
    info = language(text)
    return {k: info[k] for k in ("primary", "mixed", "confidence", "share_ta", "share_hi", "share_en")}


def sentences(text: Column) -> Column:
    """Split after . ! ? and white space (TXT8)."""
    parts = F.transform(F.split(text, r"(?U)(?<=[.!?])\s+"), _trim)
    return F.filter(parts, lambda s: s != "")


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), 1))


def _list(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def sentiment(text: Column) -> dict[str, Column]:
    """Lexicon sentiment over distinct tokens (TXT11)."""
    def count(found: Column) -> Column:
        return F.struct(
            F.size(F.array_intersect(found, _list(POSITIVE_WORDS))).alias("pos"),
            F.size(F.array_intersect(found, _list(NEGATIVE_WORDS))).alias("neg"),
        )

    n = let(word_set(text), count)
    total = n["pos"] + n["neg"] + 1
    compound = (n["pos"] - n["neg"]) / total
    return {
        "positive": n["pos"] / total,
        "negative": n["neg"] / total,
        "neutral": 1.0 - F.abs(compound),
        "compound": compound,
        "label": F.when(compound > 0.1, "positive").when(compound < -0.1, "negative").otherwise("neutral"),
        "confidence": F.least(F.lit(1.0), F.abs(compound) + 0.5),
        "intensity": F.abs(compound),
    }


def emotions(text: Column, labels=EMOTION_LABELS) -> Column:
    """Map label to normalised share of substring hits; neutral without any hit (TXT12)."""
    def hit_shares(low: Column) -> Column:
        cells = []
        for label in labels:
            terms = EMOTION_TERMS.get(label, ())
            found = sum((low.contains(t).cast("int") for t in terms), F.lit(0))
            cells.append(found / max(len(terms), 1))
        return F.array(*cells)

    nothing = F.array(*[F.lit(1.0 if label == "neutral" else 0.0) for label in labels])
    keys = F.array(*[F.lit(label) for label in labels])

    def normalised(raw: Column) -> Column:
        total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
        return F.map_from_arrays(keys, F.transform(raw, lambda x: F.when(total == 0, 0.0).otherwise(r4(x / total))))

    shares = let(F.lower(text), hit_shares)
    return let(let(shares, lambda r: F.when(F.array_max(r) < 0.01, nothing).otherwise(r)), normalised)


def top_entry(scores: Column) -> Column:
    """Key of the largest value of a map; the earliest key wins a tie."""
    def best(m: Column) -> Column:
        values = F.map_values(m)
        return F.element_at(F.map_keys(m), F.array_position(values, F.array_max(values)).cast("int"))

    return let(scores, best)


def keyword_hits(text: Column, lexicons: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Map category to the terms found, only categories with a hit (TXT15)."""
    cats = lexicons or LEXICONS

    def find(low: Column) -> Column:
        return F.array(*[
            F.struct(F.lit(c).alias("category"), F.array_compact(F.array(*[F.when(low.contains(t), t) for t in terms])).alias("terms"))
            for c, terms in cats.items()
        ])

    return F.map_from_entries(F.filter(let(F.lower(text), find), lambda e: F.size(e["terms"]) > 0))


def hits(text: Column, category: str) -> Column:
    low = F.lower(text)
    return sum((low.contains(t).cast("int") for t in LEXICONS[category]), F.lit(0)).cast("long")


def part_of_speech(toks: Column) -> dict[str, Column]:
    """Suffix-rule buckets (TXT13)."""
    def kind(tok: Column) -> Column:
        low = F.lower(tok)
        return (
            F.when(low.isin(*NEGATION_WORDS), "negations")
            .when(low.isin(*PRONOUN_WORDS), "pronouns")
            .when(low.endswith("ly"), "adverbs")
            .when(low.endswith("ed") | low.endswith("ing"), "verbs")
            .otherwise("nouns")
        )

    def bucket(name: str) -> Column:
        return F.filter(toks, lambda t: kind(t) == name)

    return {n: bucket(n) for n in ("nouns", "verbs", "pronouns", "adverbs", "negations")}


def named_entities(text: Column) -> dict[str, Column]:
    """Dates, times and capitalised spans, all of them (TXT14); show as many as a view needs."""
    return {
        "date": F.regexp_extract_all(text, F.lit(r"(?U)\b(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\b"), 1),
        "time": F.regexp_extract_all(text, F.lit(r"(?U)\b(\d{1,2}:\d{2})\b"), 1),
        "place": F.regexp_extract_all(text, F.lit(r"(?U)\b([A-Z][a-z]+(?:\s[A-Z][a-z]+)*)\b"), 1),
    }


def psycholinguistic(text: Column, sents: Column, toks: Column) -> dict[str, Column]:
    """Counts, diversity, mentions and lexicon indicators (TXT16)."""
    kept = F.filter(toks, lambda t: t != "")
    n = F.size(kept).cast("long")
    vocab = F.size(F.array_distinct(F.transform(kept, F.lower))).cast("long")
    sent_n = F.size(sents).cast("long")
    out = {
        "word_count": n,
        "sentence_count": sent_n,
        "avg_sentence_length": n / F.greatest(sent_n, F.lit(1)),
        "vocabulary_size": vocab,
        "lexical_diversity": vocab / F.greatest(n, F.lit(1)),
    }
    # one pass finds the mentions of all kinds; they share no word
    every = "|".join(MENTIONS.values())
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"(?U)\b({every})\b"), 1)

    def tally(hits_: Column) -> Column:
        def count(pattern: str) -> Column:
            return F.size(F.filter(hits_, lambda w: w.isin(*pattern.split("|")))).cast("long")

        return F.struct(*[count(pattern).alias(name) for name, pattern in MENTIONS.items()])

    counts = let(found, tally)
    for name in MENTIONS:
        out[name] = counts[name]
    out["pronoun_frequency"] = out["self_references"] / F.greatest(n, F.lit(1))
    for name, category in (("sleep_mentions", "sleep"), ("isolation_indicators", "isolation"), ("hopelessness_indicators", "depression"),
                           ("stress_indicators", "stress"), ("fatigue_indicators", "fatigue")):
        out[name] = hits(text, category)
    return out


def quality(text: Column, language_confidence: Column, unknown_ratio: Column | float = 0.0) -> Column:
    """Length, encoding, language and unknown-token score (TXT17)."""
    length = F.least(F.lit(1.0), F.size(words(text)) / 50.0)
    encoding = F.when((text != "") & ~text.contains("�"), 1.0).otherwise(0.0)
    unknown = F.lit(unknown_ratio) if isinstance(unknown_ratio, float) else unknown_ratio
    return r4(0.3 * length + 0.2 * encoding + 0.3 * language_confidence + 0.2 * (1.0 - unknown))


def drop_tokens(text: Column, row_id: Column, probability: float, seed: int = 42) -> Column:
    """Training-only augmentation: drop tokens by a seeded hash; texts below three tokens stay (TXT19)."""
    toks = words(text)
    kept = F.filter(toks, lambda t, i: F.pmod(F.xxhash64(row_id, i, F.lit(seed)), F.lit(1_000_000)) / 1e6 >= probability)
    changed = F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(text)
    return F.when((F.lit(probability) <= 0) | (F.size(toks) < 3), text).otherwise(changed)


def digest(text: Column) -> Column:
    return F.sha2(text, 256)
