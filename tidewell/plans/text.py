"""Text queries over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import text as tx
from tidewell.functions.numeric import r9
from tidewell.operators import transcripts as tr
from tidewell.plans.registry import add, q4, q9
from tidewell.schemas import EMOTION_LABELS, EMOTION_TERMS, LEXICONS, MENTIONS, NEGATION_WORDS, NEGATIVE_WORDS, POSITIVE_WORDS, PRONOUN_WORDS

# Words of the lexicons are rare in the documents, so each text gets a closing remark by its id.
REMARK = ("CASE doc_id % 8 WHEN 0 THEN ' I feel sad and lonely, my mother was worried.' WHEN 1 THEN ' A good and happy day! I will go to work tomorrow.' "
          "WHEN 2 THEN ' They were angry, tired and not getting better at 10:30 on 12/05/2023.' WHEN 3 THEN ' She said: hopeless, worthless, depressed. We never sleep.' "
          "WHEN 4 THEN ' தமிழ் pesi ippo nalla irukku' WHEN 5 THEN ' मुझे अच्छा लगता है today' WHEN 6 THEN ' He is going to study, quickly walked away, scared and alone.' ELSE '' END")


def said(t):
    # dealt by id: a file of few row groups would leave the costly text columns to few tasks
    return t.documents.select("doc_id", "text").repartition("doc_id").select("doc_id", F.concat("text", F.expr(REMARK)).alias("text"))


SAID = f"(SELECT doc_id, text || {REMARK} AS text FROM documents)"
SP = r"[\t-\r\x{85}\p{Z}]"
CTRL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


def trim_sql(e):
    return f"regexp_replace({e}, '^{SP}+|{SP}+$', '', 'g')"


CLEAN = trim_sql(f"regexp_replace(replace(replace(regexp_replace(regexp_replace(text, '{CTRL}', '', 'g'), '\uFFFD', '', 'g'), '''''', ''''), '\"\"', '\"'), '{SP}+', ' ', 'g')")
WORDS = f"list_filter(string_split_regex(text, '{SP}+'), lambda w: w <> '')"
TOKENS = f"CASE WHEN text = '' THEN [] ELSE string_split_regex({trim_sql('text')}, '{SP}+') END"
TAGS = "CASE WHEN regexp_matches({0}, '[\u0B80-\u0BFF]') THEN 'ta' WHEN regexp_matches({0}, '[\u0900-\u097F]') THEN 'hi' WHEN regexp_matches({0}, '[a-zA-Z]') THEN 'en' ELSE 'unknown' END"
SENT = f"list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){SP}+', '\\1\x01', 'g'), '\x01'), lambda s: {trim_sql('s')}), lambda s: s <> '')"
SET = r"list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_\p{M}]+'))"


def lit(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def has(term):
    return f"contains(low, '{term}')::INT"




def plain_clean():
    return tx.clean(F.col("text"), cap_repeats=False, nfkc=False)


add("TXT1_clean_text", lambda t: said(t).select("doc_id", tx.clean(F.col("text")).alias("text")))
add("TXT1_clean_without_nfkc", lambda t: said(t).select("doc_id", F.sha2(plain_clean(), 256).alias("digest"), F.length(plain_clean()).cast("long").alias("chars")),
    f"SELECT doc_id, sha256(c) AS digest, length(c) AS chars FROM (SELECT doc_id, {CLEAN} AS c FROM {SAID})")
add("TXT2_clean_transcript", lambda t: t.conversations.select("conv_id", "turn", F.sha2(tx.clean(F.col("text"), cap_repeats=False, nfkc=False), 256).alias("digest")),
    f"SELECT conv_id, turn, sha256({CLEAN}) AS digest FROM conversations")
add("TXT3_encoding_flags", lambda t: said(t).select("doc_id", *[c.alias(n) for n, c in tx.encoding_errors(F.col("text")).items()]),
    f"SELECT doc_id, b AS corrupted_characters, NOT b AS valid FROM (SELECT doc_id, regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\uFFFD]') AS b FROM {SAID})")
add("TXT4_lowercase", lambda t: said(t).select("doc_id", F.sha2(F.lower("text"), 256).alias("digest")), f"SELECT doc_id, sha256(lower(text)) AS digest FROM {SAID}")
LANG = (f"SELECT doc_id, text, ta, hi, en, (ta + hi + en + 1) AS total, {trim_sql('text')} = '' AS blank FROM (SELECT doc_id, text, length(regexp_replace(text, '[^\u0B80-\u0BFF]', '', 'g')) AS ta, "
        f"length(regexp_replace(text, '[^\u0900-\u097F]', '', 'g')) AS hi, length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AS en FROM {SAID})")
LANG = f"SELECT *, ta / total AS st, hi / total AS sh, en / total AS se, ((ta / total > 15e-2)::INT + (hi / total > 15e-2)::INT + (en / total > 15e-2)::INT) > 1 AS mix FROM ({LANG})"
PRIMARY = ("CASE WHEN blank THEN 'unknown' WHEN mix AND en > 0 AND ta > 0 THEN 'tanglish' WHEN mix THEN 'mixed' WHEN st >= sh AND st >= se THEN 'ta' WHEN sh >= se THEN 'hi' ELSE 'en' END")
CONF = f"CASE WHEN blank THEN 0e0 ELSE {q4('least(1e0, CASE WHEN mix THEN 7e-1 ELSE greatest(st, sh, se) END + 2e-1)')} END"
add("TXT5_language", lambda t: said(t).select("doc_id", *[c.alias(n) for n, c in tx.language_columns(F.col("text")).items()]),
    f"SELECT doc_id, {PRIMARY} AS primary, mix AND NOT blank AS mixed, {CONF} AS confidence, {q4('st')} AS share_ta, {q4('sh')} AS share_hi, {q4('se')} AS share_en FROM ({LANG})".replace("AS primary", 'AS "primary"'))
add("TXT6_first_script", lambda t: said(t).select("doc_id", tx.first_script(F.col("text")).alias("language")), f"SELECT doc_id, {TAGS.format('text')} AS language FROM {SAID}")
add("TXT7_code_mix", lambda t: said(t).select("doc_id", F.explode(tx.code_mix(F.col("text"))).alias("token", "tag")).groupBy("doc_id", "tag").agg(F.count("*").alias("tokens")),
    f"SELECT doc_id, {TAGS.format('token')} AS tag, count(*) AS tokens FROM (SELECT doc_id, unnest(list_distinct({WORDS})) AS token FROM {SAID}) GROUP BY 1, 2")
add("TXT8_sentences", lambda t: said(t).select("doc_id", F.size(tx.sentences(F.col("text"))).cast("long").alias("n"), F.sha2(F.array_join(tx.sentences(F.col("text")), "|"), 256).alias("digest")),
    f"SELECT doc_id, len(s) AS n, sha256(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, {SENT} AS s FROM {SAID})")
add("TXT9_utterance_order", lambda t: t.conversations.filter(F.trim("text") != "").select("conv_id", "turn", F.length("text").cast("long").alias("chars")).orderBy("conv_id", "turn"),
    "SELECT conv_id, turn, length(text) AS chars FROM conversations WHERE trim(text) <> ''")


def token_lists(t):
    """All tokens of a text, and those within a sequence length."""
    lists = {"every": tx.tokens(F.col("text")), "cut": tx.tokens(F.col("text"), 512)}
    digests = [F.sha2(F.array_join(c, " "), 256).alias(f"{n}_digest") for n, c in lists.items()]
    return said(t).select("doc_id", *[F.size(c).cast("long").alias(n) for n, c in lists.items()], *digests)


add("TXT10_tokens", token_lists,
    f"SELECT doc_id, len(k) AS every, least(len(k), 512) AS cut, sha256(array_to_string(k, ' ')) AS every_digest, sha256(array_to_string(list_slice(k, 1, 512), ' ')) AS cut_digest FROM (SELECT doc_id, {TOKENS} AS k FROM {SAID})")
SENTI = f"SELECT doc_id, text, p / n AS positive, q / n AS negative, 1 - abs((p - q) / n) AS neutral, (p - q) / n AS compound FROM (SELECT *, p + q + 1e0 AS n FROM (SELECT doc_id, text, len(list_intersect(s, {lit(POSITIVE_WORDS)})) AS p, len(list_intersect(s, {lit(NEGATIVE_WORDS)})) AS q FROM (SELECT doc_id, text, {SET} AS s FROM {SAID})))"
LABEL = "CASE WHEN compound > 1e-1 THEN 'positive' WHEN compound < -1e-1 THEN 'negative' ELSE 'neutral' END"
add("TXT11_sentiment", lambda t: said(t).select("doc_id", *[c.alias(n) for n, c in tx.sentiment(F.col("text")).items()]),
    f"SELECT doc_id, positive, negative, neutral, compound, {LABEL} AS label, least(1e0, abs(compound) + 5e-1) AS confidence, abs(compound) AS intensity FROM ({SENTI})")
RAW = ", ".join(f"({' + '.join(has(x) for x in EMOTION_TERMS[e]) if e in EMOTION_TERMS else '0'}) / {max(len(EMOTION_TERMS.get(e, ())), 1)}e0 AS e_{e}" for e in EMOTION_LABELS)
TOP = "greatest(" + ", ".join(f"e_{e}" for e in EMOTION_LABELS) + ")"
EMO = f"SELECT doc_id, {', '.join(f'e_{e}' for e in EMOTION_LABELS if e != 'neutral')}, CASE WHEN {TOP} < 1e-2 THEN 1e0 ELSE e_neutral END AS e_neutral FROM (SELECT doc_id, {RAW} FROM (SELECT doc_id, lower(text) AS low FROM {SAID}))"
SUM = " + ".join(f"e_{e}" for e in EMOTION_LABELS)
EMO4 = f"SELECT doc_id, {', '.join(f'{q4(f'e_{e} / s')} AS e_{e}' for e in EMOTION_LABELS)} FROM (SELECT *, {SUM} AS s FROM ({EMO}))"
add("TXT12_emotions", lambda t: said(t).select("doc_id", F.explode(tx.emotions(F.col("text"))).alias("emotion", "score")),
    " UNION ALL ".join(f"SELECT doc_id, '{e}' AS emotion, e_{e} AS score FROM ({EMO4})" for e in EMOTION_LABELS))
POS = {"negations": f"list_contains({lit(NEGATION_WORDS)}, lower(w))", "pronouns": f"list_contains({lit(PRONOUN_WORDS)}, lower(w))"}
KIND = f"CASE WHEN {POS['negations']} THEN 'negations' WHEN {POS['pronouns']} THEN 'pronouns' WHEN ends_with(lower(w), 'ly') THEN 'adverbs' WHEN ends_with(lower(w), 'ed') OR ends_with(lower(w), 'ing') THEN 'verbs' ELSE 'nouns' END"
add("TXT13_part_of_speech", lambda t: said(t).select("doc_id", *[F.size(c).cast("long").alias(n) for n, c in tx.part_of_speech(tx.tokens(F.col("text"))).items()]),
    "SELECT doc_id, " + ", ".join(f"count(CASE WHEN kind = '{n}' THEN 1 END) AS {n}" for n in ("nouns", "verbs", "pronouns", "adverbs", "negations"))
    + f" FROM (SELECT doc_id, {KIND} AS kind FROM (SELECT doc_id, unnest({TOKENS}) AS w FROM {SAID})) GROUP BY 1")
# a letter or digit of any script becomes an underscore, which ASCII word boundaries take for a word character as well
PLAIN = r"regexp_replace(regexp_replace(text, '[^\x00-\x7F\p{L}\p{M}\p{N}]', '.', 'g'), '[^\x00-\x7F]', '_', 'g')"
add("TXT14_named_entities", lambda t: said(t).select("doc_id", *[F.array_join(c, "|").alias(n) for n, c in tx.named_entities(F.col("text")).items()]),
    r"SELECT doc_id, array_to_string(regexp_extract_all(a, '\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b'), '|') AS date, array_to_string(regexp_extract_all(a, '\b\d{1,2}:\d{2}\b'), '|') AS time, "
    r"array_to_string(regexp_extract_all(a, '\b[A-Z][a-z]+(?:\s[A-Z][a-z]+)*\b'), '|') AS place FROM (SELECT doc_id, " + PLAIN + f" AS a FROM {SAID})")
add("TXT15_keyword_hits", lambda t: said(t).select("doc_id", F.explode(tx.keyword_hits(F.col("text"))).alias("category", "terms")).select("doc_id", "category", F.array_join("terms", ",").alias("terms")),
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{c}' AS category, array_to_string(list_filter({lit(ts)}, lambda z: contains(low, z)), ',') AS terms FROM (SELECT doc_id, lower(text) AS low FROM {SAID})" for c, ts in LEXICONS.items()) + ") WHERE terms <> ''")


def mention_sql(pattern):
    words = [w for w in pattern.split("|") if " " not in w]
    spans = [w for w in pattern.split("|") if " " in w]
    extra = "".join(f" + CAST((length(low) - length(replace(low, '{s}', ''))) / {len(s)} AS BIGINT)" for s in spans)
    return f"(len(list_filter(ws, lambda w: list_contains({lit(words)}, w))){extra})"


def lex(category):
    return "(" + " + ".join(has(x) for x in LEXICONS[category]) + ")"


PSY = (f"SELECT doc_id, len(k) AS word_count, len(s) AS sentence_count, len(k) / CAST(greatest(len(s), 1) AS DOUBLE) AS avg_sentence_length, len(v) AS vocabulary_size, len(v) / CAST(greatest(len(k), 1) AS DOUBLE) AS lexical_diversity, "
       + ", ".join(f"{mention_sql(p)} AS {n}" for n, p in MENTIONS.items())
       + f", {mention_sql(MENTIONS['self_references'])} / CAST(greatest(len(k), 1) AS DOUBLE) AS pronoun_frequency, {lex('sleep')} AS sleep_mentions, {lex('isolation')} AS isolation_indicators, "
       f"{lex('depression')} AS hopelessness_indicators, {lex('stress')} AS stress_indicators, {lex('fatigue')} AS fatigue_indicators "
       r"FROM (SELECT *, list_distinct(list_transform(k, lambda w: lower(w))) AS v, regexp_extract_all(low, '[\p{L}\p{N}_\p{M}]+') AS ws FROM "
       f"(SELECT doc_id, lower(text) AS low, {SENT} AS s, list_filter({TOKENS}, lambda w: w <> '') AS k FROM {SAID}))")


def psycho(t):
    text = F.col("text")
    return said(t).select("doc_id", *[c.alias(n) for n, c in tx.psycholinguistic(text, tx.sentences(text), tx.tokens(text)).items()])


add("TXT16_psycholinguistic", psycho, PSY)
QUAL = f"{q4(f'3e-1 * least(1e0, len({WORDS}) / 5e1) + 2e-1 * CASE WHEN text <> {chr(39)*2} AND NOT contains(text, {chr(39)}{chr(0xFFFD)}{chr(39)}) THEN 1e0 ELSE 0e0 END + 3e-1 * conf + 2e-1')}"
add("TXT17_text_quality", lambda t: said(t).select("doc_id", tx.quality(F.col("text"), tx.language_columns(F.col("text"))["confidence"]).alias("quality")),
    f"SELECT doc_id, {QUAL} AS quality FROM (SELECT *, {CONF} AS conf FROM ({LANG}))")
add("TXT18_transcript_metrics", lambda t: tr.transcript_metrics(t.conversations),
    f"SELECT c.conv_id, utterances, word_count, sentence_count, floor(word_count / CAST(greatest(sentence_count, 1) AS DOUBLE) * 1e2 + 5000001e-7) / 1e2 AS avg_sentence_length, coalesce(v, 0) AS vocabulary_size, unknown_tokens, "
    f"{q4('least(1e0, utterances / 1e1 * 3e-1 + coalesce(v, 0) / 1e2 * 3e-1 + 4e-1)')} AS quality_score FROM (SELECT conv_id, count(*) AS utterances, CAST(sum(len(k)) AS BIGINT) AS word_count, count(CASE WHEN len(k) > 0 THEN 1 END) AS sentence_count, "
    r"CAST(sum(len(list_filter(k, lambda w: NOT regexp_full_match(w, '[\p{L}\p{N}]+') AND w <> '''' AND w <> '-'))) AS BIGINT) AS unknown_tokens FROM "
    f"(SELECT conv_id, {WORDS.replace('text', 'lower(text)')} AS k FROM conversations) GROUP BY 1) c LEFT JOIN (SELECT conv_id, count(DISTINCT w) AS v FROM (SELECT conv_id, unnest({WORDS.replace('text', 'lower(text)')}) AS w FROM conversations) GROUP BY 1) z ON z.conv_id = c.conv_id")
add("TXT19_token_drop", lambda t: said(t).select("doc_id", tx.drop_tokens(F.col("text"), F.col("doc_id"), 0.1).alias("text")))
add("TXT20_text_hash", lambda t: t.documents.select("doc_id", tx.digest(F.col("text")).alias("digest")), "SELECT doc_id, sha256(text) AS digest FROM documents")
FEATURES = ("doc_id", "language", "language_confidence", "sentiment_label", "sentiment_compound", "top_emotion", "quality_score", "word_count", "sentence_count", "vocabulary_size", "self_references", "digest")


def features(t):
    return tr.text_features(said(t), "doc_id")


add("TXT21_text_feature_table", lambda t: features(t).select(*FEATURES, F.size("tokens").alias("tokens"), F.array_join(F.transform(F.filter("stages", lambda s: ~s["success"]), lambda s: s["stage"]), ",").alias("failed_stages")))
add("TXT21_text_scores", lambda t: said(t).select("doc_id", tx.sentiment(F.col("text"))["label"].alias("sentiment_label"), tx.top_entry(tx.emotions(F.col("text"))).alias("top_emotion"), tx.language_columns(F.col("text"))["primary"].alias("language")),
    f"SELECT a.doc_id, {LABEL} AS sentiment_label, {PRIMARY} AS language, CASE " + " ".join(f"WHEN e_{e} >= {TOP} THEN '{e}'" for e in EMOTION_LABELS)
    + f" END AS top_emotion FROM ({SENTI}) a JOIN ({LANG}) b ON a.doc_id = b.doc_id JOIN ({EMO4}) c ON c.doc_id = a.doc_id")
add("AGG14_corpus_statistics", lambda t: tr.corpus_statistics(features(t)).select("field", "value", "texts", r9("avg_tokens").alias("avg_tokens"), r9("avg_quality").alias("avg_quality")))
add("AGG14_language_counts", lambda t: said(t).groupBy(tx.language_columns(F.col("text"))["primary"].alias("language")).agg(F.count("*").alias("texts"), r9(F.avg(F.size(tx.tokens(F.col("text"))))).alias("avg_tokens")),
    f"SELECT {PRIMARY} AS language, count(*) AS texts, {q9(f'avg(len({TOKENS}))')} AS avg_tokens FROM ({LANG}) GROUP BY 1")
add("TXT24_transcript_summary", lambda t: tr.summaries(said(t), "doc_id"),
    f"SELECT doc_id, {TAGS.format('text')} AS language, len({WORDS}) AS words, length(text) AS chars FROM {SAID}")
