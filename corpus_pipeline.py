"""A training-data pipeline: each stage applies one operator to all that the stage before kept.

All stages but the last return the columns of ``documents``. A stage is judged on its own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.bpe import encode_documents
from tidewell.llm.common import documents, reliable_checkpoint, table
from tidewell.llm.decontaminate import decontaminated
from tidewell.llm.exact import exact_duplicates
from tidewell.llm.language import identify, learn
from tidewell.llm.queries import vocabulary_path
from tidewell.llm.simhash import near_duplicates

#: Bits per letter over which a text is in no learned language; prose of a learned one needs 2 to 4, a text
#: all of whose letters are unknown about 15.
MOST_BITS = 9.0


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of each row, written, so that a row has the same key each time it is read; and the key's name."""
    name = "_key"
    while name in docs.columns:
        name += "_"
    content = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]  # maps have no hash
    key = F.struct(F.xxhash64(*content).alias("h"), F.monotonically_increasing_id().alias("n"))
    return reliable_checkpoint(docs.withColumn(name, key)), name


def _first_of(rows: DataFrame, key: str, judged: DataFrame, *group: str) -> DataFrame:
    """One of the keyed rows for each group of ``judged``: the smallest id, nulls last, then the smallest key."""
    order = F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "_key")
    chosen = judged.groupBy(*group).agg(F.min(order).alias("least")).select(F.col("least._key").alias(key))
    return rows.join(chosen, key, "left_semi").drop(key)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no learned language, go; the others carry the language found.

    If no row has a language to learn from, nothing can be judged and all rows stay as they are.
    """
    model = learn(docs)
    if not model.languages:
        return docs
    found = identify(docs, model, with_row=True).filter((F.col("lang_pred") != "und") & (F.col("bits_per_letter") <= MOST_BITS))
    return found.select(*[F.col("lang_pred").alias(c) if c == "lang" else F.col(f"_row.`{c}`") for c in docs.columns])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays: one with the smallest id.

    Rows are judged, not ids: a row whose id is null stays if no row with an id has its text, and just one
    does of several; of rows that repeat both id and text one stays; texts that share an id are judged apart.
    """
    rows, key = _keyed(docs)
    return _first_of(rows, key, exact_duplicates(rows, key_col=key).filter("kept"), "keep_id", "text_sha256")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component stays: one with the smallest id.

    Rows are judged, not ids: null ids come after all others, and of rows with the same id one stays.
    """
    rows, key = _keyed(docs)
    return _first_of(rows, key, near_duplicates(rows, key_col=key), "root")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold at least half of a test item's words in common passages go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return encode_documents(docs, vocabulary_path())


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]

#: The stages cannot be said in SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each stage's rows written before the next reads them."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = reliable_checkpoint(docs)
    return docs
