"""Exact deduplication against immutable snapshots.

A batch is reduced to one group per digest (pre-aggregated before the shuffle, so a text that fills a
third of the batch is one row per task). A snapshot keeps the groups it first saw, dealt into buckets,
and per bucket a static binary-fuse filter over their digests. The groups of a later batch meet the
filter of their bucket; only positives join the exact members. Last, every digest that more than one
row has is checked byte for byte: rows are equal when digest and text are, so a digest collision would
end in two groups.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm import fuse
from tidewell.llm.common import id_text, reliable_checkpoint

#: Digests in a bucket, on average; what one task holds of a snapshot and its filter.
BUCKET_KEYS = 200_000
FILTER = "bucket long, seed decimal(20,0), segment long, starts long, slots binary"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _filters(members: DataFrame) -> DataFrame:
    """One filter per bucket of a snapshot."""

    def make(rows: pd.DataFrame) -> pd.DataFrame:
        made = fuse.build(rows["key"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame([[rows["bucket"].iloc[0], _decimal(made.seed), made.segment, made.starts, made.slots.tobytes()]], columns=["bucket", "seed", "segment", "starts", "slots"])

    return members.select("bucket", "key").groupBy("bucket").applyInPandas(make, FILTER)


def _decimal(value: int):
    import decimal

    return decimal.Decimal(value)


def _screen(incoming: DataFrame, filters: DataFrame) -> DataFrame:
    """Digests that the filter of their bucket may hold; a bucket without a filter holds none."""

    def test(rows: pd.DataFrame, made: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(made):
            return pd.DataFrame({"digest": pd.Series([], dtype=object)})
        f = made.iloc[0]
        held = fuse.Fuse(int(f["seed"]), int(f["segment"]), int(f["starts"]), np.frombuffer(f["slots"], np.uint8))
        return rows.loc[held.may_contain(rows["key"].to_numpy(np.int64).view(np.uint64)), ["digest"]]

    left = incoming.select("bucket", "key", "digest").groupBy("bucket")
    return left.cogroup(filters.groupBy("bucket")).applyInPandas(test, "digest binary")


def groups_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))


def bucketed(groups: DataFrame, buckets: int) -> DataFrame:
    return groups.withColumn("key", F.xxhash64("digest")).withColumn("bucket", F.pmod("key", F.lit(buckets).cast("long")))


def merge_batch(members: DataFrame, batch: DataFrame) -> DataFrame:
    """Groups of a snapshot and of a batch together; ``members`` and ``batch`` are tables of groups.

    The batch's groups that pass the filters join the members on the digest; the others are new.
    """
    most = members.count() + batch.count()
    buckets = max(1, math.ceil(most / BUCKET_KEYS))
    held, new = bucketed(members, buckets), bucketed(batch, buckets)
    positive = reliable_checkpoint(_screen(new, _filters(held)))
    maybe = batch.join(positive, "digest", "left_semi")
    hit = maybe.join(members.select("digest"), "digest", "left_semi")
    fresh = batch.join(positive, "digest", "left_anti").unionByName(maybe.join(members.select("digest"), "digest", "left_anti"))
    joined = members.unionByName(hit).groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    return joined.unionByName(fresh)


def exact_duplicates(docs: DataFrame, batches: int = 2, id_col: str = "doc_id", text_col: str = "text", digest=sha256, key_col: str | None = None) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their bytes are after each run of blanks becomes one blank; null counts as
    empty. The smallest id of a group stays. The table is taken in as ``batches`` snapshots, by ranges
    of the id, in ascending order, so a snapshot's id is always the smaller one. A repeated id gives a
    row each time and ``kept`` on each of its rows in its group; a null id is never the smallest unless
    all ids of its group are null, and then ``keep_id`` is null and the row stays. Other columns are
    ignored. An empty table gives no rows. ``digest`` can be any function of the text. With ``key_col``,
    a column that differs from row to row, the result has it as ``_key``, so rows with one id can be told
    apart.
    """
    key = ["_key"] if key_col else []
    texts = id_text(docs, id_col, text_col, key_col).select("doc_id", *key, normalised(F.col("text")).alias("norm"))
    rows = reliable_checkpoint(texts.select("doc_id", *key, digest(F.col("norm")).alias("digest"), F.sha2("norm", 256).alias("text_sha256")))
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    width = ((high - low) // batches + 1) if low is not None else 1
    number = F.coalesce(((F.col("doc_id") - F.lit(low if low is not None else 0)) / width).cast("int"), F.lit(batches - 1))
    groups = reliable_checkpoint(groups_of(rows.filter(number == 0)))
    for k in range(1, batches):
        groups = reliable_checkpoint(merge_batch(groups, reliable_checkpoint(groups_of(rows.filter(number == k)))))

    # byte check of all rows whose digest others have too
    shared = groups.filter("n > 1").select("digest")
    by = key or ["doc_id"]
    suspects = rows.join(shared, "digest", "left_semi").select(*by)
    checked = texts.join(suspects, by, "left_semi").select(digest(F.col("norm")).alias("digest"), "norm")
    kinds = reliable_checkpoint(checked.distinct().groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1"))
    if kinds.isEmpty():
        decided = rows.join(groups, "digest")
    else:  # one digest, several texts: these rows are grouped by their text as well
        odd = texts.withColumn("digest", digest(F.col("norm"))).withColumn("text_sha256", F.sha2("norm", 256)).join(kinds.select("digest"), "digest", "left_semi")
        split = odd.groupBy("digest", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
        decided = rows.join(groups, "digest").join(kinds.select("digest"), "digest", "left_anti").unionByName(odd.join(split, ["digest", "norm"]).drop("norm"))
    return decided.select(
        "doc_id", "keep_id", F.col("n").cast("long").alias("group_size"), F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256", *key
    )
