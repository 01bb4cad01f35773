"""Exact deduplication by skew-safe combining.

Equal texts merge in three stages, and the whole text is part of the grouping key in each of them, so
two texts that merely share a digest never merge:

1. locally, inside each task, before anything is shuffled (the map-side half of the salted aggregate);
2. by (digest, salt, text): a text that holds a third of all rows is spread over all salts;
3. by (digest, text) over the winners of the salts, at most one row per salt and text.

The documents then look up their group by SHA-256, XXH64 and length of the text. Groups with more than one row
in HOT are few, whatever the input, and are broadcast; rows of all others are joined by a shuffle, in
which no key has more than that.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from graphloom.llm.common import row_key, rows_of
from graphloom.plans.scratch import scratch

SALTS, HOT = 8, 1_000
LOOKUP = ["sha", "check", "bytes"]


@F.arrow_udf(StringType())
def ascii_lower(text: pa.Array) -> pa.Array:
    return pc.ascii_lower(text)


def _lookup(text: Column) -> list[Column]:
    return [F.sha2(text, 256).alias("sha"), F.xxhash64(text).alias("check"), F.octet_length(text).alias("bytes")]


def _members(docs: DataFrame, digest, salts: int) -> DataFrame:
    """doc_id, row (hash of the row), sha, keep_id, group_size."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(docs).alias("row"), ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("norm"))
    named = texts.withColumn("digest", digest(F.col("norm")))
    salted = named.groupBy("digest", F.pmod(F.xxhash64("doc_id", "row"), F.lit(salts)).alias("salt"), "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    groups = salted.groupBy("digest", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    winners = scratch(groups.select(*_lookup(F.col("norm")), "keep_id", "group_size"))
    total = winners.agg(F.sum("group_size")).first()[0] or 0
    hot = winners.where(F.col("group_size") > max(1, total // HOT)).select(*LOOKUP, F.col("keep_id").alias("hot_id"), F.col("group_size").alias("hot_size"))
    rows = texts.select("doc_id", "row", *_lookup(F.col("norm"))).join(F.broadcast(hot), LOOKUP, "left")  # at most HOT groups
    # Rows that have found their group are dealt out evenly and meet no other.
    spread = F.when(F.col("hot_size").isNull(), F.col("sha")).otherwise(F.monotonically_increasing_id().cast("string"))
    rest = winners.select(F.col("sha").alias("key"), "check", "bytes", "keep_id", "group_size")
    found = rows.withColumn("key", spread).join(rest, ["key", "check", "bytes"], "left")
    keep = F.when(F.col("hot_size").isNull(), F.col("keep_id")).otherwise(F.col("hot_id"))
    return found.select("doc_id", "row", "sha", keep.alias("keep_id"), F.coalesce("hot_size", "group_size").alias("group_size"))


def exact_groups(docs: DataFrame, digest=None, salts: int = SALTS) -> DataFrame:
    """The group of every document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical after lower-casing A-Z; null is the empty text. Of equal texts
    the row with the largest doc_id stays. A null doc_id is smaller than any other; if a whole group has
    null ids, keep_id is null and its rows stay. Rows that repeat doc_id and text count each and share
    one fate. Other columns are ignored. digest: a function of the text column that sends equal texts to
    equal strings (SHA-256 by default) and only deals texts out: a weak one costs speed, not correctness.
    """
    found = _members(docs, digest or (lambda c: F.sha2(c, 256)), salts)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with all its columns: the one with the largest doc_id, and of rows
    that share that (or have none), one by a hash of the row. Columns may have any name."""
    found = _members(docs, lambda c: F.sha2(c, 256), SALTS)
    stays = found.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("sha", "doc_id", "row").agg(F.count("*").alias("n"))
    one = stays.groupBy("sha", "doc_id").agg(F.max(F.struct("row", "n")).alias("kept"))
    return rows_of(docs, scratch(one.select("doc_id", "kept.row", "kept.n")))
