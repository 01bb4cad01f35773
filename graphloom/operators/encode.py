"""Ids as dense numbers, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.scratch import scratch


def dense_numbers(rows: DataFrame, order: list[str], name: str = "idx", buckets: int | None = None, once: bool = False) -> DataFrame:
    """0, 1, 2, ... in the given order (once: of equal rows one, which takes no shuffle more), without gathering all rows in one task: rows are range-partitioned and sorted,
    numbered where they are, and shifted by the sizes of the partitions before. Rows are shuffled and written once."""
    n = buckets or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The upper bits of these ids are the partition, the lower 33 the place in it.
    placed = rows.repartitionByRange(n, *order)
    parts = scratch((placed.distinct() if once else placed).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part, inside = F.shiftright("__at", 33).cast("int"), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = sorted(map(tuple, parts.groupBy(part.alias("__part")).count().collect()))  # a row for each partition
    starts, at = [], 0
    for number, size in sizes:
        starts.append((number, at))
        at += size
    shifts = rows.sparkSession.createDataFrame(starts, "__part int, __start long")
    return parts.withColumn("__part", part).join(F.broadcast(shifts), "__part").select(*rows.columns, (inside + F.col("__start")).alias(name))


def mapping(rows: DataFrame, key: str, prefix: str = "", order: list[str] | None = None) -> DataFrame:
    """A number for each distinct key in the given order (its own by default), and an id with the prefix."""
    numbered = dense_numbers(rows.select(key, *[c for c in order or [] if c != key]).dropna(subset=[key]).dropDuplicates([key]), order or [key])
    return numbered.select(key, "idx", F.concat(F.lit(prefix), F.col("idx").cast("string")).alias("new_id"))


def encode_edges(edges: DataFrame, sources: DataFrame, targets: DataFrame, missing: str | None = None) -> DataFrame:
    """Edges with numbers for ids, by mappings (id, idx). Edges with an unknown end go (missing=None), or
    keep the end with number null and text '' as in a lookup with a default (missing='keep')."""
    how = "inner" if missing is None else "left"
    s, t = sources.select(F.col("id").alias("source"), F.col("idx").alias("src")), targets.select(F.col("id").alias("target"), F.col("idx").alias("dst"))
    return edges.join(s, "source", how).join(t, "target", how).select("src", "dst")


def decode_edges(encoded: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    s, t = sources.select(F.col("id").alias("source"), F.col("idx").alias("src")), targets.select(F.col("id").alias("target"), F.col("idx").alias("dst"))
    return encoded.join(s, "src").join(t, "dst").select("source", "target")


def swap_ends(edges: DataFrame, first: str = "d_", second: str = "p_") -> DataFrame:
    """Edges that run from first to second are turned round."""
    turn = F.col("source").startswith(first) & F.col("target").startswith(second)
    return edges.withColumns({"source": F.when(turn, F.col("target")).otherwise(F.col("source")), "target": F.when(turn, F.col("source")).otherwise(F.col("target"))})
