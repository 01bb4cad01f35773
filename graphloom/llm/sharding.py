"""Sharding by sampled splitters, with DataFrame functions alone.

Records are range-partitioned on a key (the hash of the text, so equal texts are neighbours):

1. keys with more than a range's share of the bytes are set apart (there can be no more of them than
   ranges);
2. of the other records, keys are sampled with a chance in proportion to size, and weighted quantiles
   of the sample become the boundaries of many small ranges;
3. ranges that turn out overfull are subdivided, until none is;
4. whole ranges and whole heavy keys go to the shards, largest first, each to the emptiest shard. Only a
   key that is larger than a shard is cut.

Only boundaries and sizes of ranges reach the driver; their number is a parameter.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.plans.scratch import scratch

STRIDE = 64


def _place(key: Column, bounds: list[int]) -> Column:
    """How many bounds (sorted) are <= key, in two short steps."""
    if not bounds:
        return F.lit(0)
    coarse, fine = F.lit(bounds[::STRIDE]), F.lit(bounds)
    block = F.size(F.filter(coarse, lambda b: b <= key))
    inside = F.size(F.filter(F.slice(fine, (block - 1) * STRIDE + 1, STRIDE), lambda b: b <= key))
    return F.when(block == 0, 0).otherwise((block - 1) * STRIDE + inside)


def _quantiles(sample: list[tuple[int, float]], parts: int) -> list[int]:
    total, run, bounds = sum(w for _, w in sample), 0.0, []
    for key, weight in sorted(sample):
        if run >= total * (len(bounds) + 1) / parts and (not bounds or key > bounds[-1]):
            bounds.append(key)
        run += weight
    return bounds


def _subdivided(bounds: list[int], sizes: dict[int, int], limit: float) -> list[int]:
    """More bounds, evenly spaced (the keys are hashes) in the ranges that are larger than the limit."""
    edges, more = [-(2**63), *bounds, 2**63 - 1], set(bounds)
    for r, size in sizes.items():
        parts = math.ceil(size / limit)
        low, high = edges[r], edges[r + 1]
        more.update(low + (high - low) * i // parts for i in range(1, parts))
    return sorted(more)


def shard_documents(docs: DataFrame, shards: int = 16, ranges_per_shard: int = 64, samples_per_range: int = 8) -> DataFrame:
    """Puts every document into one of the shards, of nearly equal bytes.

    Returns doc_id, size (UTF-8 bytes plus 1; null text: 1), text_crc32, shard, slot (gapless from 0 in
    each shard). Equal texts share a shard unless their group is larger than a shard. Rows with null or
    repeated ids are rows like any other. An empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    rows = scratch(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key")))
    spark, n_ranges = docs.sparkSession, shards * ranges_per_shard
    total = rows.agg(F.sum("size")).first()[0] or 1
    share = total / n_ranges

    heavy = rows.groupBy("key").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > share).collect()  # at most n_ranges rows
    parts_of = [(i, r.key, math.ceil(r.bytes / share)) for i, r in enumerate(sorted(heavy))]
    heavy_keys = F.broadcast(spark.createDataFrame(parts_of, "heavy int, key long, parts int"))
    rows = rows.join(heavy_keys, "key", "left")
    light = rows.where("heavy IS NULL")

    rate = n_ranges * samples_per_range / total
    chance = F.pmod(F.xxhash64("row", "key", F.lit(1)), F.lit(1 << 40)) / float(1 << 40)
    weight = F.greatest(F.lit(1.0), F.col("size") * rate)
    sample = light.where(chance < F.col("size") * rate).select("key", weight.alias("w")).collect()  # n_ranges * samples_per_range rows are expected
    bounds = _quantiles([tuple(r) for r in sample], n_ranges)
    while True:
        found = {r.r: r.bytes for r in light.groupBy(_place(F.col("key"), bounds).alias("r")).agg(F.sum("size").alias("bytes")).collect()}
        overfull = {r: b for r, b in found.items() if b > 3 * share}
        finer = _subdivided(bounds, overfull, share)
        if finer == bounds:
            break
        bounds = finer

    # Pieces: (unit, part). A unit is a range, or a heavy key in parts.
    unit = F.coalesce(F.col("heavy"), len(parts_of) + _place(F.col("key"), bounds))
    part = F.when(F.col("heavy").isNull(), 0).otherwise(F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    rows = rows.withColumn("unit", unit).withColumn("part", part)
    pieces = rows.groupBy("unit", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()  # some n_ranges rows
    plan = spark.createDataFrame(_assign(pieces, shards, total / shards), "unit int, part int, shard int, start long")
    order = Window.partitionBy("unit", "part").orderBy("key", F.col("doc_id").asc_nulls_last(), "text_crc32")
    placed = rows.withColumn("at", F.row_number().over(order) - 1).join(F.broadcast(plan), ["unit", "part"])
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("at")).alias("slot"))


def _assign(pieces: list, shards: int, capacity: float) -> list[tuple[int, int, int, int]]:
    """Shard and first slot of each piece: units whole, largest first, to the emptiest shard."""
    units: dict[tuple, list] = {}
    weight = {}
    for p in pieces:
        weight[p.unit] = weight.get(p.unit, 0) + p.bytes
    for p in sorted(pieces):
        units.setdefault((p.unit,) if weight[p.unit] <= capacity else (p.unit, p.part), []).append(p)
    loads, filled, out = [(0, s) for s in range(shards)], [0] * shards, []
    for _, members in sorted(units.items(), key=lambda u: (-sum(p.bytes for p in u[1]), u[0])):
        load, shard = heapq.heappop(loads)
        for p in members:
            out.append((p.unit, p.part, shard, filled[shard]))
            filled[shard] += p.n
        heapq.heappush(loads, (load + sum(p.bytes for p in members), shard))
    return out
