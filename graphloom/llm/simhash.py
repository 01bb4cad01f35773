"""SimHash near-duplicates with pigeonring filtering.

A fingerprint's 64 bits form a ring of SEGMENTS segments. If two fingerprints differ in at most LIMIT
bits, then from some segment on every run of l consecutive segments differs in at most l * LIMIT /
SEGMENTS bits (the pigeonring principle). So from that start

* the first segment is equal, and of the next three, with two differences at most, one is equal too:
  these two segments are the join key (18 keys of some 21 bits for a fingerprint);
* a pair that meets under a key must keep the budgets of the whole chain before its Hamming distance is
  taken.

Pairs are not emitted. Within a key only links that join two groups are (at most one per fingerprint).
Keys with more than BUCKET fingerprints don't compare pairs at all: each of their fingerprints is linked
to every point within half the limit. Two fingerprints share such a point exactly if they differ in LIMIT
bits or fewer, so connected components come out the same, in time linear in the bucket.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import SPACED, as_batch, by_bytes, large_text, row_key, rows_of, split_words
from graphloom.operators.components import connected_components
from graphloom.plans.scratch import scratch

SHINGLE, SEED, LIMIT, SEGMENTS, REACH, BUCKET = 4, 42, 4, 6, 3, 20_000
HOT = 1_000
WIDTHS = [11, 11, 11, 11, 10, 10]
OFFSETS = [sum(WIDTHS[:i]) for i in range(SEGMENTS)]
BUDGETS = [(n * LIMIT) // SEGMENTS for n in range(1, SEGMENTS + 1)]

FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("fp", pa.int64())])
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprints_of(texts: pa.LargeStringArray, chunk: int = 1 << 17) -> np.ndarray:
    """The 64-bit fingerprint of each text (already in lower case)."""
    words = split_words(texts, SPACED)
    n = len(texts)
    counts = words.counts
    joined = np.insert(words.bytes, words.offsets[1:], 0x20).tobytes()
    at = np.arange(len(words), dtype=np.int64)
    begin, end = words.offsets[:-1] + at, words.offsets[1:] + at
    shingles = np.where(counts > 0, np.maximum(counts - SHINGLE + 1, 1), 0)
    edges = np.concatenate([[0], np.cumsum(shingles)])
    ones = np.zeros((n, 64), np.int64)
    digest = xxhash.xxh64_intdigest
    for low in range(0, int(edges[-1]), chunk):
        high = min(low + chunk, int(edges[-1]))
        d0, d1 = np.searchsorted(edges, [low, high - 1], side="right") - 1
        bounds = np.clip(edges[d0 : d1 + 2], low, high)
        doc = np.repeat(np.arange(d0, d1 + 1), np.diff(bounds))
        first = words.first[doc] + np.arange(low, high) - edges[doc]
        last = np.minimum(first + SHINGLE, words.first[doc + 1]) - 1
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(begin[first].tolist(), end[last].tolist(), strict=True)], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        full = np.flatnonzero(np.diff(bounds))  # empty texts have no shingles
        ones[d0 + full] += np.add.reduceat(bits, bounds[full] - low, axis=0, dtype=np.int32)
    set_bits = ones * 2 > shingles[:, None]
    return np.packbits(set_bits, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def _fingerprint_batches(batches):
    for batch in batches:
        for part in by_bytes(batch):
            yield as_batch(FINGERPRINTS, part.column("doc_id"), part.column("row"), fingerprints_of(large_text(part.column("text"), lower=True)).view(np.int64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of the row) and fp (the 64 bits as a long) of every document; null text is empty and has 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(docs).alias("row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprint_batches, "doc_id long, row long, fp long")


def _segment(i: int):
    shifted = F.shiftrightunsigned("fp", OFFSETS[i])
    return shifted.bitwiseAND((1 << WIDTHS[i]) - 1)


def _keys():
    """For each start of a chain and each of the next REACH segments, both segments and which they are."""
    keys = []
    for i in range(SEGMENTS):
        for j in range(1, REACH + 1):
            keys.append(F.lit((i * REACH + j - 1) << 22) + F.shiftleft(_segment(i), 11) + _segment((i + j) % SEGMENTS))
    return F.array(*keys)


def within_budgets(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether the chain of segments from the start keeps its budgets, for each difference x."""
    ok, total = np.ones(len(x), bool), np.zeros(len(x), np.int64)
    widths, offsets = np.array(WIDTHS, np.uint64), np.array(OFFSETS, np.uint64)
    for n in range(SEGMENTS - 1):
        seg = (start + n) % SEGMENTS
        total += np.bitwise_count((x >> offsets[seg]) & ((np.uint64(1) << widths[seg]) - np.uint64(1)))
        ok &= total <= BUDGETS[n]
    return ok


def links_within(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, under each key, what pairs within the limit connect. Rows are sorted by key."""
    n = len(key)
    root, out_a, out_b = np.arange(n), [], []
    start, at, step = (key >> 22) // REACH, np.arange(n), 0
    while len(at):
        step += 1
        at = at[at + step < n]
        at = at[key[at + step] == key[at]]
        a, b = at, at + step
        fresh = root[a] != root[b]
        a, b = a[fresh], b[fresh]
        x = fp[a] ^ fp[b]
        near = within_budgets(x, start[a])
        near[near] = np.bitwise_count(x[near]) <= LIMIT
        a, b = a[near], b[near]
        if len(a):
            parent = root
            kept = []
            for k, (p, q) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
                while parent[p] != p:
                    p = parent[p]
                while parent[q] != q:
                    q = parent[q]
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    kept.append(k)
            while not np.array_equal(up := root[root], root):
                root = up
            out_a.append(fp[a[kept]])
            out_b.append(fp[b[kept]])
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *out_a]), np.concatenate([empty, *out_b])


def _link_batches(bucket: int):
    def run(batches):
        parts = list(batches)
        if not parts:
            return
        key = np.concatenate([p.column(0).to_numpy() for p in parts])
        fp = np.concatenate([p.column(1).to_numpy() for p in parts]).view(np.uint64)
        order = np.lexsort((fp, key))
        key, fp = key[order], fp[order]
        edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.repeat(np.diff(np.append(edges, len(key))), np.diff(np.append(edges, len(key))))
        large = fp[sizes > bucket].view(np.int64)
        yield as_batch(LINKS, large, np.full(len(large), None))  # no partner: linked by points
        some = (sizes > 1) & (sizes <= bucket)
        a, b = links_within(key[some], fp[some])
        yield as_batch(LINKS, a.view(np.int64), b.view(np.int64))

    return run


def _points():
    """All points within half the limit of a fingerprint."""
    one = [1 << i for i in range(63)] + [-(1 << 63)]
    flips = [0, *one, *(a ^ b for i, a in enumerate(one) for b in one[:i])]
    return F.transform(F.lit(flips), lambda flip: F.col("fp").bitwiseXOR(flip))


def near_links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links a, b between distinct fingerprints fp, with the same components as all pairs within LIMIT bits."""
    n = fps.count()
    spark = fps.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n * SEGMENTS * REACH / 2_000_000))
    keyed = fps.select(F.explode(_keys()).alias("key"), "fp").repartition(parts, "key")
    found = scratch(keyed.mapInArrow(_link_batches(bucket), "a long, b long"))
    links = found.where("b IS NOT NULL")
    crowded = found.where("b IS NULL").select(F.col("a").alias("fp")).distinct()
    if crowded.isEmpty():
        return links
    points = scratch(crowded.select("fp", F.explode(_points()).alias("point")))
    centres = points.groupBy("point").agg(F.min("fp").alias("least"))
    return links.union(points.join(centres, "point").where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct())


def _placed(docs: DataFrame) -> DataFrame:
    """Every document: doc_id, row, fp, component (a fingerprint) and component_id (the smallest doc_id reachable)."""
    prints = scratch(fingerprints(docs))
    fps = scratch(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    members = connected_components(near_links(fps.select("fp")), "a", "b").select(F.col("node").alias("fp"), F.col("component"))
    grouped = fps.join(members, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = scratch(grouped.join(smallest, "component").select("fp", "n", "component", "component_id"))
    total = named.agg(F.sum("n")).first()[0] or 0
    hot = named.where(F.col("n") > max(1, total // HOT)).select("fp", F.struct("component", "component_id").alias("hot"))
    rows = prints.join(F.broadcast(hot), "fp", "left")  # at most HOT fingerprints
    # Rows that have found their component are dealt out evenly and meet no other.
    salt = F.when(F.col("hot").isNull(), F.lit(0).cast("long")).otherwise(F.monotonically_increasing_id() + 1)
    rest = named.select("fp", F.lit(0).cast("long").alias("salt"), F.struct("component", "component_id").alias("found"))
    placed = rows.withColumn("salt", salt).join(rest, ["fp", "salt"], "left").withColumn("in", F.coalesce("hot", "found"))
    return placed.select("doc_id", "row", "fp", "in.component", "in.component_id")


def near_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links.

    Documents link if their fingerprints differ in LIMIT bits or fewer. Empty and null texts have
    fingerprint 0. Null ids never name a component unless all its ids are null. Repeated rows are kept;
    other columns are ignored.

    Fingerprints of more than one row in HOT are few, whatever the input, and find their component by a
    broadcast; all others by a shuffle.
    """
    return _placed(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row of each group, with all its columns: the one with the smallest doc_id, and of rows that share
    that (or have none), one by a hash of the row. Columns may have any name."""
    stays = _placed(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component", "doc_id", "row").agg(F.count("*").alias("n"))
    one = stays.groupBy("component", "doc_id").agg(F.min(F.struct("row", "n")).alias("kept"))
    return rows_of(docs, scratch(one.select("doc_id", "kept.row", "kept.n")))
