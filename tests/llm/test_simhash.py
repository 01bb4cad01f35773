import re

import numpy as np
import pyarrow as pa
import xxhash

from graphloom.llm import simhash
from graphloom.operators.components import connected_components
from tests.llm.conftest import AWKWARD, fold, table


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(shingles))


def brute(rows):
    prints = [(i, fingerprint(t)) for i, t in rows]
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(prints):
        r = find(k)
        least[r] = min(least.get(r, i), i)
    return sorted((i, f"{fp:016x}", least[find(k)]) for k, (i, fp) in enumerate(prints))


def test_matches_brute_force(spark, documents):
    rows = documents + [(10_000 + i, (t or "") + " more") for i, t in documents[:80]]
    got = sorted(map(tuple, simhash.near_components(table(spark, rows)).collect()))
    assert got == brute(rows)
    assert len({c for _, _, c in got}) < len(got)


def test_batches_are_cut_without_loss(documents):
    """More rows than a task takes at once, from the middle of an Arrow array."""
    texts = [t for _, t in documents] * 4
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "row", "text"])
    got = [v for b in simhash._fingerprint_batches([batch]) for v in b.column(2).to_numpy().view(np.uint64).tolist()]
    assert got == [fingerprint(t) for t in texts[: len(documents)]] * 4


def test_awkward_rows_and_empty_table(spark):
    assert sorted(map(tuple, simhash.near_components(table(spark, AWKWARD)).collect())) == brute(AWKWARD)
    assert simhash.near_components(table(spark, [])).collect() == []
    kept = {r.doc_id for r in simhash.near_dedup(table(spark, AWKWARD)).collect()}
    assert kept == {c for _, _, c in brute(AWKWARD)}


def test_pigeonring_keeps_every_near_pair():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    b = a.copy()
    for k in range(4):
        b ^= np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64)
    ok = np.zeros(4000, bool)
    for start in range(simhash.SEGMENTS):
        ok |= simhash.within_budgets(a ^ b, np.full(4000, start))
    assert ok.all()


def test_points_link_like_pairs(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(-(2**63), 2**63, 6, dtype=np.int64)
    fps = sorted({int(np.int64(b ^ (1 << int(x)) ^ (1 << int(y)))) for b in base for x, y in rng.integers(0, 63, (25, 2))})
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")

    def parts(**bound):
        return {tuple(r) for r in connected_components(simhash.near_links(frame, **bound), "a", "b").collect()}

    assert parts(bucket=1) == parts() and len(parts()) > 6
