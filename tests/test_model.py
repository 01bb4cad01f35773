"""The numpy forward passes against plain loops, and learned parts on held-out rows."""

import math

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from graphloom.functions.columns import portable_hash
from graphloom.operators import augment, clean, encode, model, rank, split, walks
from graphloom.queries_vectors import QUERIES

RNG = np.random.default_rng(12)
SEEDS = {"p_1": 3, "p_2": 1, "p_3": 5}
TEXT = {s: RNG.standard_normal((n, 6)) for s, n in SEEDS.items()}
NET = {s: RNG.standard_normal((n, 4)) for s, n in SEEDS.items()}


def neighbors(spark):
    rows = [(s, r, TEXT[s][r].tolist(), NET[s][r].tolist()) for s, n in SEEDS.items() for r in range(n)]
    return spark.createDataFrame(rows[::-1], "seed string, rank int, x array<double>, net array<double>")


def matrices(width_q, width, heads=2):
    return {"q": RNG.standard_normal((width_q, width)), "k": RNG.standard_normal((width, width)), "v": RNG.standard_normal((width, width)), "o": RNG.standard_normal((width, width))}


def plain(q, kv, w, heads=2):
    width = w["q"].shape[1] // heads
    out = np.zeros((len(q), w["q"].shape[1]))
    for h in range(heads):
        cut = slice(h * width, (h + 1) * width)
        for i in range(len(q)):
            e = [math.exp(float((q[i] @ w["q"][:, cut]) @ (kv[j] @ w["k"][:, cut])) / math.sqrt(width)) for j in range(len(kv))]
            out[i, cut] = sum(e[j] / sum(e) * (kv[j] @ w["v"][:, cut]) for j in range(len(kv)))
    return out @ w["o"]


def same(found, wanted):
    got = {r.seed: r.x for r in found.collect()}
    assert got.keys() == wanted.keys()
    for s, x in wanted.items():
        assert got[s] == pytest.approx(x.tolist())


def test_attention_pools(spark):
    w = matrices(6, 6)
    same(model.attention_pool(neighbors(spark), w), {s: plain(x, x, w).mean(axis=0) for s, x in TEXT.items()})
    same(model.combine_attention([neighbors(spark).where(f"rank = {r}") for r in (0, 1, 2)], w), {s: plain(x[:3], x[:3], w).mean(axis=0) for s, x in TEXT.items()})
    c = matrices(4, 4) | {"text": RNG.standard_normal((6, 4))}
    same(model.cross_attention_pool(neighbors(spark), c), {s: plain(TEXT[s] @ c["text"], NET[s], c)[0] for s in SEEDS})
    j = matrices(10, 10) | {"out": RNG.standard_normal((10, 3))}
    both = {s: np.concatenate([TEXT[s], NET[s]], axis=1) for s in SEEDS}
    wanted = {s: plain(x, x, j).mean(axis=0) @ j["out"] for s, x in both.items()}
    same(model.joint_attention_pool(neighbors(spark), j), {s: np.where(y > 0, y, 0.01 * y) for s, y in wanted.items()})


def test_cosine_attention(spark):
    out = RNG.standard_normal((6, 2))
    wanted = {}
    for s, x in TEXT.items():
        keys = x[1:] if len(x) > 1 else x
        e = [math.exp(float(k @ x[0]) / float(np.linalg.norm(k) * np.linalg.norm(x[0]))) for k in keys]
        wanted[s] = np.maximum(sum(a / sum(e) * k for a, k in zip(e, keys, strict=True)) @ out, 0)
    same(model.cosine_attention_pool(neighbors(spark), {"out": out}), wanted)


def test_walks_without_scored_steps_have_no_importance(spark):
    scored = spark.createDataFrame([("p_1", 0, "core", 0.5, 1.0), ("p_1", 1, "key", 1.0, 1.0)], "seed string, walk int, grp string, score double, penalty double")
    every = spark.createDataFrame([("p_1", 0), ("p_1", 1), ("p_9", 0)], "seed string, walk int")
    assert sorted(map(tuple, walks.walk_importance(scored, every).collect())) == [("p_1", 0, 0.5), ("p_1", 1, 0.0), ("p_9", 0, 0.0)]


def test_walks_end_at_dead_ends(spark):
    edges = spark.createDataFrame([("p_1", "d_1")], "source string, target string")
    seeds = spark.createDataFrame([("p_1", 1), ("p_2", 2)], "seed string, number long")
    assert {r.seed: r.path for r in walks.uniform_walks(seeds, edges, 1, 4).collect()} == {"p_1": ["p_1", "d_1", "p_1", "d_1"], "p_2": ["p_2"]}


def test_equal_links_are_numbered_once(spark):
    """Equal rows and both directions of a link, in one range of the order, take one number; no shuffle comes before it."""
    edges = spark.createDataFrame([(f"p_{i % 7}", f"d_{i % 5}") for i in range(200)] + [(f"d_{i % 5}", f"p_{i % 7}") for i in range(35)], "source string, target string")
    nodes, places = walks.numbered_edges(edges)
    wanted = sorted({(f"p_{i}", f"d_{j}") for i in range(7) for j in range(5)} | {(f"d_{j}", f"p_{i}") for i in range(7) for j in range(5)})
    assert [(r.at, r.node, r.next) for r in places.orderBy("at").collect()] == [(at, *pair) for at, pair in enumerate(wanted)]
    both = edges.select(F.col("source").alias("node"), F.col("target").alias("next"))
    found = encode.dense_numbers(both, ["node", "next"], "at", once=True)
    assert found.count() == 35 + 35 and found.agg(F.max("at")).first()[0] == 69


def test_steps_scored_by_numbers_from_ids(spark):
    """Numbers of vectors that follow from ids need no join, and only the columns asked for are carried."""
    steps = spark.createDataFrame([("p_1", 0, "d_4", 1, "core", 1.0), ("p_1", 0, "a_2", 2, "top", 0.5), ("p_2", 1, "p_1", 1, "core", 1.0)], "seed string, walk int, node string, distance int, grp string, penalty double")
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 2.0])], "vec long, x array<double>")
    number = lambda node: F.substring(node, 3, 20).cast("long") % 3
    ids = spark.createDataFrame([(k, int(k[2:]) % 3) for k in ("p_1", "p_2", "d_4")], "id string, vec long")
    found = walks.walk_scores(steps, number, table, ("seed", "walk", "grp", "penalty"))
    assert found.columns == ["seed", "walk", "grp", "penalty", "score"]
    assert sorted((r.seed, r.grp, round(r.score, 9)) for r in found.collect()) == sorted((r.seed, r.grp, round(r.score, 9)) for r in walks.walk_scores(steps, ids, table).collect())


def test_hashes_of_large_keys(spark):
    keys = [0, 1, 2**31, 3_480_000_000, 15_000_000_000, 2**62]
    found = spark.createDataFrame([(k,) for k in keys], "k long").select("k", portable_hash(F.col("k"), 17).alias("h")).collect()
    assert all(r.h == (r.k % 2**31 * 2654435761 + 17) % 2**32 for r in found)


def test_negatives_draw_again_until_one_is_free(spark):
    edges = spark.createDataFrame([("p_1", f"d_{i}") for i in range(9)] + [("p_2", f"d_{i}") for i in range(10)], "source string, target string")
    targets = spark.createDataFrame([(i, f"d_{i}") for i in range(10)], "idx long, target string")
    slots = spark.createDataFrame([(i, "p_1") for i in range(5)] + [(9, "p_2")], "slot long, source string")
    found = split.negatives_at_random(slots, targets, edges, tries=2, rounds=40).collect()
    assert sorted((r.slot, r.target) for r in found) == [(i, "d_9") for i in range(5)]


def test_classifier_on_held_out_rows(spark):
    """Sources and targets of one group are linked, and their vectors are alike."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((4, 8))
    vectors = spark.createDataFrame([(f"{k}_{i}", (centres[i % 4] + 0.3 * rng.standard_normal(8)).tolist()) for k in "pd" for i in range(80)], "id string, x array<double>")
    pairs = spark.createDataFrame([(f"p_{i}", f"d_{j}", int(i % 4 == j % 4), bool((i * 7 + j) % 5 == 0)) for i in range(80) for j in rng.integers(0, 80, 12).tolist()], "source string, target string, label int, held boolean")
    found = model.link_classifier(pairs, vectors)
    assert rank.auc(found.where("held").select("score", "label")).first().auc > 0.9


def test_classifier_in_blocks_is_the_regression(spark, monkeypatch):
    """By blocks, without any product written, the chances are those of Spark's own regression over products."""
    monkeypatch.setattr(model, "PAIRS", 100)
    monkeypatch.setattr(model, "SIDE", 10)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((40, 3)) + 0.3
    rows = [(i, int(a), int(b), int(x[a] @ x[b] + rng.standard_normal() > 0), i % 5 == 0) for i, (a, b) in enumerate(rng.integers(0, 40, (900, 2)))]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec long, x array<double>")
    pairs = spark.createDataFrame([*rows, (900, 1, 77, 1, False)], "n int, va long, vb long, label int, held boolean")
    found = {r.n: r for r in model.numbered_classifier(pairs, table).collect()}
    assert set(found) == set(range(900)) and all((found[r[0]].label, found[r[0]].held) == r[3:] for r in rows)
    data = spark.createDataFrame([(r[0], (x[r[1]] * x[r[2]]).tolist(), float(r[3]), r[4]) for r in rows], "n int, p array<double>, label double, held boolean").withColumn("features", array_to_vector("p"))
    fitted = LogisticRegression(maxIter=200, regParam=0.01, tol=1e-12).fit(data.where("NOT held"))
    for r in fitted.transform(data).select("n", vector_to_array("probability")[1].alias("p")).collect():
        assert found[r.n].score == pytest.approx(r.p, abs=1e-5)


def test_clusters_find_groups_apart(spark):
    rng = np.random.default_rng(4)
    centres = 5 * rng.standard_normal((3, 12))
    rows = [(i, (centres[i % 3] + rng.standard_normal(12)).tolist()) for i in range(120)]
    found = augment.cluster_topics(spark.createDataFrame(rows, "doc long, x array<double>"), 3, width=3).collect()
    assert len(found) == 120 and len({(r.doc % 3, r.topic) for r in found}) == 3


def test_annotators_and_words(spark):
    docs = spark.createDataFrame([("p_1", "Big cities of boxes"), ("p_2", None)], "id string, content string")

    def annotator(frames):
        for f in frames:
            whole = f.dropna()
            yield whole.assign(mention=whole["content"].str[:3])[["id", "mention"]]

    assert [tuple(r) for r in augment.annotate(docs, annotator, "id string, mention string").collect()] == [("p_1", "Big")]
    topics = spark.createDataFrame([(1, ["cities", "city", "boxes", "glass", "box"])], "topic long, words array<string>")
    assert augment.reduced_words(topics).first().words == ["city", "box", "glass"]
    nodes = spark.createDataFrame([(1, "A b-1", None)], "id long, title string, description string")
    assert clean.with_content(nodes).first().content == "a b nan"


def test_queries_without_sql(spark):
    found = QUERIES["q_structural_vectors"](spark, "/root/testdata/sf0.001").collect()
    assert len({r.id for r in found}) == len(found) > 1000 and {len(r.x) for r in found} == {16}
