"""Training, linking and the stored graph against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import linking, training
from graphloom.sources import store


def frames(spark, x, pairs):
    v = spark.createDataFrame([(k, [float(e) for e in row]) for k, row in x.items()], "id string, x array<double>")
    return v, spark.createDataFrame([(s, t, y, i) for i, (s, t, y) in enumerate(pairs)], "source string, target string, label int, number long")


def loss(x, pairs):
    return sum(np.log1p(np.exp(-(2 * y - 1) * (x[s] @ x[t]))) for s, t, y in pairs)


def test_gradients_against_differences(spark):
    rng = np.random.default_rng(3)
    x = {k: rng.standard_normal(3) for k in "abcde"}
    pairs = [("a", "b", 1), ("b", "c", 0), ("a", "c", 1), ("c", "c", 0), ("b", "a", 0)]
    v, p = frames(spark, x, [*pairs, ("a", "gone", 1)])
    got = {r.id: np.array(r.g) for r in training.pair_gradients(p, v).collect()}
    assert set(got) == set("abc")
    assert training.pair_loss(p, v) == pytest.approx(loss(x, pairs) / len(pairs))
    for k in got:
        for i in range(3):
            up, down = ({n: e + (1e-5 if n == k else 0) * np.eye(3)[i] * sign for n, e in x.items()} for sign in (1, -1))
            assert got[k][i] == pytest.approx((loss(up, pairs) - loss(down, pairs)) / 2e-5, abs=1e-6)


def test_training_learns_repeats_and_stops(spark):
    rng = np.random.default_rng(4)
    names = [f"{g}{i}" for g in "xy" for i in range(8)]
    x = {k: 0.3 * rng.standard_normal(4) for k in names}
    pairs = [(a, b, int(a[0] == b[0])) for a in names for b in names if a < b]
    rng.shuffle(pairs)
    pairs = [(str(a), str(b), int(y)) for a, b, y in pairs]
    v, p = frames(spark, x, pairs[:90])
    held = frames(spark, x, pairs[90:])[1]
    trained, losses = training.train_vectors(p, held, v, epochs=6, batches=2, rate=0.1)
    assert losses == training.train_vectors(p, held, v, epochs=6, batches=2, rate=0.1)[1]
    assert losses[-1][1] < losses[0][1] and losses[-1][2] < 0.5 < training.pair_loss(held, v)
    assert training.pair_loss(held, trained) == pytest.approx(min(r[2] for r in losses))
    # A step far too long makes the held pairs worse, so training ends after patience epochs, with the best vectors.
    wild, losses = training.train_vectors(p, held, v, epochs=9, rate=50.0, patience=2)
    best = min(losses, key=lambda r: r[2])
    assert len(losses) == best[0] + 2 < 9 and training.pair_loss(held, wild) == pytest.approx(best[2])


def plain_links(text, names, most=3):
    w, out, at = text.lower().split(" "), [], 0
    while at < len(w):
        for n in range(min(most, len(w) - at), 0, -1):
            run = " ".join(w[at : at + n])
            if run in names:
                out.append((at, at + n, run, names[run]))
                at += n
                break
        else:
            at += 1
    return out


def test_leftmost_longest_names(spark):
    rng = random.Random(6)
    names = {"a": 1, "a b": 2, "b c d": 3, "c": 4, "d d": 5, "x": 9}
    texts = [(i, " ".join(rng.choice("abcdx") for _ in range(rng.randrange(1, 40)))) for i in range(60)] + [(100, ""), (101, "A B c"), (102, None)]
    rows = [(k, v, 0.9) for k, v in names.items()] + [("a", 0, 0.9), ("a b", 7, 0.8), ("c", 0, 0.2), ("b", 8, 0.1), (None, 5, 1.0)]
    docs, gaz = spark.createDataFrame(texts, "id long, content string"), spark.createDataFrame(rows, "name string, key long, confidence double")
    want = sorted((i, *m) for i, t in texts if t is not None for m in plain_links(t, names | {"a": 0}))
    assert sorted(map(tuple, linking.linked(docs, gaz, least=0.5).collect())) == want
    assert linking.linked(docs.where("false"), gaz).count() == 0


def test_stored_relations_are_read_alone_and_meet_without_a_shuffle(spark, tmp_path):
    rows = [(f"p_{i % 40}", f"{r}_{i}", r) for i in range(200) for r in ("pd", "pa", "pk")]
    name = store.write_graph(spark.createDataFrame(rows, "source string, target string, rel string"), path=str(tmp_path / "graph"), buckets=4)
    both = store.two_relations(spark, name, "pd", "pa")
    plan = both.groupBy("source").agg(F.count("*").alias("n"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and text.count("PartitionFilters: [isnotnull(rel") == 2
    assert sorted(map(tuple, plan.collect())) == sorted((f"p_{i}", 25) for i in range(40))
    assert {r.target[:2] for r in store.relation(spark, name, "pk").collect()} == {"pk"}
    spark.sql(f"DROP TABLE {name}")


def test_parts_and_negatives_are_read_not_made_again(spark):
    """Each part of a split is used by those after it, and a slot's first draw is mostly free."""
    from pyspark.sql import functions as F

    from graphloom.operators import split

    rows = [(f"p{i % 37}", f"d{i % 23}", i) for i in range(300)]
    edges = spark.createDataFrame(rows, "source string, target string, key long")
    same = F.length("source").cast("long")  # few values, so that ties reach over the last edge taken
    parts = split.inductive(edges, [same] * 4, share=0.1)
    assert all("Join" not in p._jdf.queryExecution().optimizedPlan().toString() for p in parts.values())
    first = sorted({(s, t) for s, t, _ in rows}, key=lambda e: (len(e[0]), *e))[: int(0.1 * 300)]
    assert {(r.source, r.target) for r in parts["validation_trans"].union(parts["test_semi"]).collect()} and set(first) >= {(r.source, r.target) for r in parts["test_semi"].collect()}
    slots = spark.createDataFrame([(i, f"p{i % 37}") for i in range(50)], "slot long, source string")
    targets = spark.createDataFrame([(i, f"d{i}") for i in range(23)], "idx long, target string")
    found = split.negatives_at_random(slots, targets, edges)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 50 and found.join(edges, ["source", "target"]).count() == 0


def test_rounds_of_components_leave_fewer_edges(spark, monkeypatch):
    from graphloom.operators import components

    sizes, kept = [], components.scratch

    def counted(df):
        out = kept(df)
        if out.columns == ["a", "b"]:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(components, "scratch", counted)
    path = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("x", "y"), ("y", "y"), ("z", "z"), ("z", None)]
    found = {r.node: r.component for r in components.connected_components(spark.createDataFrame(path, "source string, target string")).collect()}
    assert found == {f"n{i:03}": "n000" for i in range(61)} | {"x": "x", "y": "x", "z": "z"}
    assert sizes[0] == 63 and sizes[-1] == 0 and all(b < a for a, b in zip(sizes[1:], sizes[2:], strict=False))
