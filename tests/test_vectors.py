"""Similarity joins, walks, complements, structural vectors and density clusters against plain versions."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import complement, density, graph, propagate, rank, similarity, split, structural, walks


def vectors(spark, rows, key="id long"):
    return spark.createDataFrame([(i, None if x is None else [float(v) for v in x]) for i, x in rows], f"{key}, x array<double>")


def clustered(seed, n=300, width=12, spread=0.35):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, width))
    return [(i, centres[i % 6] + spread * rng.standard_normal(width) * (1 + i % 3)) for i in range(n)]


def plain_pairs(rows, threshold):
    rep = {}
    for i, x in sorted((i, tuple(float(v) for v in x)) for i, x in rows if x is not None):
        rep.setdefault(x, i)
    rows = [(i, np.array(x)) for x, i in rep.items() if any(x)]
    cos = lambda x, y: float(x @ y / np.sqrt((x @ x) * (y @ y)))
    return {(min(i, j), max(i, j)): cos(x, y) for i, x in rows for j, y in rows if i < j and cos(x, y) > threshold}


@pytest.mark.parametrize("hot", [4096, 7])
def test_similar_pairs_are_all_found_once(spark, monkeypatch, hot):
    monkeypatch.setattr(similarity, "HOT", hot)
    rows = clustered(1) + [(900 + i, np.ones(12)) for i in range(40)] + [(950, np.zeros(12)), (951, None)]
    found = similarity.similar_pairs(vectors(spark, rows), 0.75, recall=0.9999).collect()
    want = plain_pairs(rows, 0.75)
    assert len(found) == len(want) and {(r.a, r.b) for r in found} == set(want)
    assert all(abs(r.score - want[r.a, r.b]) < 1e-9 for r in found)
    assert {(r.a, r.b) for r in similarity.copy_links(vectors(spark, rows)).collect()} == {(900, 900 + i) for i in range(1, 40)}


def test_recall_asked_for_is_reached(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((400, 32))
    noise = rng.standard_normal((400, 32))
    rows = [(i, x) for i, x in enumerate(base)] + [(1000 + i, x + 0.85 * z) for i, (x, z) in enumerate(zip(base, noise, strict=True))]
    v = vectors(spark, rows)
    r = similarity.join_recall(v, similarity.similar_pairs(v, 0.75, recall=0.95), F.lit(True)).first()
    assert r.exact == len(plain_pairs(rows, 0.75)) > 100 and r.found >= 0.95 * r.exact


def test_no_vectors_and_few(spark):
    none = vectors(spark, []).where("false")
    assert similarity.similar_pairs(none, 0.75).count() == 0
    assert [(r.a, r.b) for r in similarity.similar_pairs(vectors(spark, [(1, [1, 0]), (2, [2, 0.1])]), 0.75).collect()] == [(1, 2)]


def test_enriched_edges_add_each_new_pair_once(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("d", "c")], "source string, target string")
    pairs = spark.createDataFrame([("a", "b", 1.0), ("c", "d", 1.0), ("a", "c", 1.0)], "a string, b string, score double")
    assert sorted(map(tuple, similarity.enriched(edges, pairs).collect())) == [("a", "b", False), ("a", "c", True), ("d", "c", False)]


def test_second_order_frequencies_of_a_triangle_and_a_tail(spark):
    # From b, after a: back to a (1/p), to c, a neighbour of a (1), or to d (1/q).
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("b", "d")], "source string, target string")
    seeds = spark.createDataFrame([("a",)], "seed string")
    found = walks.random_walks(seeds, edges, walks=6000, length=3, restart=0.0, p=0.5, q=0.25).collect()
    after = Counter(r.path[2] for r in found if r.path[1] == "b")
    total = sum(after.values())
    assert {k: round(v / total, 1) for k, v in after.items()} == {"a": 0.3, "c": 0.1, "d": 0.6}
    assert abs(after["a"] / total - 2 / 7) < 0.03 and abs(after["d"] / total - 4 / 7) < 0.03


def test_walks_restart_stay_alone_and_can_be_repeated(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("x", "y")], "source string, target string")
    seeds = spark.createDataFrame([("a",), ("a",), ("x",), ("alone",)], "seed string")
    runs = [sorted(map(tuple, walks.random_walks(seeds, edges, walks=50, length=9, restart=0.3, tries=t).collect())) for t in (8, 8, 1)]
    assert runs[0] == runs[1] and len(runs[0]) == len(runs[2]) == 150
    joined = {("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("x", "y")}
    for seed, _, path in runs[0] + runs[2]:
        assert path[0] == seed and len(path) == 9
        assert all(n == seed or (m, n) in joined or (n, m) in joined for m, n in zip(path, path[1:], strict=False))
    steps = [n == "a" for s, _, path in runs[0] if s == "a" for m, n in zip(path, path[1:], strict=False) if m == "c"]
    assert 0.2 < np.mean(steps) < 0.4  # a is no neighbour of c, so only a restart leads there


def test_free_targets_by_rank(spark):
    rng = random.Random(2)
    targets = [(i, f"d_{i}") for i in range(30)]
    known = {s: sorted(rng.sample(range(30), rng.choice([0, 1, 5, 29]))) for s in range(12)} | {12: list(range(30))}
    edges = spark.createDataFrame([(f"p_{s}", f"d_{t}") for s, ts in known.items() for t in ts] + [("p_0", "other")] * 2, "source string, target string")
    slots = spark.createDataFrame([(100 * s + i, f"p_{s}") for s in known for i in range(40)] + [(9000, "p_new")], "slot long, source string")
    where = spark.createDataFrame(targets, "idx long, target string")
    found = complement.free_draws(slots, where, edges, F.col("slot") * 7 + F.col("try"), tries=3).collect()
    free = {f"p_{s}": [t for t in range(30) if t not in ts] for s, ts in known.items()} | {"p_new": list(range(30))}
    want = sorted((r.slot, r.source, t, f"d_{free[r.source][(r.slot * 7 + t) % len(free[r.source])]}") for r in slots.collect() if free[r.source] for t in range(3))
    assert sorted((r.slot, r.source, r["try"], r.target) for r in found) == want


def test_no_slot_is_lost_when_few_targets_are_free(spark):
    where = spark.createDataFrame([(i, f"d_{i}") for i in range(500)], "idx long, target string")
    edges = spark.createDataFrame([("p_1", f"d_{i}") for i in range(500) if i != 321], "source string, target string")
    slots = spark.createDataFrame([(i, "p_1") for i in range(20)], "slot long, source string")
    found = split.negatives_at_random(slots, where, edges, tries=2, rounds=2).collect()
    assert sorted(r.slot for r in found) == list(range(20)) and {r.target for r in found} == {"d_321"}


def plain_counts(paths, window):
    out = Counter()
    for path in paths:
        out.update((a, b) for i, a in enumerate(path) for j, b in enumerate(path) if i != j and abs(i - j) <= window)
    return out


def test_structural_factors_rebuild_the_matrix(spark):
    rng = random.Random(7)
    paths = [[rng.choice("abcdefgh"[k : k + 4]) for _ in range(rng.randrange(1, 9))] for k in (0, 1, 4) for _ in range(40)]
    frame = spark.createDataFrame([(p,) for p in paths], "path array<string>")
    counts = structural.cooccurrences(frame, 3)
    assert {(r.node, r.context): r.n for r in counts.collect()} == plain_counts(paths, 3)
    n = plain_counts(paths, 3)
    sums = Counter()
    for (a, _), c in n.items():
        sums[a] += c
    pmi = {k: np.log(c * sum(sums.values()) / (sums[k[0]] * sums[k[1]])) for k, c in n.items()}
    got = {(r.node, r.context): r.v for r in structural.positive_pmi(counts).collect()}
    assert got.keys() == {k for k, v in pmi.items() if v > 0} and all(abs(v - pmi[k]) < 1e-9 for k, v in got.items())
    names = sorted({a for a, _ in got})
    m = np.array([[got.get((a, b), 0.0) for b in names] for a in names])
    matrix = spark.createDataFrame([(a, b, float(v)) for (a, b), v in got.items()], "node string, context string, v double")
    factors, values = structural.factorize(matrix, width=len(names), rounds=12, extra=2)
    x = np.array([r.x for r in sorted(factors.collect(), key=lambda r: r.id)])
    assert np.allclose(x @ np.diag(values) @ x.T, m, atol=1e-6)
    few, top = structural.factorize(matrix, width=3, rounds=40)
    want = np.linalg.eigvalsh(m)
    assert np.allclose(sorted(np.abs(top)), sorted(np.abs(want))[-3:], atol=1e-5)


def test_structural_vectors_tell_parts_of_a_graph_apart(spark):
    rng = np.random.default_rng(5)
    paths = [[f"{k}{x}" for x in rng.integers(0, 8, 12)] for k in "ab" for _ in range(200)]
    found = {r.id: np.array(r.x) for r in structural.structural_vectors(spark.createDataFrame([(p,) for p in paths], "path array<string>"), width=4, rounds=4).collect()}
    pairs = [(x[0] == y[0], float(found[x] @ found[y])) for x in found for y in found if x < y]
    assert len(found) == 16 and min(c for same, c in pairs if same) > max(c for same, c in pairs if not same)


def plain_clusters(edges, weights, smallest, cuts):
    """The same tree by union-find for each level and a recursion."""
    levels = []
    for cut in cuts:
        parent = {i: i for i in weights}

        def root(i, parent=parent):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b, w in edges:
            if w <= cut and root(a) != root(b):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
        groups = defaultdict(set)
        for i in weights:
            groups[root(i)].add(i)
        levels.append([g for g in groups.values() if sum(weights[i] for i in g) >= smallest])

    def taken(group, level):
        """Stability of what is taken at or below a cluster that begins at the level, and these clusters."""
        own, members = 0.0, group
        for l in range(level - 1, -1, -1):
            inside = [g for g in levels[l] if g <= group]
            if not inside:
                break
            if len(inside) > 1:
                below = [taken(g, l) for g in inside]
                total = sum(b[0] for b in below)
                return (own, [(members, level)]) if round(own, 9) >= round(total, 9) else (total, [c for b in below for c in b[1]])
            group = inside[0]
            own += sum(weights[i] for i in group) * (1 / cuts[l] - 1 / cuts[l + 1])
        return own, [(members, level)]

    out = {}
    for g in levels[-1] if levels else []:
        for members, level in taken(g, len(cuts) - 1)[1]:
            out |= {i: (min(members), level) for i in members}
    return {i: out.get(i, (None, None)) for i in weights}


@pytest.mark.parametrize("seed", range(2))
def test_density_clusters_against_a_plain_tree(spark, seed):
    rng = random.Random(seed)
    weights = {i: rng.choice([1, 1, 1, 4]) for i in range(60)}
    place = {i: (rng.choice([0, 3, 7, 20, 22]) + rng.random() ** 2 * 3, rng.random()) for i in weights}
    edges = [(i, j, abs(place[i][0] - place[j][0]) + 0.3 * abs(place[i][1] - place[j][1])) for i in weights for j in weights if i < j]
    edges = [e for e in edges if e[2] < 5]
    cuts = sorted({round(x, 2) for x in np.quantile([e[2] for e in edges], [0.02, 0.05, 0.1, 0.3, 0.6, 1.0])})
    found = density.density_clusters(spark.createDataFrame(edges, "a long, b long, w double"), spark.createDataFrame(list(weights.items()), "id long, weight long"), 6, cuts).collect()
    want = plain_clusters(edges, weights, 6, cuts)
    assert {r.id: (r.cluster, r.level) for r in found} == want and len({c for c, _ in want.values()}) > 2


def test_density_topics_find_groups_and_outliers(spark):
    rng = np.random.default_rng(8)
    centres = np.eye(8)[:3] * 5
    rows = [(i, centres[i % 3] + 0.4 * rng.standard_normal(8)) for i in range(90)] + [(200 + i, -np.eye(8)[5 + i % 3] * 3 + 0.1 * i) for i in range(3)]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (400, np.zeros(8)), (401, None)]
    found = {r.id: r.topic for r in density.density_topics(vectors(spark, rows), smallest=8, neighbors=4, floor=0.4, recall=0.999).collect()}
    assert len(found) == len(rows) and found[300] == found[301] == found[0]
    assert all(found[i] == -1 for i in (200, 201, 202, 400, 401))
    for g in range(3):
        assert Counter(found[i] for i in range(g, 90, 3)).most_common(1)[0][1] >= 27
    assert len({Counter(found[i] for i in range(g, 90, 3)).most_common(1)[0][0] for g in range(3)}) == 3
    none = vectors(spark, [(1, [1, 0]), (2, None)])
    assert [tuple(r) for r in density.density_topics(none).orderBy("id").collect()] == [(1, -1), (2, -1)]


def components_at(edges, cut):
    """The smallest point that each reaches by edges up to the cut."""
    root = {}

    def top(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b, w in edges:
        if w <= cut:
            a, b = sorted((top(a), top(b)))
            root[b] = a
    return {i: top(i) for i in root}


def test_forests_have_the_components_of_all_pairs(spark, monkeypatch):
    """By blocks no more than a forest of each two is written, with the components of all pairs at each level."""
    monkeypatch.setattr(similarity, "FEW", 60)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((5, 6))
    rows = [(i, centres[i % 5] + (0.2 + 0.1 * (i % 3)) * rng.standard_normal(6)) for i in range(200)]
    rows += [(300 + i, rows[i][1]) for i in range(0, 60, 2)] + [(500, np.zeros(6)), (501, None)]
    given = vectors(spark, rows)
    classes = similarity.vector_classes(given)
    weights = classes.groupBy(F.col("rep").alias("id")).agg(F.count("*").alias("weight"))
    pairs = similarity.similar_pairs(given, 0.3).select("a", "b", (1 - F.col("score")).alias("d"))
    every = [tuple(r) for r in density.reachability(pairs, weights, 3).collect()]
    found, cuts = density._compared(classes, weights, 3, 0.3, 12)
    edges = [tuple(r) for r in found.collect()]
    wanted = np.quantile([w for _, _, w in every], [(i + 1) / 12 for i in range(12)])
    assert cuts == pytest.approx(wanted, abs=2e-3) and len(edges) < len(every) / 3
    for cut in cuts:
        assert components_at(edges, cut) == components_at(every, cut)


@pytest.mark.parametrize("seed", range(3))
def test_spanning_forests(seed):
    rng = np.random.default_rng(seed)
    u, v = rng.integers(0, 300, (2, 900))
    u, v = u[u != v], v[u != v]
    w = rng.integers(0, 50, len(u)) / 10
    keep = density.spanning_forest(u, v, w, 300)
    edges = list(zip(u.tolist(), v.tolist(), w.tolist(), strict=True))
    for cut in (0.3, 1.0, 5.0):
        some, every = components_at([edges[i] for i in keep], cut), components_at(edges, cut)
        assert some == every
    assert len(keep) == len(every) - len(set(every.values()))


def test_core_distances_count_copies(spark):
    pairs = spark.createDataFrame([(1, 2, 0.1), (1, 3, 0.5), (2, 3, 0.2)], "a long, b long, d double")
    weights = spark.createDataFrame([(1, 1), (2, 2), (3, 1)], "id long, weight long")
    found = {(r.a, r.b): r.w for r in density.reachability(pairs, weights, 2).collect()}
    assert found == {(1, 2): 0.1, (1, 3): 0.5, (2, 3): 0.2}  # cores: 0.1, 0.1, 0.2


@pytest.mark.parametrize("kind", ["even", "skewed", "tied low", "tied high", "few", "same"])
def test_exact_percentiles_of_awkward_columns(spark, monkeypatch, kind):
    monkeypatch.setattr(graph, "FEW_VALUES", 40)
    rng = np.random.default_rng(len(kind))
    values = {
        "even": rng.random(900), "skewed": np.exp(30 * rng.random(900)), "tied low": np.concatenate([np.zeros(880), rng.random(60)]),
        "tied high": np.concatenate([np.full(880, 9.0), rng.random(60)]), "few": rng.integers(0, 3, 900).astype(float), "same": np.full(300, 4.0),
    }[kind]
    rows = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    for q in (0.0, 0.5, 0.937, 0.95, 1.0):
        assert graph.exact_percentile(rows, "v", q) == pytest.approx(np.percentile(values, 100 * q), rel=1e-12, abs=1e-12)
    assert graph.exact_percentile(rows.where("false"), "v", 0.5) is None


def test_layers_against_plain_loops(spark):
    rng = np.random.default_rng(9)
    names = "abcde"
    x = {k: rng.standard_normal(3) for k in names}
    edges = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "c"), ("d", "a"), ("a", "gone")]
    near = {k: sorted({k} | {t for s, t in edges if s == k and t in x} | {s for s, t in edges if t == k and s in x}) for k in names}
    w, to, other = rng.standard_normal((3, 2)), rng.standard_normal(2), rng.standard_normal(2)
    e, f = spark.createDataFrame(edges, "source string, target string"), vectors(spark, list(x.items()), "id string")
    got = {r.id: np.array(r.x) for r in propagate.attention_layer(e, f, [(w.tolist(), to.tolist(), other.tolist())] * 2).collect()}
    conv = {r.id: np.array(r.x) for r in propagate.convolution_layer(e, f, w.tolist()).collect()}
    for k in names:
        score = np.array([to @ (x[k] @ w) + other @ (x[n] @ w) for n in near[k]])
        score = np.where(score > 0, score, 0.2 * score)
        weight = np.exp(score) / np.exp(score).sum()
        want = sum(a * (x[n] @ w) for a, n in zip(weight, near[k], strict=True))
        assert np.allclose(got[k], np.concatenate([want, want]))
        assert np.allclose(conv[k], sum((x[n] @ w) / np.sqrt(len(near[k]) * len(near[n])) for n in near[k]))
    logs = vectors(spark, [(k, [0.1, -0.2, 0.3]) for k in names], "id string")
    kl = propagate.kl_to_normal(f, logs).first().kl
    assert kl == pytest.approx(np.mean([-0.5 * sum(1 + 2 * s - m * m - np.exp(2 * s) for m, s in zip(v, [0.1, -0.2, 0.3], strict=True)) for v in x.values()]))


def test_neighbors_in_type_order(spark):
    rows = [("s", n, sc, r) for r, (n, sc) in enumerate([("v_1", 0.9), ("a_2", 0.8), ("o_1", 0.7), ("a_1", 0.7), ("k_1", 0.6), ("a_9", 0.1)], 1)]
    best = spark.createDataFrame(rows, "seed string, node string, score double, rank int")
    found = walks.in_type_order(best, walks.TOP_ORDER, 5).orderBy("rank").collect()
    assert [(r.node, r["rank"]) for r in found] == [("a_2", 1), ("a_1", 2), ("v_1", 3), ("o_1", 4)]


def test_numbered_pairs_meet_their_vectors_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(rank, "GROUP", 50)
    rng = np.random.default_rng(4)
    x = {i: rng.standard_normal(5) for i in range(40)} | {40: np.zeros(5)}
    pairs = [(n, int(a), int(b)) for n, (a, b) in enumerate(rng.integers(0, 43, (400, 2)))]  # 41 and 42 have no vector
    table = spark.createDataFrame([(i, [float(e) for e in v]) for i, v in x.items()], "vec long, x array<float>")
    found = {r.n: r.score for r in rank.numbered_cosines(spark.createDataFrame(pairs, "n int, va long, vb long"), table).collect()}
    assert set(found) == {n for n, a, b in pairs if a < 41 and b < 41}
    for n, a, b in pairs:
        if n in found:
            want = None if 40 in (a, b) else x[a] @ x[b] / np.sqrt((x[a] @ x[a]) * (x[b] @ x[b]))
            assert found[n] == (None if want is None else pytest.approx(want, abs=1e-5))


def test_links_are_dealt_once_for_all_steps_of_walks(spark):
    given = spark.createDataFrame([("hub", f"n{i}") for i in range(50)] + [("n1", "n2")], "source string, target string")
    nodes, links = walks.numbered_links(given)
    sizes = {r.node: (r.first, r.size) for r in nodes.collect()}
    rows = links.orderBy("at").collect()
    assert [r.at for r in rows] == list(range(102)) and all((r.first, r.size) == sizes[r.next] for r in rows)
    # The walks are shuffled by the number of the link, the links are not.
    asked = spark.createDataFrame([(3,)], "at long").hint("shuffle_hash").join(links, "at", "left")
    assert asked._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(at") == 1


def test_pairs_are_counted_and_cut_where_they_are_compared(spark, monkeypatch):
    monkeypatch.setattr(rank, "QUERIES", 3)
    monkeypatch.setattr(rank, "CANDIDATES", 11)
    rng = np.random.default_rng(8)
    x = {i: rng.integers(-2, 3, 3).astype(float) for i in range(60)}  # few different vectors, so scores tie, and some are zero
    rows = spark.createDataFrame([(i, [float(e) for e in v], i % 4) for i, v in x.items()], "vec_id long, x array<float>, label int")
    asked, all_ = rows.where("vec_id % 5 = 0").withColumnRenamed("vec_id", "query"), rows.withColumnRenamed("vec_id", "candidate")
    score = lambda a, b: round(float(x[a] @ x[b] / np.sqrt((x[a] @ x[a]) * (x[b] @ x[b]))), 6) if x[a].any() and x[b].any() else None
    want = {(a, b): score(a, b) for a in range(0, 60, 5) for b in x if a != b}
    counts = Counter((s, int(a % 4 == b % 4)) for (a, b), s in want.items())
    assert {(r.score, r.label): r.n for r in rank.score_counts(asked, all_, (6,)).collect()} == counts
    cut = rank.scored_pairs(asked, all_, digits=6, best=7).where("query <> candidate")
    plain = defaultdict(list)
    for (a, b), s in want.items():
        plain[a].append((-s if s is not None else 9, b))
    assert {(r.query, r.candidate) for r in rank.top_k(cut, 7).collect()} == {(a, b) for a, found in plain.items() for _, b in sorted(found)[:7]}
    assert all(want[r.query, r.candidate] == r.score for r in cut.collect())


def test_areas_of_counted_pairs(spark):
    counted = spark.createDataFrame([(0.9, 1, 2), (0.5, 0, 3), (0.1, 1, 1)], "score double, label int, n long")
    plain = counted.select(F.explode(F.array_repeat(F.struct("score", "label"), F.col("n").cast("int"))).alias("r")).select("r.*")
    assert rank.auc(counted).first() == rank.auc(plain).first() and rank.average_precision(counted).first() == rank.average_precision(plain).first()
    assert rank.f1_at(counted, 0.5).first() == rank.f1_at(plain, 0.5).first()


def test_negatives_by_numbers_of_vectors_are_those_by_vectors(spark):
    rng = np.random.default_rng(6)
    x = {i: [float(e) for e in rng.standard_normal(4).astype(np.float32)] for i in range(5)}
    slots = [(s, f"p_{s % 7}", s % 5) for s in range(30)]
    targets = spark.createDataFrame([(i, f"d_{i}", i % 5) for i in range(9)], "idx long, target string, vec long")
    edges = spark.createDataFrame([("p_1", f"d_{i}") for i in range(8)] + [("p_2", "d_3")], "source string, target string")
    table = spark.createDataFrame(list(x.items()), "vec long, x array<float>")
    given = spark.createDataFrame(slots, "slot long, source string, vec long")
    found = split.negatives_by_cosine(given, targets, edges, targets, tries=4, rounds=2, table=table).collect()
    both = [d.join(table, "vec").drop("vec") for d in (given, targets)]
    plain = split.negatives_by_cosine(both[0], targets.select("idx", "target"), edges, both[1].select("target", "x"), tries=4, rounds=2).collect()
    assert len(found) == 30 and {(r.slot, r.source, r.target, r.score) for r in found} == {(r.slot, r.source, r.target, r.score) for r in plain}


@pytest.mark.parametrize("digits", [(9, 3), (2,)])
def test_counts_in_single_precision_are_exact(spark, digits):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((700, 6)).astype(np.float32)
    x[5] = 0
    rows = spark.createDataFrame([(i, [float(e) for e in v], i % 3) for i, v in enumerate(x)], "vec_id long, x array<float>, label int")
    y = x.astype(float)
    with np.errstate(invalid="ignore"):
        score = (y @ y.T) / np.sqrt(np.outer((y * y).sum(1), (y * y).sum(1)))
    for d in digits:
        score = np.copysign(np.floor(np.abs(score) * 10.0**d + 0.5) / 10.0**d, score) + 0.0
    want = Counter((None if np.isnan(s) else float(s), int(a % 3 == b % 3)) for a in range(0, 700, 5) for b, s in enumerate(score[a]) if a != b)
    found = rank.score_counts(rows.where("vec_id % 5 = 0").withColumnRenamed("vec_id", "query"), rows.withColumnRenamed("vec_id", "candidate"), digits)
    assert {(r.score, r.label): r.n for r in found.collect()} == want


def test_copies_of_a_vector_are_cut_in_their_block(spark, monkeypatch):
    monkeypatch.setattr(rank, "FEW", 100)
    rows = spark.createDataFrame([(i, [1.0, 2.0] if i % 3 else [1.0, float(i)]) for i in range(900)], "id long, x array<float>")
    asked = rows.where("id < 20").withColumnRenamed("id", "query")
    found = rank.scored_pairs(asked, rows.withColumnRenamed("id", "candidate"), digits=9, best=5)
    blocks = 4  # as many as tasks
    assert 20 * 6 <= found.count() <= 20 * 6 * blocks
    best = {(r.query, r.candidate) for r in rank.top_k(found.where("query <> candidate"), 5).collect() if r.query % 3}
    assert best == {(q, c) for q in range(20) if q % 3 for c in [c for c in range(20) if c % 3 and c != q][:5]}


def test_pairs_after_those_that_are_known(spark):
    rows = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(9)], "candidate long, x array<double>")
    asked = spark.createDataFrame([(0, [1.0, 0.0], 0.98, 2), (1, [1.0, 0.0], float("-inf"), 5)], "query long, x array<double>, last_score double, last_candidate long")
    found = rank.scored_pairs(asked, rows, digits=2, over=0.9)
    assert {(r.query, r.candidate) for r in found.collect()} == {(0, 3), (0, 4)}


def test_metrics_by_labels_are_those_by_pairs(spark):
    labels = spark.createDataFrame([(i, None if i == 7 else i % 3) for i in range(20)] + [(30, 9)], "id long, label int")
    ranked = spark.createDataFrame([(q, c, n + 1) for q in (0, 5, 7, 30) for n, c in enumerate(c for c in range(12) if c != q)], "query long, candidate long, rank int")
    both = labels.withColumnsRenamed({"id": "query"}).join(labels.withColumnRenamed("id", "candidate"), "label").where("query <> candidate and query in (0, 5, 7, 30)")
    by = [rank.label_metrics(ranked, labels), rank.rank_metrics(ranked, both)]
    found, want = (sorted(map(tuple, m.select("query", "k", "precision", "recall", "ndcg").collect())) for m in by)
    assert len(found) == 6 and all(f == pytest.approx(w) for f, w in zip(found, want, strict=True))


@pytest.mark.parametrize("whole", [0, 1000])
def test_similar_pairs_of_many_classes_and_of_all(spark, monkeypatch, whole):
    monkeypatch.setattr(similarity, "WHOLE", whole)
    monkeypatch.setattr(similarity, "BLOCK", 60)
    rows = clustered(5, n=240) + [(900 + i, np.ones(12)) for i in range(40)] + [(950, np.zeros(12)), (951, None)]
    found = similarity.similar_pairs(vectors(spark, rows), 0.75, recall=0.9999).collect()
    want = plain_pairs(rows, 0.75)
    assert sorted((r.a, r.b) for r in found) == sorted(want) and all(abs(r.score - want[r.a, r.b]) < 1e-9 for r in found)


def test_pairs_of_little_similarity_are_all_found(spark):
    rng = np.random.default_rng(4)
    rows = [(i, x) for i, x in enumerate(rng.standard_normal((300, 32)))]
    want = plain_pairs(rows, 0.45)
    assert 20 < len(want) and {(r.a, r.b) for r in similarity.similar_pairs(vectors(spark, rows), 0.45, recall=0.5).collect()} == set(want)
