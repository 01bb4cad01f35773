"""Density clustering of vectors after Campello, Moulavi and Sander (2013), on levels of distance.

Neighbours are found by comparing all points in blocks; of more than similarity.WHOLE they come from the similarity join.
Blocks return each point's nearest ones, and then, of all pairs, counts of their weights and a least spanning forest, which has
the components of all pairs at any level; so what is written grows with points and blocks, not with pairs. Two points are joined at a level if both are dense there and near enough
(their mutual reachability is at most the level's distance); components of a level are contracted before the next
one, so that each works on what the finer ones left. Components of the smallest cluster size or more form a tree,
from which the clusters of the largest stability are taken. Points in none of them are outliers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators.components import connected_components
from graphloom.operators.encode import dense_numbers
from graphloom.operators import pairs as numpy_pairs, similarity
from graphloom.operators.similarity import similar_pairs, vector_blocks, vector_classes
from graphloom.plans.scratch import scratch

LEVELS = 12
#: Weights are counted by this part; pairs of a block that are reduced to a forest at once.
COUNTED, AT_ONCE = 1e-5, 1 << 21


def _cores(near: DataFrame, neighbors: int) -> DataFrame:
    """(id, core) from rows (id, other, d, many: how many copies other stands for)."""
    order = Window.partitionBy("id").orderBy("d", "other")
    # Each row counts at least one copy, so the nearest rows are enough.
    first = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= neighbors)
    seen = first.withColumn("seen", F.sum("many").over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("seen") >= neighbors)
    return seen.groupBy("id").agg(F.min("d").alias("core"))


def reachability(pairs: DataFrame, weights: DataFrame, neighbors: int) -> DataFrame:
    """Edges (a, b, w) of pairs (a, b, d): w is the largest of d and both ends' core distances. A point (id, weight: how
    many copies it stands for) has the distance of its neighbors-th nearest copy, itself not counted, as its core
    distance; without so many neighbours it has none, and no edge."""
    both = pairs.select("a", "b", "d").union(pairs.select("b", "a", "d")).toDF("id", "other", "d")
    own = weights.where("weight > 1").select("id", F.col("id").alias("other"), F.lit(0.0).alias("d"), (F.col("weight") - 1).alias("many"))
    near = both.join(weights.select(F.col("id").alias("other"), F.col("weight").alias("many")), "other").select("id", "other", "d", "many").unionByName(own)
    core = scratch(_cores(near, neighbors))
    ends = pairs.join(core.select(F.col("id").alias("a"), F.col("core").alias("ca")), "a").join(core.select(F.col("id").alias("b"), F.col("core").alias("cb")), "b")
    return ends.select("a", "b", F.greatest("d", "ca", "cb").alias("w"))


def spanning_forest(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """Which of the edges between n points make a forest of least weight (Boruvka)."""
    order = np.argsort(w, kind="stable")
    a, b, edge, taken = u[order].astype(np.int64), v[order].astype(np.int64), np.arange(len(order)), []
    while len(edge):
        least = np.full(n, len(order), np.int64)
        # The last of equal places stands, so that of the smallest weight does.
        least[a[::-1]] = edge[::-1]
        other = np.full(n, len(order), np.int64)
        other[b[::-1]] = edge[::-1]
        least = np.minimum(least, other)
        own = np.flatnonzero(least < len(order))
        at = np.searchsorted(edge, least[own])
        to = np.arange(n)
        to[own] = np.where(a[at] == own, b[at], a[at])
        taken.append(edge[at])
        # Of two that chose each other, the smaller is the root.
        to = np.where((to[to] == np.arange(n)) & (np.arange(n) < to), np.arange(n), to)
        while (to[to] != to).any():
            to = to[to]
        a, b = to[a], to[b]
        apart = a != b
        a, b, edge = a[apart], b[apart], edge[apart]
    return order[np.unique(np.concatenate(taken))] if taken else np.zeros(0, np.int64)


def block_nearest(points: DataFrame, neighbors: int, floor: float) -> DataFrame:
    """For each two blocks of points (id, x, weight) the nearest of each point in the other one, as many as neighbors at
    most, with a cosine over floor: id, other, d, many."""
    kind = points.schema["id"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table, same: bool) -> pa.Table:
        a, b = numpy_pairs.both(left, right)
        out = []
        for mine, its, x, y in ((left, right, a, b), (right, left, b, a))[: 1 if same else 2]:
            i, j, score = numpy_pairs.best(x, y, min(neighbors + 1, len(y)), numpy_pairs.codes(its.column("id"), its.column("id"))[0])
            if same:  # both tables have the rows in their own order
                codes = numpy_pairs.codes(mine.column("id"), its.column("id"))
                apart = codes[0][i] != codes[1][j]
                i, j, score = i[apart], j[apart], score[apart]
            with np.errstate(invalid="ignore"):
                near = score > floor
            i, j, score = i[near], j[near], score[near]
            out.append(pa.table([mine.column("id").take(pa.array(i)), its.column("id").take(pa.array(j)), pa.array(1 - score), its.column("weight").take(pa.array(j))], names=["id", "other", "d", "many"]))
        return pa.concat_tables(out)

    return vector_blocks(points, run, f"id {kind}, other {kind}, d double, many bigint")


def block_forests(points: DataFrame, floor: float) -> DataFrame:
    """Of all pairs of points (id, x, core) with a cosine over floor, weighted as in reachability, a forest of least weight in
    each two blocks (a, b, w), and how many have about the same weight, of which w is the largest (a and b null, w, n)."""
    kind = points.schema["id"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table, same: bool) -> pa.Table:
        order = numpy_pairs.codes(left.column("id"), right.column("id"))
        cores = [t.column("core").to_numpy() for t in (left, right)]
        counts, most = np.zeros(0, np.int64), np.zeros(0)
        forest, waiting, held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), [], 0
        places = np.unique(np.concatenate(order), return_inverse=True)[1]
        mine, its = places[: len(left)], places[len(left) :]

        def reduced():
            u, v, w = (np.concatenate(p) for p in zip(forest, *waiting, strict=True))
            keep = spanning_forest(mine[u], its[v], w, len(places))
            return u[keep], v[keep], w[keep]

        for i, j, score in numpy_pairs.over(*numpy_pairs.both(left, right), floor):
            once = order[0][i] < order[1][j] if same else slice(None)
            i, j, w = i[once], j[once], 1 - score[once]
            w = np.maximum(w, np.maximum(cores[0][i], cores[1][j]))
            if not len(w):
                continue
            bins = np.maximum(w / COUNTED, 0).astype(np.int64)
            if bins.max() >= len(counts):
                more = int(bins.max()) + 1 - len(counts)
                counts, most = np.append(counts, np.zeros(more, np.int64)), np.append(most, np.zeros(more))
            counts += np.bincount(bins, minlength=len(counts))
            by = np.argsort(w)
            bins, ordered = bins[by], w[by]
            last = np.flatnonzero(np.diff(bins, append=-1))
            most[bins[last]] = np.maximum(most[bins[last]], ordered[last])
            waiting.append((i, j, w))
            held += len(w)
            if held > AT_ONCE:
                forest, waiting, held = reduced(), [], 0
        u, v, w = reduced() if waiting else forest
        at = np.flatnonzero(counts)
        ids = pa.nulls(len(at), left.column("id").type)
        ends = [pa.concat_arrays([*pa.chunked_array(t.column("id").take(pa.array(p))).chunks, ids]) for t, p in ((left, u), (right, v))]
        return pa.table([*ends, pa.array(np.append(w, most[at])), pa.concat_arrays([pa.nulls(len(w), pa.int64()), pa.array(counts[at])])], names=["a", "b", "w", "n"])

    return vector_blocks(points, run, f"a {kind}, b {kind}, w double, n bigint")


def counted_cuts(counts: DataFrame, levels: int = LEVELS) -> list[float]:
    """level_cuts of counted weights (w, n)."""
    found = counts.groupBy(F.floor(F.col("w") / COUNTED).alias("bin")).agg(F.max("w").alias("w"), F.sum("n").alias("n")).orderBy("bin").toArrow()  # 2 / COUNTED rows at most
    run, w = np.cumsum(found.column("n").to_numpy()), found.column("w").to_numpy()
    if not len(run):
        return []
    at = [int(np.searchsorted(run, np.ceil(run[-1] * (i + 1) / levels))) for i in range(levels)]
    return sorted({float(w[min(i, len(w) - 1)]) for i in at if w[min(i, len(w) - 1)] > 0})


def level_cuts(edges: DataFrame, levels: int = LEVELS) -> list[float]:
    """Distances, increasing, that split the edges' weights (w) into parts of equal size."""
    found = edges.agg(F.percentile_approx("w", [(i + 1) / levels for i in range(levels)], 10_000).alias("cuts")).first().cuts
    return sorted({c for c in found or [] if c > 0})


def component_levels(edges: DataFrame, cuts: list[float]) -> list[DataFrame]:
    """For each cut, from fine to coarse, the components of the finer level (at first: points) with those they
    belong to: part, whole. Points and components without an edge at a level are left out: they are their own."""
    out, left = [], edges.select("a", "b", "w")
    for cut in cuts:
        found = scratch(connected_components(left.where(F.col("w") <= cut), "a", "b").select(F.col("node").alias("part"), F.col("component").alias("whole")))
        out.append(found)
        a, b = found.select(F.col("part").alias("a"), F.col("whole").alias("wa")), found.select(F.col("part").alias("b"), F.col("whole").alias("wb"))
        ends = left.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("wa", "a").alias("x"), F.coalesce("wb", "b").alias("y"), "w").where("x <> y")
        left = scratch(ends.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min("w").alias("w")))
    return out


def _moved(rows: DataFrame, key: str, level: DataFrame) -> DataFrame:
    """Rows with the component of the level in place of the finer one in key."""
    found = rows.join(level.withColumnsRenamed({"part": key, "whole": "__whole"}), key, "left")
    return found.withColumn(key, F.coalesce("__whole", key)).drop("__whole")


def density_clusters(edges: DataFrame, weights: DataFrame, smallest: int, cuts: list[float]) -> DataFrame:
    """Clusters of points (id, weight) by edges (a, b, w), on levels given by cuts: id, cluster (its smallest id, null
    for outliers), level (the coarsest at which the cluster stands alone).

    A cluster is a component of at least smallest copies. Going from coarse to fine, one that splits into several
    clusters ends and each of these begins; with one it goes on. Its stability is the sum over its finer levels of
    its size times the growth of 1 / distance. A cluster is taken if it is at least as stable as the clusters taken
    below it; points that leave it at finer levels stay in it.
    """
    merged = component_levels(edges, cuts)
    sizes, at = [], weights.select("id", F.col("id").alias("comp"), F.col("weight").cast("long").alias("weight"))
    rows = at.select("comp", F.col("weight").alias("size"))
    for level in merged:
        rows = scratch(_moved(rows, "comp", level).groupBy("comp").agg(F.sum("size").alias("size")))
        sizes.append(rows)
    spark = edges.sparkSession
    top = len(cuts) - 1
    alive = None  # comp, cluster, born, at the level in hand
    tree = None  # cluster, born, parent
    gains = None
    for l in range(top, -1, -1):
        big = sizes[l].where(F.col("size") >= smallest)
        if alive is None:
            now = big.select("comp", "size", F.col("comp").alias("cluster"), F.lit(l).alias("born"), F.lit(None).cast(weights.schema["id"].dataType).alias("parent"), F.lit(None).cast("int").alias("parent_born"))
            new = now
        else:
            up = _moved(big.select("comp", "size", F.col("comp").alias("above")), "above", merged[l + 1])
            both = up.join(alive.select(F.col("comp").alias("above"), "cluster", "born"), "above")
            many = both.groupBy("above").agg(F.count("*").alias("many"))
            both = scratch(both.join(many, "above"))
            goes_on = both.where("many = 1").select("comp", "size", "cluster", "born")
            new = both.where("many > 1").select("comp", "size", F.col("comp").alias("cluster"), F.lit(l).alias("born"), F.col("cluster").alias("parent"), F.col("born").alias("parent_born"))
            now = goes_on.unionByName(new.select("comp", "size", "cluster", "born"))
            growth = 1 / cuts[l] - 1 / cuts[l + 1]
            gain = goes_on.select("cluster", "born", (F.col("size") * growth).alias("gain"))
            gains = gain if gains is None else gains.unionByName(gain)
        alive = scratch(now.select("comp", "cluster", "born"))
        born = new.select("cluster", "born", "parent", "parent_born")
        tree = born if tree is None else tree.unionByName(born)
    if tree is None:
        return weights.select("id", F.lit(None).cast(weights.schema["id"].dataType).alias("cluster"), F.lit(None).cast("int").alias("level"))
    stable = tree if gains is None else tree.join(gains.groupBy("cluster", "born").agg(F.sum("gain").alias("stability")), ["cluster", "born"], "left")
    stable = scratch(stable.select("cluster", "born", "parent", "parent_born", F.coalesce("stability" if gains is not None else F.lit(0.0), F.lit(0.0)).alias("stability")))
    # From fine to coarse: what is best at or below each cluster.
    best = None
    for l in range(0, top + 1):
        mine = stable.where(F.col("born") == l)
        if best is not None:
            below = best.groupBy(F.col("parent").alias("cluster"), F.col("parent_born").alias("born")).agg(F.sum("best").alias("below"))
            mine = mine.join(below, ["cluster", "born"], "left")
        else:
            mine = mine.withColumn("below", F.lit(None).cast("double"))
        takes = F.col("below").isNull() | (F.round("stability", 9) >= F.round("below", 9))
        mine = mine.select("cluster", "born", "parent", "parent_born", takes.alias("takes"), F.when(takes, F.col("stability")).otherwise(F.col("below")).alias("best"))
        best = scratch(mine if best is None else best.unionByName(mine))
    # From coarse to fine: the first taken on each way down, carried to the points.
    open_, taken = None, None  # components with a cluster label at the level in hand
    passed = best.where("parent IS NULL").select("cluster", "born")
    for l in range(top, -1, -1):
        here = best.where(F.col("born") == l).join(passed.where(F.col("born") == l), ["cluster", "born"], "left_semi")
        got = here.where("takes").select(F.col("cluster").alias("comp"), "cluster", F.lit(l).alias("level"))
        more = best.join(here.where("NOT takes").select(F.col("cluster").alias("parent"), F.col("born").alias("parent_born")), ["parent", "parent_born"], "left_semi").select("cluster", "born")
        passed = scratch(passed.where(F.col("born") < l).unionByName(more))
        open_ = got if open_ is None else open_.unionByName(got)
        parts = merged[l].select("part", F.col("whole").alias("comp"))
        open_ = scratch(open_.join(parts, "comp", "left").select(F.coalesce("part", "comp").alias("comp"), "cluster", "level"))
    return weights.select("id").join(open_.withColumnRenamed("comp", "id"), "id", "left").select("id", "cluster", "level")


def _compared(classes: DataFrame, weights: DataFrame, neighbors: int, floor: float, levels: int) -> tuple[DataFrame, list[float]]:
    """Edges that have the components of all pairs at each level, and the levels' cuts, by comparing all points (id, rep, x)."""
    x = F.transform("x", lambda v: v.cast("double"))
    rows = classes.where("id = rep").dropDuplicates(["rep"]).select("rep", x.alias("x")).where(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v) > 0)
    points = scratch(rows.withColumnRenamed("rep", "id").join(weights, "id").select("id", "x", "weight"))
    own = points.where("weight > 1").select("id", F.col("id").alias("other"), F.lit(0.0).alias("d"), (F.col("weight") - 1).alias("many"))
    core = _cores(block_nearest(points, neighbors, floor).unionByName(own), neighbors)
    found = scratch(block_forests(scratch(points.join(core, "id").select("id", "x", "core")), floor))
    return found.where("n IS NULL").select("a", "b", "w"), counted_cuts(found.where("n IS NOT NULL").select("w", "n"), levels)


def density_topics(vectors: DataFrame, smallest: int = 15, neighbors: int = 5, floor: float = 0.5, recall: float = 0.99, levels: int = LEVELS) -> DataFrame:
    """Topics of documents (id, x) by density: id, topic (from 0 in the order of the clusters' smallest ids; -1 for
    outliers). Distances are 1 - cosine, and pairs of a cosine up to floor are no neighbours. Copies of a vector
    weigh as many points and share a topic; zero and null vectors are outliers."""
    classes = scratch(vector_classes(vectors))
    weights = scratch(classes.groupBy(F.col("rep").alias("id")).agg(F.count("*").alias("weight")))
    if weights.count() <= similarity.WHOLE:
        edges, cuts = _compared(classes, weights, neighbors, floor, levels)
    else:
        pairs = scratch(similar_pairs(vectors, floor, recall).select("a", "b", (1 - F.col("score")).alias("d")))
        edges = scratch(reachability(pairs, weights, neighbors))
        cuts = level_cuts(edges, levels)
    found = density_clusters(edges, weights, smallest, cuts)
    names = dense_numbers(found.select("cluster").dropna().distinct(), ["cluster"], "topic")
    labeled = found.join(names, "cluster", "left").select(F.col("id").alias("rep"), "topic")
    rows = vectors.select("id").join(classes.select("id", "rep"), "id", "left").join(labeled, "rep", "left")
    return rows.select("id", F.coalesce("topic", F.lit(-1)).cast("long").alias("topic"))
