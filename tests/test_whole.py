"""Queries do the whole of their work, and what they write on their way goes."""

from graphloom.queries_vectors import QUERIES

SF = "/root/testdata/sf0.001"


def test_classifier_has_a_negative_for_each_edge(spark):
    rows = QUERIES["q_link_classifier"](spark, SF).groupBy("label", "source").count().collect()
    many = {label: {r.source: r["count"] for r in rows if r.label == label} for label in (0, 1)}
    assert many[0] == many[1] and sum(many[1].values()) > len(many[1])


def test_walks_in_groups_keep_only_their_results(spark, monkeypatch):
    from graphloom.operators import walks
    from graphloom.plans import scratch

    whole = sorted(map(tuple, QUERIES["q_walk_select_full"](spark, SF).collect()))
    monkeypatch.setattr(walks, "STEPS", 20_000)
    before = scratch.made()
    found = QUERIES["q_walk_select_full"](spark, SF)
    results = scratch.made() - before - 2  # nodes and links stay
    assert results == 3 and sorted(map(tuple, found.collect())) == whole
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_selected_steps_are_shuffled_once(spark):
    from graphloom.operators import walks

    rows = [("s", w, f"d_{w}_{i}", g, 1.0, w / 10) for w in range(6) for i, g in enumerate(("core", "core", "key", "top"))]
    scored = spark.createDataFrame(rows, "seed string, walk int, node string, grp string, penalty double, score double")
    chosen = walks.selected_walks(scored, 4, 2, 1, least=1, most=5)
    assert chosen._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(map(tuple, chosen.collect())) == [("s", 4, 2, 2), ("s", 5, 1, 2)]
    # A quota that no number of walks meets takes most.
    assert walks.selected_walks(scored, 99, 1, 1, least=1, most=5).count() == 5


def test_scratch_leaves_no_shuffle_files(spark):
    import os

    from graphloom.plans import scratch

    def shuffled():
        root = spark._jvm.org.apache.spark.util.Utils.getLocalDir(spark._jsc.sc().conf())
        return sum(f.startswith("shuffle_") for top in os.scandir(os.path.dirname(root)) if top.is_dir() and top.name.startswith("blockmgr") for _, _, files in os.walk(top.path) for f in files)

    before = shuffled()
    assert scratch.scratch(spark.range(1000).repartition(7).groupBy("id").count()).count() == 1000
    scratch.bucketed(spark.range(1000).groupBy("id").count(), "id")
    assert shuffled() <= before + 2  # those of the count


def test_key_neighbors_come_from_walks_of_full_size(spark):
    found = QUERIES["q_key_neighbors"](spark, SF)
    assert found.where("rank = 3").count() > 0.9 * found.select("seed").distinct().count()


def test_losses_shuffle_no_vectors(spark, monkeypatch):
    from graphloom.operators import blocks

    monkeypatch.setattr(blocks, "ROWS", 1000)  # several blocks
    found = QUERIES["q_losses"](spark, SF)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and "FlatMapCoGroupsInArrow" in text and len(found.collect()) == 1


def test_least_similar_draws_are_made_in_blocks(spark, monkeypatch):
    import random

    from pyspark.sql import functions as F

    from graphloom.operators import complement

    rng = random.Random(8)
    edges = {(f"p{rng.randrange(40)}", f"d{rng.randrange(30)}") for _ in range(150)} | {("p0", f"d{i}") for i in range(30)} | {("p1", f"d{i}") for i in range(29)}
    edges = spark.createDataFrame(sorted(edges), "source string, target string")
    slots = spark.createDataFrame([(i, f"p{i % 45}", i % 7) for i in range(300)], "slot long, source string, vec long")
    targets = spark.createDataFrame([(i, f"d{i}") for i in range(30)], "idx long, target string")
    vectors = targets.select("target", (F.col("idx") % 8).alias("vec"))  # number 7 is missing, number 6 is zero
    table = spark.createDataFrame([(i, [rng.gauss(0, 1) * (i != 6) for _ in range(4)]) for i in range(7)], "vec long, x array<double>")
    wanted = sorted(map(tuple, complement._shuffled_draws(slots, targets, edges, vectors, 5, 3, table).collect()), key=str)

    def found():
        return sorted(map(tuple, complement.free_least_similar(slots, targets, edges, vectors, 5, 3, table).collect()), key=str)

    monkeypatch.setattr(complement, "free_draws", None)  # no draw is a row
    assert found() == wanted and len(wanted) < 300
    monkeypatch.setattr(complement, "SLOTS", 40)
    monkeypatch.setattr(complement, "AT_ONCE", 20)
    assert found() == wanted
    monkeypatch.undo()
    monkeypatch.setattr(complement, "KNOWN", 3)
    assert found() == wanted


def test_restart_walks_propose_once_first(spark):
    from pyspark.sql import functions as F

    from graphloom.operators import walks

    ring = [(f"p_{i}", f"p_{(i + 1) % 5}") for i in range(5)] + [(f"p_{i}", f"p_{(i + 2) % 5}") for i in range(5)]
    edges = spark.createDataFrame(ring, "source string, target string")  # all are neighbours of all, so a proposal is taken once in ten
    nodes, places = walks.numbered_edges(edges)
    known = edges.union(edges.select("target", "source")).toDF("prev", "next").distinct().withColumn("near", F.lit(True))
    front = spark.range(400).select(F.lit("p_0").alias("seed"), F.col("id").alias("walk"), F.lit(1).alias("step"), F.lit(0).alias("round"), F.lit("p_1").alias("prev"), F.lit("p_0").alias("cur"))
    left = walks._proposals(front, nodes, places, known, 8, 0.0, 1.0, 0.1, 0).where("got IS NULL").count()
    assert 320 < left < 400  # of eight proposals at once some 170 would be left


def test_factors_meet_values_in_blocks(spark, monkeypatch):
    from graphloom.operators import structural

    seen, times = [], structural._times

    def watched(matrix, factors):
        out = times(matrix, factors)
        seen.append(out._jdf.queryExecution().optimizedPlan().toString())
        return out

    monkeypatch.setattr(structural, "_times", watched)
    rows = [(a, b, float((i + j) % 3)) for i, a in enumerate("abcd") for j, b in enumerate("abcd")]
    found, values = structural.factorize(spark.createDataFrame(rows, "node string, context string, v double"), width=2, rounds=3, extra=1)
    assert seen and all("FlatMapCoGroupsInArrow" in plan and "Join" not in plan for plan in seen)
    want = sorted((abs(v) for v in __import__("numpy").linalg.eigvalsh([[float((i + j) % 3) for j in range(4)] for i in range(4)])), reverse=True)
    assert abs(abs(values[0]) - want[0]) < 1e-6 and {r.id for r in found.collect()} == set("abcd")
