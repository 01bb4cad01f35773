"""Operators on tables small enough to check by hand."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions.columns import normalize_text
from graphloom.operators import graph, rank, walks
from graphloom.operators.components import connected_components


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "source string, target string")


def test_degrees_of_the_simple_graph(spark):
    found = graph.degrees(edges(spark, ("a", "b"), ("b", "a"), ("a", "b"), ("c", "c")))
    assert {r.id: r.degree for r in found.collect()} == {"a": 1, "b": 1, "c": 2}


def test_only_nodes_over_the_percentile_go(spark):
    counts = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 10)], "id string, degree long")
    assert [r.id for r in graph.over_percentile(counts, "degree", 0.95).collect()] == ["d"]


def test_texts_are_normalised(spark):
    rows = spark.createDataFrame([(1, None), (2, "A b-1 c"), (3, "")], "id int, text string")
    found = rows.select("id", normalize_text(F.col("text")).alias("x")).orderBy("id").collect()
    assert [r.x for r in found] == ["nan", "a b c", ""]


def test_area_and_average_precision(spark):
    scored = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.1, 0)], "score double, label int")
    assert rank.auc(scored).first().auc == pytest.approx(0.75)
    assert rank.average_precision(scored).first().ap == pytest.approx(0.8333, abs=1e-4)


def test_rank_metrics(spark):
    ranked = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3)], "query long, candidate long, rank int")
    truth = spark.createDataFrame([(1, 1), (1, 9)], "query long, candidate long")
    found = rank.mean_metrics(rank.rank_metrics(ranked, truth, (3,))).first()
    assert (found.precision, found.recall, found.ndcg) == pytest.approx((1 / 3, 1 / 2, 0.613147), abs=1e-6)


def test_walk_steps_leave_out_repeats(spark):
    walk = spark.createDataFrame([("p_s", 0, ["p_s", "d_x", "p_s", "a_y", "d_x"])], "seed string, walk int, path array<string>")
    found = {r.node: (r.distance, r.penalty, r.grp) for r in walks.walk_steps(walk).collect()}
    assert found == {"d_x": (1, 1.0, "core"), "a_y": (2, 0.5, "top")}


def test_restart_walks_follow_edges(spark):
    given = [("p_1", "d_1"), ("p_1", "d_2"), ("p_2", "d_2"), ("p_2", "a_1"), ("p_3", "a_1")]
    seeds = spark.createDataFrame([("p_1", 1), ("p_3", 3), ("p_9", 9)], "seed string, number long")
    found = walks.random_walks(seeds, edges(spark, *given), walks=40, length=6).collect()
    known = {frozenset(e) for e in given}
    assert len(found) == 120
    for r in found:
        assert len(r.path) == 6 and r.path[0] == r.seed
        for a, b in zip(r.path, r.path[1:], strict=False):
            assert b == r.seed or frozenset((a, b)) in known or (a == b == "p_9")
    assert len({tuple(r.path) for r in found if r.seed == "p_1"}) > 10


def test_restart_walks_weigh_far_nodes(spark):
    """From p_1 by way of d_1: back has weight 1, p_2 (a neighbour of p_1) 1, p_3 10/3."""
    given = [("p_1", "d_1"), ("p_2", "d_1"), ("p_3", "d_1"), ("p_1", "p_2")]
    seeds = spark.createDataFrame([("p_1", 1)], "seed string, number long")
    found = walks.random_walks(seeds, edges(spark, *given), walks=4000, length=3, restart=0.0).where("path[1] = 'd_1'")
    share = {r.x: r.n for r in found.groupBy(F.col("path")[2].alias("x")).agg(F.count("*").alias("n")).collect()}
    total = sum(share.values())
    assert share["p_3"] / total == pytest.approx(0.625, abs=0.04)
    assert share["p_1"] / total == pytest.approx(0.1875, abs=0.04)


def test_components_of_a_chain_a_hub_and_nulls(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)]
    hub = [("z", f"z{i}") for i in range(50)]
    found = connected_components(edges(spark, *chain, *hub, ("q", "q"), (None, "a")))
    of = {r.node: r.component for r in found.collect()}
    assert {of[f"n{i:03}"] for i in range(61)} == {"n000"} and of["z7"] == "z" and of["q"] == "q" and "a" not in of


def test_empty_edges(spark):
    none = spark.createDataFrame([], "source string, target string")
    assert graph.degrees(none).count() == 0 and connected_components(none).count() == 0


def test_component_without_the_prefix_is_dropped(spark):
    alone = spark.createDataFrame([("p_5",), ("d_5",)], "id string")
    found = {r.id for r in graph.components_without(edges(spark, ("p_1", "d_1"), ("p_2", "a_2")), "d_", alone).collect()}
    assert {"p_2", "a_2", "p_5"} <= found and not found & {"p_1", "d_1", "d_5"}
