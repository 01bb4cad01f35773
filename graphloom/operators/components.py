"""Connected components by contraction in a random order of each round (Boegeholz, Brand and Todor, ICDE 2020), as joins and
aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.scratch import scratch


def _contracted(e: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
    """Each node of the edges (a, b) with the first of itself and its neighbours in the round's order: node, rep; and the
    edges among those."""
    both = e.select("a", "b").union(e.select("b", "a"))
    rank = lambda c: F.struct(F.xxhash64(F.lit(number), c).alias("h"), F.col(c).alias("rep"))
    least = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
    reps = scratch(least.select(F.col("a").alias("node"), F.least("m", rank("a")).alias("m")).select("node", "m.rep"))
    ends = e.join(reps.select(F.col("node").alias("a"), F.col("rep").alias("x")), "a").join(reps.select(F.col("node").alias("b"), F.col("rep").alias("y")), "b")
    return reps, scratch(ends.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())


def connected_components(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Each node of the undirected edges with the smallest node it can reach: node, component.

    Edges with a null end are ignored; a self-loop makes its node appear alone. No group of neighbours is ever gathered: a
    hub is a minimum (combined before the shuffle) and a join that Spark can split. In each round every node goes over to
    the first of its neighbourhood in a new random order, which leaves a part of the nodes, three quarters at most on
    average, and the edges among them; so all rounds together read and write a few times the edges.
    """
    given = edges.select(F.col(source).alias("a"), F.col(target).alias("b")).dropna()
    e = scratch(given.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    loops, e, rounds = e.where("a = b").select(F.col("a").alias("node")), e.where("a <> b"), []
    while not e.isEmpty():
        reps, e = _contracted(e, len(rounds))
        rounds.append(reps)
    if not rounds:
        return loops.select("node", F.col("node").alias("component"))
    # From the last round back: where a node's representative ends.
    found = rounds.pop()
    while rounds:
        end = found.select(F.col("node").alias("rep"), F.col("rep").alias("end"))
        found = scratch(rounds.pop().join(end, "rep", "left").select("node", F.coalesce("end", "rep").alias("rep")))
    least = found.groupBy("rep").agg(F.min("node").alias("component"))
    named = found.join(least, "rep").select("node", "component")
    alone = loops.join(named.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return named.union(alone)
