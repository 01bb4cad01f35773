"""Graph layers with given weights: attention over neighbours, normalised convolution, and an inner-product decoder.

The softmax over a node's edges is two aggregates, a maximum and a sum, so a hub is combined in the tasks before anything
is shuffled. Where nodes have numbers of vectors in place of vectors, edges carry those numbers, and the sums are made in
blocks of nodes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.columns import dot, leaky_relu, sigmoid
from graphloom.operators import blocks
from graphloom.plans.scratch import scratch


def _fixed(row: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in row])


def linear(features: DataFrame, weights: list[list[float]]) -> DataFrame:
    """(id, x) times a matrix, given as one row for each input: id, x."""
    columns = [list(c) for c in zip(*weights, strict=True)]
    return features.select("id", F.array(*[dot(F.col("x"), _fixed(c)) for c in columns]).alias("x"))


def with_self_loops(edges: DataFrame, features: DataFrame) -> DataFrame:
    """Both directions of the edges (source, target) among nodes with features, once each, and each node with itself:
    id, other."""
    both = edges.select(F.col("source").alias("id"), F.col("target").alias("other")).union(edges.select("target", "source"))
    nodes = features.select("id")
    both = both.where("id <> other").join(nodes, "id", "left_semi").join(nodes.withColumnRenamed("id", "other"), "other", "left_semi")
    return both.select("id", "other").union(nodes.select("id", F.col("id").alias("other"))).distinct()


def _sum(rows: DataFrame) -> DataFrame:
    """Sums of vectors times weights (id, weight, x): id, x. Each task adds up whole vectors first."""
    scaled = rows.select("id", array_to_vector(F.transform("x", lambda v: v * F.col("weight"))).alias("v"))
    return scaled.groupBy("id").agg(vector_to_array(Summarizer.sum(F.col("v"))).alias("x"))


def attention_weights(edges: DataFrame, hidden: DataFrame, to: list[float], other: list[float], slope: float = 0.2) -> DataFrame:
    """The softmax over each node's neighbours, itself among them, of a leaky rectifier of to * h + other * h of the
    neighbour: id, other, weight. hidden: (id, x)."""
    scores = scratch(hidden.select("id", dot(F.col("x"), _fixed(to)).alias("s"), dot(F.col("x"), _fixed(other)).alias("t")))
    pairs = with_self_loops(edges, hidden).join(scores.select("id", "s"), "id").join(scores.select(F.col("id").alias("other"), "t"), "other")
    pairs = scratch(pairs.select("id", "other", leaky_relu(F.col("s") + F.col("t"), slope).alias("e")))
    top = pairs.groupBy("id").agg(F.max("e").alias("top"))
    raised = pairs.join(top, "id").select("id", "other", F.exp(F.col("e") - F.col("top")).alias("w"))
    total = raised.groupBy("id").agg(F.sum("w").alias("total"))
    return raised.join(total, "id").select("id", "other", (F.col("w") / F.col("total")).alias("weight"))


def attention_layer(edges: DataFrame, features: DataFrame, heads: list[tuple[list[list[float]], list[float], list[float]]], slope: float = 0.2) -> DataFrame:
    """One round of attention (Velickovic et al. 2018) with given heads (matrix, to, other), their results one after the
    other: id, x. Nodes are those with features (id, x)."""
    out = None
    for i, (matrix, to, other) in enumerate(heads):
        hidden = scratch(linear(features, matrix))
        weights = attention_weights(edges, hidden, to, other, slope)
        part = _sum(weights.join(hidden.withColumnRenamed("id", "other"), "other")).withColumnRenamed("x", f"x{i}")
        out = part if out is None else out.join(part, "id")
    return out.select("id", F.concat(*[f"x{i}" for i in range(len(heads))]).alias("x"))


def numbered_pairs(edges: DataFrame, features: DataFrame) -> DataFrame:
    """The pairs of with_self_loops for nodes that have numbers of vectors, features (id, vec): id, other, own (the node's
    number), vec (the other's). Each edge is shuffled once for each end."""
    both = edges.select(F.col("source").alias("id"), F.col("target").alias("other")).union(edges.select("target", "source")).where("id <> other")
    both = both.union(features.select("id", F.col("id").alias("other")))
    known = both.join(features.select("id", F.col("vec").alias("own")), "id").join(features.select(F.col("id").alias("other"), "vec"), "other")
    return known.dropDuplicates(["other", "id"]).select("id", "other", "own", "vec")


def _attended(heads: int, outputs: int, slope: float):
    """For a block: each key's largest score, sum of raised scores and sum of weighted vectors, head by head."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        number, x = blocks._vectors(right)
        (at, known), (own, _) = (blocks._places(left.column(c), number) for c in ("vec", "own"))
        left, at, own = left.filter(pa.array(known)), at[known], own[known]
        order, starts = blocks.by_key(left.column("key"))
        at, own = at[order], own[order]
        size = np.diff(np.append(starts, len(at)))
        top, total, sums = [], [], []
        for h in range(heads):
            e = x[own, heads * outputs + 2 * h] + x[at, heads * outputs + 2 * h + 1]
            e = np.where(e > 0, e, slope * e)
            top.append(np.maximum.reduceat(e, starts))
            w = np.exp(e - np.repeat(top[-1], size))
            total.append(np.add.reduceat(w, starts))
            sums.append(blocks.summed(at, w, starts, x[:, h * outputs : (h + 1) * outputs]))
        every = np.ones(len(starts), bool)
        lists = [blocks._lists(v, every) for v in (np.stack(top, 1), np.stack(total, 1), np.concatenate(sums, 1))]
        return pa.table([left.column("key").take(pa.array(order[starts])), *lists], names=["key", "top", "total", "sum"])

    return run


def _added(outputs: int):
    """The parts of one key as one row."""

    def run(rows: pa.Table) -> pa.Table:
        top, total, sums = (np.array(rows.column(c).to_pylist()) for c in ("top", "total", "sum"))
        raised = np.exp(top - top.max(axis=0))
        every = np.ones(1, bool)
        lists = [blocks._lists(v[None], every) for v in (top.max(axis=0), (total * raised).sum(axis=0), (sums * np.repeat(raised, outputs, axis=1)).sum(axis=0))]
        return pa.table([rows.column("key").slice(0, 1), *lists], names=["key", "top", "total", "sum"])

    return run


def numbered_attention_layer(edges: DataFrame, features: DataFrame, table: DataFrame, heads: list[tuple[list[list[float]], list[float], list[float]]], slope: float = 0.2) -> DataFrame:
    """attention_layer of nodes that have numbers of vectors, features (id, vec), and the vectors (vec, x): id, x. All heads
    are taken in one pass over the edges, which carry numbers alone."""
    outputs, rows = len(heads[0][1]), table.select(F.col("vec").alias("id"), "x")
    hidden = rows.select("id", *[F.array(*[dot(F.col("x"), _fixed(list(c))) for c in zip(*m, strict=True)]).alias(f"h{i}") for i, (m, _, _) in enumerate(heads)])
    scores = [F.array(dot(F.col(f"h{i}"), _fixed(to)), dot(F.col(f"h{i}"), _fixed(other))) for i, (_, to, other) in enumerate(heads)]
    hidden = scratch(hidden.select(F.col("id").cast("long").alias("vec"), F.concat(*[f"h{i}" for i in range(len(heads))], *scores).alias("x")))
    pairs = scratch(numbered_pairs(edges, features).select(F.col("id").alias("key"), F.col("own").cast("long").alias("own"), F.col("vec").cast("long").alias("vec")))
    schema = f"key {pairs.schema['key'].dataType.simpleString()}, top array<double>, total array<double>, sum array<double>"
    found, hot = blocks.in_blocks(pairs, hidden, _attended(len(heads), outputs, slope), schema)
    if hot is not None:
        hot = F.broadcast(hot.select("key"))
        found = found.join(hot, "key", "left_anti").unionByName(found.join(hot, "key", "left_semi").groupBy("key").applyInArrow(_added(outputs), schema))
    return found.select(F.col("key").alias("id"), F.transform("sum", lambda v, i: v / F.get("total", F.floor(i / outputs).cast("int"))).alias("x"))


def numbered_convolution_layer(edges: DataFrame, features: DataFrame, table: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """convolution_layer of nodes that have numbers of vectors, features (id, vec), and the vectors (vec, x): id, x. A
    node's own degree is the number of its rows, so that an edge carries only the other's."""
    pairs = scratch(numbered_pairs(edges, features).select("id", "other", "vec"))
    degree = pairs.groupBy("other").agg(F.count("*").alias("d"))
    rows = scratch(pairs.join(degree, "other").select(F.col("id").alias("key"), "vec", (1 / F.sqrt("d")).alias("weight")))
    hidden = scratch(linear(table.select(F.col("vec").alias("id"), "x"), matrix).withColumnRenamed("id", "vec"))
    sums = blocks.weighted_sums(rows, hidden).where("sum IS NOT NULL")
    return sums.select(F.col("key").alias("id"), F.transform("sum", lambda v: v / F.sqrt("rows")).alias("x"))


def convolution_layer(edges: DataFrame, features: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """One round of normalised convolution (Kipf and Welling 2016): neighbours, the node among them, weighted by
    1 / sqrt(their degree times the node's), degrees with the loop: id, x."""
    pairs = scratch(with_self_loops(edges, features))
    degree = scratch(pairs.groupBy("id").agg(F.count("*").alias("d")))
    weighted = pairs.join(degree, "id").join(degree.select(F.col("id").alias("other"), F.col("d").alias("e")), "other")
    weighted = weighted.select("id", "other", (1 / F.sqrt(F.col("d") * F.col("e"))).alias("weight"))
    return _sum(weighted.join(linear(features, matrix).withColumnRenamed("id", "other"), "other"))


def decode_pairs(pairs: DataFrame, means: DataFrame) -> DataFrame:
    """The probability of an edge between the ends of (source, target) by an inner-product decoder over their latent means
    (id, x): source, target, probability. Noise, used in training alone, is left out."""
    a, b = means.select(F.col("id").alias("source"), F.col("x").alias("sx")), means.select(F.col("id").alias("target"), F.col("x").alias("tx"))
    return pairs.join(a, "source").join(b, "target").select("source", "target", sigmoid(dot(F.col("sx"), F.col("tx"))).alias("probability"))


def kl_to_normal(means: DataFrame, log_deviations: DataFrame) -> DataFrame:
    """The mean divergence of the nodes' latent normals (means and log deviations, id, x each) from the standard one: kl,
    the second part of a variational autoencoder's loss."""
    rows = means.join(log_deviations.withColumnRenamed("x", "l"), "id")
    each = F.aggregate(F.zip_with("x", "l", lambda m, l: 1 + 2 * l - m * m - F.exp(2 * l)), F.lit(0.0), lambda s, v: s + v)
    return rows.agg((-0.5 * F.avg(each)).alias("kl"))
