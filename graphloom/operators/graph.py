"""Graph operators on edges (source, target): degrees, pruning, components, integrity."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.columns import node_type
from graphloom.operators.components import connected_components


def simple_edges(edges: DataFrame) -> DataFrame:
    """The undirected simple graph: parallel and reversed edges collapse (s <= t)."""
    return edges.select(F.least("source", "target").alias("s"), F.greatest("source", "target").alias("t")).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of each simple edge: node, neighbor. A self-loop is there once."""
    e = simple_edges(edges)
    return e.select(F.col("s").alias("node"), F.col("t").alias("neighbor")).union(e.where("s <> t").select("t", "s"))


def degrees(edges: DataFrame) -> DataFrame:
    """Degree of each node in the simple graph; a self-loop adds 2."""
    ends = simple_edges(edges).select(F.explode(F.array("s", "t")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


#: So many different values of a range are looked at together.
FEW_VALUES = 100_000


def exact_percentile(rows: DataFrame, column: str, q: float) -> float | None:
    """The percentile of a numeric column with linear interpolation, nulls left out; None without a value.

    The two values beside it are selected by rank: a range that is sure to be near is estimated, rows below and
    inside are counted, and the range that holds the ranks is searched again until it has few values. So no task sees
    more than a part of the values, whatever they are.
    """
    v = rows.select(F.col(column).cast("double").alias("v")).dropna()
    inside, below = v.count(), 0
    if not inside:
        return None
    place = (inside - 1) * q
    first, second = math.floor(place), math.ceil(place)
    while inside > FEW_VALUES:
        share = [max(0.0, min(1.0, (rank - below) / inside + e)) for rank, e in ((first, -1e-3), (second, 1e-3))]
        low, high = v.agg(F.percentile_approx("v", share, 10_000)).first()[0]
        r = v.agg(F.count(F.when(F.col("v") < low, 1)).alias("below"), F.count(F.when((F.col("v") >= low) & (F.col("v") <= high), 1)).alias("inside")).first()
        ends = (r.below, r.below + r.inside)  # ranks of the estimated range
        wanted = (first - below, second - below)
        if wanted[0] >= ends[0] and wanted[1] < ends[1]:
            if low == high:
                return low
            if r.inside == inside:  # nothing is left out, as one of the ends stands there very often: take that end off
                n = v.agg(F.count(F.when(F.col("v") == low, 1)).alias("low"), F.count(F.when(F.col("v") == high, 1)).alias("high")).first()
                at_low = n.low >= n.high
                end, many, rest = (low, n.low, v.where(F.col("v") > low)) if at_low else (high, n.high, v.where(F.col("v") < high))
                is_end = [rank - below < many if at_low else rank - below >= inside - many for rank in (first, second)]
                if any(is_end):
                    other = end if all(is_end) else rest.agg((F.min if at_low else F.max)("v")).first()[0]
                    low, high = (end, other) if is_end[0] else (other, end)
                    return low + (high - low) * (place - first)
                v, below, inside = rest, below + (many if at_low else 0), inside - many
                continue
            v, below, inside = v.where((F.col("v") >= low) & (F.col("v") <= high)), below + r.below, r.inside
        elif wanted[1] < ends[1]:
            v, inside = v.where(F.col("v") <= high), ends[1]
        else:
            v, below, inside = v.where(F.col("v") >= low), below + r.below, inside - r.below
    found = {}
    for value, count in sorted(map(tuple, v.groupBy("v").count().collect())):  # at most FEW_VALUES, or few by the estimate
        found |= {rank: value for rank in (first, second) if below <= rank < below + count}
        below += count
    return found[first] + (found[second] - found[first]) * (place - first)


def over_percentile(counts: DataFrame, column: str, q: float) -> DataFrame:
    """Rows whose value is over the exact percentile (linear interpolation) of the column."""
    cut = exact_percentile(counts, column, q)
    return counts.where(F.col(column) > F.lit(cut).cast("double"))


def prune_nodes(groups: list[tuple[DataFrame, str | None]], q: float = 0.95) -> DataFrame:
    """Nodes to remove: over the degree percentile of their group. A group is (edges, prefix); with a
    prefix, only degrees of ids with it count and only they go."""
    out = None
    for edges, prefix in groups:
        d = degrees(edges)
        d = d.where(F.col("id").startswith(prefix)) if prefix else d
        found = over_percentile(d, "degree", q).select("id")
        out = found if out is None else out.union(found)
    return out.distinct()


def prune_fixed(limits: list[tuple[DataFrame, int]]) -> DataFrame:
    """Nodes to remove: a degree over the limit in one of the edge tables."""
    out = None
    for edges, limit in limits:
        found = degrees(edges).where(F.col("degree") > limit).select("id")
        out = found if out is None else out.union(found)
    return out.distinct()


def without_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which neither end is among the nodes (id)."""
    return edges.join(nodes.select(F.col("id").alias("source")), "source", "left_anti").join(nodes.select(F.col("id").alias("target")), "target", "left_anti").select(*edges.columns)


def within_nodes(edges: DataFrame, sources: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Edges whose source is in sources and, if given, whose target is in targets."""
    kept = edges.join(sources.select(F.col("id").alias("source")), "source", "left_semi")
    if targets is not None:
        kept = kept.join(targets.select(F.col("id").alias("target")), "target", "left_semi")
    return kept.select(*edges.columns)


def component_sizes(edges: DataFrame) -> DataFrame:
    return connected_components(edges).groupBy("component").agg(F.count("*").alias("nodes"))


def largest_component(edges: DataFrame) -> DataFrame:
    """Nodes of the largest component; of equal ones, that with the smallest label."""
    members = connected_components(edges)
    sizes = members.groupBy("component").agg(F.count("*").alias("n"))
    best = sizes.orderBy(F.desc("n"), "component").limit(1).select("component")
    return members.join(F.broadcast(best), "component", "left_semi").select("node")


def components_without(edges: DataFrame, prefix: str = "d_", alone: DataFrame | None = None) -> DataFrame:
    """Nodes (id) of components that hold no id with the prefix. alone: nodes (id) without edges."""
    members = connected_components(edges)
    if alone is not None:
        single = alone.select(F.col("id").alias("node")).join(members.select("node"), "node", "left_anti")
        members = members.unionByName(single.select("node", F.col("node").alias("component")))
    good = members.where(F.col("node").startswith(prefix)).select("component").distinct()
    return members.join(good, "component", "left_anti").select(F.col("node").alias("id"))


def integrity(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each rel, how many edges there are and how many have an end that is no node."""
    known = nodes.select("id").distinct()
    marked = edges.join(known.select(F.col("id").alias("source"), F.lit(1).alias("s")), "source", "left").join(known.select(F.col("id").alias("target"), F.lit(1).alias("t")), "target", "left")
    return marked.groupBy("rel").agg(F.count("*").alias("edges"), F.count(F.when(F.col("s").isNull() | F.col("t").isNull(), 1)).alias("violations"))


def referenced(nodes: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Nodes that are the target of an edge from one of the sources."""
    used = within_nodes(edges, sources).select(F.col("target").alias("id")).distinct()
    return nodes.join(used, "id", "left_semi")


def degree_stats(edges: DataFrame) -> DataFrame:
    """For each rel and type of end: nodes, max, min and median degree."""
    both = edges.select("rel", F.explode(F.array("source", "target")).alias("id"))
    d = both.groupBy("rel", "id").agg(F.count("*").alias("degree")).withColumn("ntype", node_type(F.col("id")))
    return d.groupBy("rel", "ntype").agg(F.count("*").alias("nodes"), F.max("degree").alias("max_degree"), F.min("degree").alias("min_degree"), F.median("degree").alias("median_degree"))


def citation_core(citing: DataFrame, pp: DataFrame) -> DataFrame:
    """Edges among publications that cite a dataset."""
    core = citing.select(F.col("source").alias("id")).distinct()
    return within_nodes(pp, core, core)


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an edge."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return nodes.join(ends, "id", "left_anti")


def homogeneous_ids(nodes: DataFrame, order: list[str]) -> DataFrame:
    """One numbering over all types: (id, ntype, idx) with idx from 0 in each type becomes gid, offset by the
    sizes of the types before it in the order."""
    sizes = {r.ntype: r.n for r in nodes.groupBy("ntype").agg(F.count("*").alias("n")).collect()}  # a row for each type
    offset, at = F.lit(0).cast("long"), 0
    for kind in order:
        offset = F.when(F.col("ntype") == kind, F.lit(at).cast("long")).otherwise(offset)
        at += sizes.get(kind, 0)
    return nodes.withColumn("gid", F.col("idx") + offset)
