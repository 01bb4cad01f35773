"""Typed graphs: nodes and edges of all types with numbers, message-passing views and labelled views.

Edges are (source, target, rel); rel is the pair of letters of the types at its ends, as in the lens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.columns import node_type
from graphloom.operators.encode import dense_numbers
from graphloom.operators.graph import degrees, largest_component, within_nodes, without_nodes
from graphloom.plans.scratch import scratch


def typed_nodes(nodes: DataFrame) -> DataFrame:
    """(id, order): a number from 0 for each distinct id within its type, in the given order: id, ntype, idx. Numbers
    are those of one dense numbering, less the smallest of the type."""
    rows = nodes.groupBy("id").agg(F.min("order").alias("order")).withColumn("ntype", node_type(F.col("id")))
    numbered = scratch(dense_numbers(rows, ["ntype", "order", "id"], "n"))
    first = numbered.groupBy("ntype").agg(F.min("n").alias("first"))  # a row for each type
    return numbered.join(F.broadcast(first), "ntype").select("id", "ntype", (F.col("n") - F.col("first")).alias("idx"))


def typed_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges turned from the publication's side, without repeats, as numbers: rel, src, dst. nodes: id, idx."""
    turn = F.col("source").startswith("d_") & F.col("target").startswith("p_")
    turned = edges.select(F.when(turn, F.col("target")).otherwise(F.col("source")).alias("source"), F.when(turn, F.col("source")).otherwise(F.col("target")).alias("target"), "rel").distinct()
    s, t = nodes.select(F.col("id").alias("source"), F.col("idx").alias("src")), nodes.select(F.col("id").alias("target"), F.col("idx").alias("dst"))
    return turned.join(s, "source").join(t, "target").select("rel", "src", "dst")


def replace_edges(edges: DataFrame, rel: str, given: DataFrame) -> DataFrame:
    """The edges of one relation go, and the given ones (source, target) come in their place."""
    return edges.where(F.col("rel") != rel).unionByName(given.select("source", "target", F.lit(rel).alias("rel")))


def message_graph(edges: DataFrame, parts: DataFrame, setup: str, rel: str = "pd") -> DataFrame:
    """The edges that messages pass in a setup. parts: source, target, split of the labelled relation, whose train
    edges alone are used.

    train: nodes of inductive and semi-inductive test edges are removed; trans: they are detached (the same edges,
    their nodes stay); light: only those of inductive test edges are; full: nothing is.
    """
    passed = replace_edges(edges, rel, parts.where("split = 'train'"))
    sources, targets = {"train": (("test_ind", "test_semi"), ("test_ind",)), "trans": (("test_ind", "test_semi"), ("test_ind",)), "light": (("test_ind",), ("test_ind",)), "full": ((), ())}[setup]
    gone = parts.where(F.col("split").isin(*sources)).select(F.col("source").alias("id")).union(parts.where(F.col("split").isin(*targets)).select(F.col("target").alias("id"))).distinct()
    return without_nodes(passed, gone)


def message_nodes(nodes: DataFrame, parts: DataFrame, setup: str) -> DataFrame:
    """The nodes (id) of a setup's message graph, with detached: whether their edges are gone while they stay. In the
    setups train and light the nodes of held-out edges are removed, in trans they stay without edges."""
    sources, targets = {"train": (("test_ind", "test_semi"), ("test_ind",)), "trans": (("test_ind", "test_semi"), ("test_ind",)), "light": (("test_ind",), ("test_ind",)), "full": ((), ())}[setup]
    gone = parts.where(F.col("split").isin(*sources)).select(F.col("source").alias("id")).union(parts.where(F.col("split").isin(*targets)).select(F.col("target").alias("id"))).distinct()
    if setup != "trans":
        return nodes.select("id").join(gone, "id", "left_anti").withColumn("detached", F.lit(False))
    return nodes.select("id").join(gone.withColumn("out", F.lit(True)), "id", "left").select("id", F.coalesce("out", F.lit(False)).alias("detached"))


def holdout_graphs(edges: DataFrame, parts: DataFrame, rel: str = "pd") -> DataFrame:
    """Graphs for training, validation and testing on unknown nodes: stage, setup, source, target, rel.

    parts: the labelled relation's edges by split (train, validation, test). The validation graph has the validation edges
    put back, the test graph all. Nodes of edges that a stage must not know are removed: their sources (setup light),
    or both ends (full). Of what is left the largest component's nodes stay, with all edges among them.
    """
    part = lambda *splits: parts.where(F.col("split").isin(*splits)).select("source", "target")
    out = None
    for stage, known, unknown in (("train", ("train",), ("validation", "test")), ("validation", ("train", "validation"), ("test",)), ("test", ("train", "validation", "test"), ())):
        graph = scratch(replace_edges(edges, rel, part(*known)))
        for setup in ("light", "full"):
            if stage != "test" or setup == "light":  # no node is unknown in testing
                hidden = part(*unknown) if unknown else parts.select("source", "target").limit(0)
                gone = hidden.select(F.col("source").alias("id"))
                gone = gone if setup == "light" else gone.union(hidden.select(F.col("target").alias("id")))
                nodes = scratch(largest_component(without_nodes(graph, gone.distinct()).select("source", "target")).select(F.col("node").alias("id")))
            rows = within_nodes(edges, nodes, nodes).select(F.lit(stage).alias("stage"), F.lit(setup).alias("setup"), "source", "target", "rel")
            out = rows if out is None else out.unionByName(rows)
    return out


def excluded_ends(edges: DataFrame, publications: DataFrame, datasets: DataFrame) -> DataFrame:
    """Edges without those that touch an excluded publication or dataset (id). Of a relation between publications and
    datasets both ends are looked at, of the others the source."""
    p, d = (x.select("id").distinct() for x in (publications, datasets))
    gone = p.union(d)
    kept = edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti")
    return kept.join(gone.withColumnRenamed("id", "target"), "target", "left_anti").select(*edges.columns)


def inductive_edges(edges: DataFrame, held: DataFrame, light: bool) -> DataFrame:
    """Train edges of all relations when the held edges' publications, and unless light their datasets, are unknown."""
    p = held.select(F.col("source").alias("id"))
    d = held.select(F.col("target").alias("id"))
    return excluded_ends(edges, p, d.limit(0) if light else d)


def labeled_view(parts: DataFrame, negatives: DataFrame) -> DataFrame:
    """Positive edges (source, target, split) and negatives (the same) as one labelled table."""
    return parts.select("source", "target", "split", F.lit(1).alias("label")).unionByName(negatives.select("source", "target", "split", F.lit(0).alias("label")))


def inductive_labels(labeled: DataFrame, train: DataFrame, order: list[str]) -> DataFrame:
    """The labelled edges of an inductive view: test edges have a source that no train edge has, and of each split
    there are as many positives as negatives, the first in the order."""
    known = train.select("source").distinct()
    seen = labeled.where("split = 'train'").join(known, "source", "left_semi")
    unseen = labeled.where("split <> 'train'").join(known, "source", "left_anti")
    rows = scratch(seen.unionByName(unseen.select(*seen.columns)).select(*labeled.columns))
    sizes = rows.groupBy("split").agg(F.least(F.count(F.when(F.col("label") == 1, 1)), F.count(F.when(F.col("label") == 0, 1))).alias("n"))
    numbered = scratch(dense_numbers(rows, ["split", "label", *order], "at"))
    first = numbered.groupBy("split", "label").agg(F.min("at").alias("first"))  # a row for each split and label
    return numbered.join(F.broadcast(first), ["split", "label"]).join(F.broadcast(sizes), "split").where(F.col("at") - F.col("first") < F.col("n")).select(*labeled.columns)


def joined_vectors(text: DataFrame, net: DataFrame, width: int) -> DataFrame:
    """(id, x) with the structural vector of the same id appended, zeros where there is none."""
    rows = text.join(net.select("id", F.col("x").alias("net")), "id", "left")
    return rows.select("id", F.concat("x", F.coalesce("net", F.array_repeat(F.lit(0.0), width))).alias("x"))


def without_isolated(nodes: DataFrame, edges: DataFrame, rels: tuple[str, ...] = ("pp", "pd", "dd")) -> DataFrame:
    """Edges of all relations whose ends, if publications or datasets, have an edge of one of rels. nodes: the
    publications and datasets (id)."""
    ends = edges.where(F.col("rel").isin(*rels)).select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return without_nodes(edges, nodes.select("id").join(ends, "id", "left_anti"))


def what_if(groups: list[tuple[str, DataFrame, int]]) -> DataFrame:
    """For each named group of edges and degree limit, before and after nodes over the limit go: nodes, edges, and
    the largest and median degree."""
    out = None
    for name, edges, limit in groups:
        over = degrees(edges).where(F.col("degree") > limit).select("id")
        for stage, left in (("before", edges), ("after", without_nodes(edges, over))):
            d = degrees(left).agg(F.count("*").alias("nodes"), (F.coalesce(F.sum("degree"), F.lit(0)) / 2).cast("long").alias("edges"), F.max("degree").alias("max_degree"), F.median("degree").alias("median_degree"))
            row = d.select(F.lit(name).alias("name"), F.lit(stage).alias("stage"), "*")
            out = row if out is None else out.unionByName(row)
    return out


def regrouped_walks(parts: list[DataFrame], seeds: DataFrame) -> DataFrame:
    """Walks (seed, path) of several runs by their first node, for the wanted seeds: seed, walk (from 0), path."""
    rows = parts[0].select("path")
    for part in parts[1:]:
        rows = rows.union(part.select("path"))
    rows = rows.withColumn("seed", F.col("path")[0]).join(seeds.select("seed").distinct(), "seed", "left_semi")
    return rows.select("seed", (F.row_number().over(Window.partitionBy("seed").orderBy("path")) - 1).alias("walk"), "path")


def recurrent_words(topics: DataFrame) -> DataFrame:
    """Over the words of all topics: how many there are, how many distinct ones stand more than once, and the most
    frequent one (ties: the first by name) with its count."""
    counts = topics.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    first = F.min(F.struct((-F.col("n")).alias("n"), "word")).alias("top")
    return counts.agg(F.count("*").alias("words"), F.count(F.when(F.col("n") > 1, 1)).alias("recurrent"), first).select("words", "recurrent", F.col("top.word").alias("word"), (-F.col("top.n")).alias("n"))


def median_topics(sizes: DataFrame) -> DataFrame:
    """The median of topic sizes (topic, n), and the topics of that size or next to it."""
    middle = sizes.agg(F.median("n").alias("median"))  # one row
    near = sizes.crossJoin(F.broadcast(middle)).withColumn("off", F.abs(F.col("n") - F.col("median")))
    least = near.agg(F.min("off").alias("least"))
    return near.crossJoin(F.broadcast(least)).where("off = least").select("topic", "n", "median")


def truth_lists(pairs: DataFrame, sep: Column | None = None) -> DataFrame:
    """For each query the sorted list of its distinct candidates."""
    return pairs.groupBy("query").agg(F.array_sort(F.collect_set("candidate")).alias("truth"))
