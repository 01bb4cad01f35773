"""Cleaning of node tables: texts, duplicate titles, rare and frequent attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.columns import normalize_text, word_count


def with_content(nodes: DataFrame) -> DataFrame:
    """Normalised title and description, and content, the two with a blank between."""
    n = nodes.withColumns({"title": normalize_text(F.col("title")), "description": normalize_text(F.col("description"))})
    return n.withColumn("content", F.concat_ws(" ", "title", "description"))


def long_enough(nodes: DataFrame, min_words: int, banned: str = "occurrence download") -> DataFrame:
    """Rows whose content has more than min_words words and not the banned phrase."""
    return nodes.where((word_count(F.col("content")) > min_words) & ~F.contains(F.col("content"), F.lit(banned)))


def title_groups(nodes: DataFrame) -> DataFrame:
    """For each title its number of rows and its smallest id."""
    return nodes.groupBy("title").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def title_members(nodes: DataFrame) -> DataFrame:
    """For each title the sorted ids; meant for groups that a purge has left small."""
    return nodes.groupBy("title").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.count("*").alias("n"))


def purge_frequent_titles(nodes: DataFrame, q: float = 0.95) -> DataFrame:
    """Drops all rows of titles whose group is larger than the percentile of group sizes (one value a title)."""
    groups = title_groups(nodes)
    cut = groups.agg(F.percentile("n", F.lit(q)).alias("cut"))
    large = groups.crossJoin(F.broadcast(cut)).where("n > cut").select("title")
    return nodes.join(large, "title", "left_anti").select(*nodes.columns)


def attribute_report(nodes: DataFrame, q: float = 0.95) -> DataFrame:
    """How many titles have groups above the percentile, and how many not."""
    groups = title_groups(nodes)
    cut = groups.agg(F.percentile("n", F.lit(q)).alias("cut"))
    return groups.crossJoin(F.broadcast(cut)).agg(F.count(F.when(F.col("n") > F.col("cut"), 1)).alias("above"), F.count(F.when(F.col("n") <= F.col("cut"), 1)).alias("not_above"))


def frequency_band(uses: DataFrame, key: str, q: float = 0.95, closed: bool = True) -> DataFrame:
    """Keys used more than once and no more than (closed) or less than the percentile of counts: key, n."""
    counts = uses.groupBy(key).agg(F.count("*").alias("n"))
    cut = counts.agg(F.percentile("n", F.lit(q)).alias("cut"))
    below = F.col("n") <= F.col("cut") if closed else F.col("n") < F.col("cut")
    return counts.crossJoin(F.broadcast(cut)).where((F.col("n") > 1) & below).drop("cut")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, t in tables.items():
        row = t.agg(F.lit(name).alias("name"), F.count("*").alias("rows"))
        out = row if out is None else out.unionByName(row)
    return out
