"""A graph as one table: edges partitioned by relation and bucketed by source, so that a relation is read alone and
relations meet by source without a shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.scratch import scratch_root


def write_graph(edges: DataFrame, name: str | None = None, path: str | None = None, buckets: int | None = None) -> str:
    """Writes edges (source, target, rel) as a table and returns its name. Rows are dealt by source before, so there is
    one file for each relation and bucket. path: a folder that driver and executors share; the shared scratch folder by
    default."""
    spark = edges.sparkSession
    name = name or f"graph_{uuid.uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = edges.select("source", "target", "rel").repartition(buckets, "source")
    rows.write.partitionBy("rel").bucketBy(buckets, "source").sortBy("source").option("path", path or f"{scratch_root(spark)}/{name}").format("parquet").mode("overwrite").saveAsTable(name)
    return name


def relation(spark: SparkSession, name: str, rel: str) -> DataFrame:
    """One relation of a stored graph: source, target. Only its folder is read."""
    return spark.table(name).where(F.col("rel") == rel).select("source", "target")


def two_relations(spark: SparkSession, name: str, first: str, second: str) -> DataFrame:
    """Edges of two relations with the same source: source, first, second. The buckets meet where they are."""
    a = relation(spark, name, first).withColumnRenamed("target", "first")
    return a.join(relation(spark, name, second).withColumnRenamed("target", "second").hint("merge"), "source")
