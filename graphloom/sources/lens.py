"""The test tables seen as a scholarly graph.

publication: order; dataset: part; author: supplier; organization: customer; venue: nation; keyword: brand
or priority. SQL has the same views for an engine that has the tables registered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _id(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


class Lens:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _edges(self, table: DataFrame, source: Column, target: Column) -> DataFrame:
        return table.select(source.alias("source"), target.alias("target"))

    def pd(self) -> DataFrame:
        return self._edges(self.table("lineitem"), _id("p_", "l_orderkey"), _id("d_", "l_partkey")).distinct()

    def pa(self) -> DataFrame:
        return self._edges(self.table("lineitem"), _id("p_", "l_orderkey"), _id("a_", "l_suppkey")).distinct()

    def da(self) -> DataFrame:
        return self._edges(self.table("lineitem"), _id("d_", "l_partkey"), _id("a_", "l_suppkey")).distinct()

    def po(self) -> DataFrame:
        return self._edges(self.table("orders"), _id("p_", "o_orderkey"), _id("o_", "o_custkey"))

    def pv(self) -> DataFrame:
        rows = self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        return self._edges(rows, _id("p_", "o_orderkey"), _id("v_", "c_nationkey"))

    def pk(self) -> DataFrame:
        return self._edges(self.table("orders"), _id("p_", "o_orderkey"), _id("k_", "o_orderpriority"))

    def dk(self) -> DataFrame:
        return self._edges(self.table("part"), _id("d_", "p_partkey"), _id("k_", "p_brand"))

    def pp(self) -> DataFrame:
        """Each order of a customer cites the customer's next one."""
        later = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
        rows = self.table("orders").withColumn("next", later).where("next IS NOT NULL")
        return self._edges(rows, _id("p_", "o_orderkey"), _id("p_", "next"))

    def dd(self) -> DataFrame:
        """Each part cites the next part of its brand."""
        later = F.lead("p_partkey").over(Window.partitionBy("p_brand").orderBy("p_partkey"))
        rows = self.table("part").withColumn("next", later).where("next IS NOT NULL")
        return self._edges(rows, _id("d_", "p_partkey"), _id("d_", "next"))

    def edges(self, *rels: str) -> DataFrame:
        """The named relations (all by default) as one table with rel."""
        out = None
        for rel in rels or RELATIONS:
            t = getattr(self, rel)().withColumn("rel", F.lit(rel))
            out = t if out is None else out.unionByName(t)
        return out

    def publications(self) -> DataFrame:
        return self.table("orders").select(_id("p_", "o_orderkey").alias("id"))

    def datasets(self) -> DataFrame:
        return self.table("part").select(_id("d_", "p_partkey").alias("id"))

    def vectors(self) -> DataFrame:
        return self.table("embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"), "label")


RELATIONS = ("pd", "pa", "da", "po", "pv", "pk", "dk", "pp", "dd")

SQL = {
    "pd": "SELECT DISTINCT 'p_' || l_orderkey AS source, 'd_' || l_partkey AS target FROM lineitem",
    "pa": "SELECT DISTINCT 'p_' || l_orderkey AS source, 'a_' || l_suppkey AS target FROM lineitem",
    "da": "SELECT DISTINCT 'd_' || l_partkey AS source, 'a_' || l_suppkey AS target FROM lineitem",
    "po": "SELECT 'p_' || o_orderkey AS source, 'o_' || o_custkey AS target FROM orders",
    "pv": "SELECT 'p_' || o_orderkey AS source, 'v_' || c_nationkey AS target FROM orders JOIN customer ON o_custkey = c_custkey",
    "pk": "SELECT 'p_' || o_orderkey AS source, 'k_' || o_orderpriority AS target FROM orders",
    "dk": "SELECT 'd_' || p_partkey AS source, 'k_' || p_brand AS target FROM part",
    "pp": "SELECT 'p_' || o_orderkey AS source, 'p_' || next AS target FROM (SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next FROM orders) WHERE next IS NOT NULL",
    "dd": "SELECT 'd_' || p_partkey AS source, 'd_' || next AS target FROM (SELECT p_partkey, lead(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS next FROM part) WHERE next IS NOT NULL",
}


def views(*rels: str, edges: bool = False) -> str:
    """WITH clauses for the named relations, and for edges (source, target, rel) over them if asked for."""
    parts = [f"{r} AS ({SQL[r]})" for r in rels]
    if edges:
        parts.append("edges AS (" + " UNION ALL ".join(f"SELECT source, target, '{r}' AS rel FROM {r}" for r in rels) + ")")
    return "WITH " + ", ".join(parts)
