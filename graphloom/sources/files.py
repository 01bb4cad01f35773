"""Files of a graph: node and edge tables, JSON records, walks, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDGE = T.StructType([T.StructField("source", T.StringType()), T.StructField("target", T.StringType())])


def node_schema(*columns: str) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in ("id", *columns)])


def read_nodes(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """A node table in CSV with a header. No schema is inferred. Cells that are a single quote mark are emptied; other
    quotes in ids stay, as edges have them too. An empty cell is null."""
    rows = spark.read.schema(node_schema(*columns)).option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return rows.withColumn("id", F.when(F.col("id") == '"', "").otherwise(F.col("id")))


def read_edges(spark: SparkSession, path: str, rel: str | None = None) -> DataFrame:
    rows = spark.read.schema(EDGE).option("header", True).csv(path)
    return rows.withColumn("rel", F.lit(rel)) if rel else rows


def read_edge_folder(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """The edge tables of a catalog {relation: path} as one table with column rel."""
    tables = [read_edges(spark, path, rel) for rel, path in sorted(paths.items())]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def write_table(df: DataFrame, path: str, kind: str = "csv") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.format(kind).save(path)


def flatten(df: DataFrame) -> DataFrame:
    """Structs flattened, to any depth, into columns named a.b."""

    def leaves(schema: T.StructType, path: list[str]):
        for f in schema.fields:
            at = [*path, f.name]
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, at)
            else:
                yield F.col(".".join(f"`{p}`" for p in at)).alias(".".join(at))

    return df.select(*leaves(df.schema, []))


def read_json_records(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A JSON file of records (a byte-order mark is allowed) as a flat table."""
    reader = spark.read.option("multiLine", True)
    return flatten((reader.schema(schema) if schema else reader).json(path))


def write_walks(walks: DataFrame, path: str) -> None:
    """One walk per line, ids separated by blanks."""
    walks.select(F.concat_ws(" ", "path").alias("value")).write.mode("overwrite").text(path)


def read_walks(spark: SparkSession, path: str) -> DataFrame:
    steps = F.split("value", " ")
    return spark.read.text(path).where("value <> ''").select(steps[0].alias("seed"), steps.alias("path"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Vectors in the word2vec text format: id, then numbers; the first line (count and width) is left out: it
    has two whole numbers (of vectors of width 1, ids that are numbers can't be told from it)."""
    parts = F.split("value", " ")
    rows = spark.read.text(path).select(parts.alias("p")).where((F.size("p") > 2) | ((F.size("p") == 2) & ~F.col("p")[0].rlike(r"^\d+$")))
    return rows.select(F.col("p")[0].alias("id"), F.transform(F.slice("p", 2, F.size("p") - 1), lambda x: x.cast("float")).alias("x"))


def write_vectors(vectors: DataFrame, path: str) -> None:
    """id and x (array of float), in Parquet."""
    vectors.select("id", "x").write.mode("overwrite").parquet(path)


def read_vector_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("id", "x")


def write_json_map(rows: DataFrame, key: str, value: str, path: str) -> None:
    """A table as JSON objects, one a line: {"key": ..., "value": ...}. The value may be an array."""
    rows.select(F.to_json(F.struct(F.col(key).alias("key"), F.col(value).alias("value"))).alias("value")).write.mode("overwrite").text(path)


def read_json_map(spark: SparkSession, path: str, value: str = "string") -> DataFrame:
    """key and value (of the given type) of what write_json_map has written."""
    parsed = F.from_json("value", f"key string, value {value}")
    return spark.read.text(path).select(parsed.alias("m")).select("m.key", "m.value")


def read_json_object(spark: SparkSession, path: str, value: str = "string") -> DataFrame:
    """A JSON file that is one object {key: value}, as such a table; for mappings of a size that fits one row."""
    whole = spark.read.option("wholetext", True).text(path).select(F.regexp_replace("value", "^\ufeff", "").alias("value"))
    return whole.select(F.explode(F.from_json("value", f"map<string, {value}>")).alias("key", "value"))
