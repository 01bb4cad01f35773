"""Entity and topic nodes for a graph of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.columns import singular
from graphloom.operators.clean import frequency_band
from graphloom.operators.encode import dense_numbers
from graphloom.plans.scratch import scratch


def _gram(n: int):
    return lambda i: F.concat_ws(" ", F.slice("w", i, F.lit(n)))


def _holds(text: str):
    return lambda w: F.contains(F.lower(w), F.lit(text))


def link_mentions(docs: DataFrame, gazetteer: DataFrame, max_words: int = 3) -> DataFrame:
    """Mentions of gazetteer names (name in lower case, key) in documents (id, content): id, mention, key. All
    n-grams of up to max_words words are joined; a name in many documents is a split join, not a group."""
    w = docs.select("id", F.split(F.lower("content"), " ").alias("w"))
    grams = None
    for n in range(1, max_words + 1):
        starts = F.sequence(F.lit(1), F.size("w") - (n - 1))
        g = w.where(F.size("w") >= n).select("id", F.explode(F.transform(starts, _gram(n))).alias("mention"))
        grams = g if grams is None else grams.union(g)
    return grams.join(gazetteer.select(F.col("name").alias("mention"), "key"), "mention").select("id", "mention", "key")


def annotate(docs: DataFrame, annotator: Callable, schema: str) -> DataFrame:
    """Mentions by an external annotator: a function from an iterator of pandas frames to such an iterator."""
    return docs.mapInPandas(annotator, schema)


def entity_nodes(mentions: DataFrame, q: float = 0.95) -> DataFrame:
    """Entities mentioned more than once and no more than the percentile of counts, numbered in order of their
    first mention (pos): id, key."""
    band = frequency_band(mentions, "key", q)
    first = mentions.join(band.select("key"), "key", "left_semi").groupBy("key").agg(F.min("pos").alias("pos"))
    return dense_numbers(first, ["pos", "key"]).select(F.concat(F.lit("dbpedia_"), F.col("idx").cast("string")).alias("id"), "key")


def entity_edges(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Distinct (document, entity) edges."""
    return mentions.join(entities.withColumnRenamed("id", "target"), "key").select(F.col("doc").alias("source"), "target").distinct()


def coverage(edges: DataFrame) -> DataFrame:
    """Targets per source and sources per target: max, min, median."""
    out = None
    for what, end in (("per_document", "source"), ("per_entity", "target")):
        row = edges.groupBy(end).count().agg(F.lit(what).alias("what"), F.max("count").alias("max"), F.min("count").alias("min"), F.median("count").alias("median"))
        out = row if out is None else out.unionByName(row)
    return out


def allowed_topics(topics: DataFrame, banned: tuple[str, ...] = ("publication", "author")) -> DataFrame:
    """Topics (topic, words) other than -1 of which no word contains a banned string."""
    bad = F.lit(False)
    for b in banned:
        bad = bad | F.exists("words", _holds(b))
    return topics.where((F.col("topic") != -1) & ~bad)


def reduced_words(topics: DataFrame) -> DataFrame:
    """Words of each topic in the singular, repeats left out."""
    return topics.withColumn("words", F.array_distinct(F.transform("words", singular)))


def topic_nodes(topics: DataFrame) -> DataFrame:
    """One node a topic: id, description (its words)."""
    return topics.select(F.concat(F.lit("t_"), F.col("topic").cast("string")).alias("id"), F.concat_ws(" ,", "words").alias("description"))


def topic_word_nodes(topics: DataFrame) -> DataFrame:
    """One node a word over all topics, named by the place of its first use: id, description, pos."""
    words = topics.select("topic", F.posexplode("words").alias("i", "word"))
    numbered = dense_numbers(words, ["topic", "i"], "pos")
    return numbered.groupBy("word").agg(F.min("pos").alias("pos")).select(F.concat(F.lit("tk_"), F.col("pos").cast("string")).alias("id"), F.col("word").alias("description"), "pos")


def topic_edges(doc_topics: DataFrame, topics: DataFrame) -> DataFrame:
    """(doc, topic) as edges to topic nodes."""
    return doc_topics.join(topics.select("topic"), "topic", "left_semi").select(F.col("doc").alias("source"), F.concat(F.lit("t_"), F.col("topic").cast("string")).alias("target")).distinct()


def topic_word_edges(doc_topics: DataFrame, topics: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges from documents to the words of their topic."""
    words = topics.select("topic", F.explode("words").alias("description")).join(nodes.select("id", "description"), "description")
    return doc_topics.join(words, "topic").select(F.col("doc").alias("source"), F.col("id").alias("target"), F.col("topic").alias("topic_id")).distinct()


def two_hop(attributes: DataFrame, doc_topics: DataFrame, outer: bool = False) -> DataFrame:
    """attribute-document and document-topic edges composed: (source attribute, target topic). outer keeps
    unmatched rows with a null end."""
    a = attributes.select(F.col("source").alias("doc"), F.col("target").alias("attribute"))
    t = doc_topics.select(F.col("source").alias("doc"), F.col("target").alias("topic"))
    return a.join(t, "doc", "full" if outer else "inner").select(F.col("attribute").alias("source"), F.col("topic").alias("target")).distinct()


def topic_report(doc_topics: DataFrame) -> DataFrame:
    """Documents with and without a topic, by type: (doc, topic; -1: none)."""
    has = F.col("topic") != -1
    kind = F.substring("doc", 1, 1)
    return doc_topics.groupBy(kind.alias("kind")).agg(F.count(F.when(has, 1)).alias("with_topic"), F.count(F.when(~has, 1)).alias("without"), F.countDistinct(F.when(has, F.col("topic"))).alias("topics"))


def topic_sizes(doc_topics: DataFrame, k: int = 5) -> DataFrame:
    """The k largest and k smallest topics."""
    sizes = doc_topics.where("topic <> -1").groupBy("topic").agg(F.count("*").alias("n"))
    top = sizes.orderBy(F.desc("n"), "topic").limit(k).withColumn("end", F.lit("top"))
    return top.union(sizes.orderBy("n", "topic").limit(k).withColumn("end", F.lit("bottom")))


def class_tf_idf(doc_topics: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """The k words of each topic with the largest class-based tf-idf, tf * log(1 + mean words a topic / uses of
    the word): topic, word, score, rank."""
    words = docs.select("doc", F.explode(F.split("content", " ")).alias("word")).where("word <> ''").join(doc_topics.where("topic <> -1"), "doc")
    tf = words.groupBy("topic", "word").agg(F.count("*").alias("tf"))
    uses = tf.groupBy("word").agg(F.sum("tf").alias("uses"))
    mean = tf.groupBy("topic").agg(F.sum("tf").alias("n")).agg(F.avg("n").alias("mean"))
    scored = tf.join(uses, "word").crossJoin(F.broadcast(mean)).withColumn("score", F.round(F.col("tf") * F.log(1 + F.col("mean") / F.col("uses")), 9))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("score"), "word"))).where(F.col("rank") <= k).select("topic", "word", "score", "rank")


def cluster_topics(vectors: DataFrame, k: int, width: int = 5, seed: int = 1) -> DataFrame:
    """Topics of documents (doc, x) by the vectors' principal components and k-means: doc, topic. Stands in for a
    density clustering of a non-linear embedding; every document has a topic."""
    rows = scratch(vectors.select("doc", "x")).withColumn("v", array_to_vector("x"))
    reduced = PCA(k=width, inputCol="v", outputCol="features").fit(rows).transform(rows)
    found = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="topic").fit(reduced).transform(reduced)
    return found.select("doc", F.col("topic").cast("long").alias("topic"))


def with_word_pairs(docs: DataFrame, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """(doc, content) without the stop words, with each two neighbouring words, joined by _, after them."""
    w = F.filter(F.split("content", " "), lambda x: ~x.isin(*stop_words) if stop_words else F.lit(True))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws("_", F.slice("w", i, F.lit(2))))
    pairs = F.when(F.size("w") > 1, pairs).otherwise(F.array().cast("array<string>"))
    return docs.withColumn("w", w).withColumn("content", F.concat_ws(" ", F.concat("w", pairs))).drop("w")
