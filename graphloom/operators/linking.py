"""Entity mentions without overlaps: of all places where a name stands, the leftmost, and of those the longest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_names(gazetteer: DataFrame, least: float) -> DataFrame:
    """(name, key, confidence) with one key a name: the most confident one that reaches least (ties: the smaller key)."""
    good = gazetteer.where(F.col("confidence") >= least).dropna(subset=["name", "key"])
    return good.groupBy("name").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "key")).alias("b")).select("name", "b.key", (-F.col("b.c")).alias("confidence"))


def mention_places(docs: DataFrame, gazetteer: DataFrame, least: float = 0.0, max_words: int = 3) -> DataFrame:
    """All places of names in documents (id, content: words with a blank between): id, start (word, from 0), stop (the word
    after), mention, key. Names are in lower case, words are compared so."""
    w = docs.select("id", F.split(F.lower("content"), " ").alias("w"))
    sizes = F.explode(F.sequence(F.lit(1), F.least(F.lit(max_words), F.size("w") - F.col("start")).cast("int")))
    starts = w.select("id", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("start")).select("id", "w", "start", sizes.alias("n"))
    runs = starts.select("id", "start", (F.col("start") + F.col("n")).alias("stop"), F.array_join(F.slice("w", F.col("start") + 1, F.col("n")), " ").alias("mention"))
    return runs.join(best_names(gazetteer, least).select(F.col("name").alias("mention"), "key"), "mention").select("id", "start", "stop", "mention", "key")


def _chosen(batches):
    for batch in batches:
        places, keep = batch.column("places"), []
        offsets = places.offsets.to_numpy()
        flat = places.flatten()
        start, stop = (flat.field(i).to_numpy() for i in (0, 1))
        for low, high in zip(offsets[:-1] - offsets[0], offsets[1:] - offsets[0], strict=True):
            end = 0
            for i, (s, e) in enumerate(zip(start[low:high].tolist(), stop[low:high].tolist(), strict=True), int(low)):
                if s >= end:
                    keep.append(i)
                    end = e
        at = np.array(keep, np.int64)
        doc = np.searchsorted(offsets - offsets[0], at, side="right") - 1
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(doc)), pa.array(start[at]), pa.array(stop[at])], names=["id", "start", "stop"])


def leftmost_longest(places: DataFrame) -> DataFrame:
    """Of (id, start, stop, ...) those that a reader takes from left to right, the longest at each start, without
    overlaps. A document's starts are gathered, which are fewer than its words."""
    longest = places.groupBy("id", "start").agg(F.max("stop").alias("stop"))
    lists = longest.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("places"))
    kind = places.schema["id"].dataType.simpleString()
    return places.join(lists.mapInArrow(_chosen, f"id {kind}, start int, stop int"), ["id", "start", "stop"]).select(*places.columns)


def linked(docs: DataFrame, gazetteer: DataFrame, least: float = 0.0, max_words: int = 3) -> DataFrame:
    """Mentions without overlaps: id, start, stop, mention, key. gazetteer: (name, key, confidence)."""
    return leftmost_longest(mention_places(docs, gazetteer, least, max_words))
