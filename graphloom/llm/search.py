"""Ranked lexical search over a tiered index.

The index has a row for each document: its postings, dealt to TIERS columns by what they can add to a score, the
most first; and a table of terms: how many documents hold each, and the largest impact (the part of a score that
frequency and length decide) in each tier. All postings of a term that few documents hold are in the first tier. Tiers
are columns of one Parquet table, so a scan reads those it asks for, and a document's postings meet without a shuffle.

A search goes over the first tier alone, and scores the k best documents found there in full; the least of these
scores is one that the answer reaches. What a document lacks in the tier is bounded by what each of the item's terms
has left in lower tiers. If a document outside the tier cannot reach that score, the answer is proven to be among the
documents whose bound does; these alone are completed from their lower tiers. Items without that proof fall
through to the next tier, at last to all postings, which need no proof.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import ALNUM, as_batch, by_bytes, give_back, large_text, sliced, split_words
from graphloom.plans.scratch import scratch

#: Terms are common if more than one document in COMMON holds them. Of their postings the share that the first tiers
#: hold together; the last tier holds the rest.
COMMON, TIER_SHARES = 256, (1 / 2, 7 / 8)
TIERS = len(TIER_SHARES) + 1

#: Item terms that a scan looks for at once; scores and rows that a task works on at once.
BLOCK_TERMS, CELLS, ROWS = 50_000, 1 << 17, 1024

#: Cuts between tiers lie at multiples. A common term's weight is below 6,300 and an impact below 1,000,000, whatever N is.
STEP = 10_000_000


@dataclass
class Index:
    """postings: row, doc_id, tier0, tier1, ...: arrays of (term, impact). terms: term, tier, docs, most (impact)."""

    postings: DataFrame
    terms: DataFrame
    documents: int


def _count(batches):
    kinds = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.string())), ("tfs", pa.list_(pa.int64()))])
    for whole in batches:
        for batch in by_bytes(whole):
            words = split_words(large_text(batch.column("text"), lower=True), ALNUM)
            if len(words):
                codes, distinct = words.encoded()
                held, tf = np.unique(words.doc_of_word() * np.int64(len(distinct)) + codes, return_counts=True)
                terms = distinct.cast(pa.large_string()).cast(pa.string()).take(pa.array(held % len(distinct)))
                offsets = np.searchsorted(held, np.arange(batch.num_rows + 1) * np.int64(len(distinct)))
            else:
                terms, tf, offsets = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(batch.num_rows + 1, np.int64)
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), v) for v in (terms, pa.array(tf, pa.int64()))]
            yield as_batch(kinds, batch.column("row"), batch.column("id"), words.counts, *lists)


def term_counts(table: DataFrame, key: str) -> DataFrame:
    """The terms of each row's text with how often they stand there: row (a number), id, n (words), terms, tfs."""
    rows = table.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_count, "row long, id long, n long, terms array<string>, tfs array<long>")


def term_weight(documents: int, holding: int) -> int:
    """What a term counts that so many of the documents hold."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def build_index(docs: DataFrame) -> Index:
    """An index of every row of docs (doc_id, text). Rows without a term are in no posting and not counted."""
    spark = docs.sparkSession
    forward = scratch(term_counts(docs, "doc_id").where("n > 0"))
    size = forward.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    single = forward.select("n", F.explode(F.arrays_zip("terms", "tfs")).alias("h")).select("n", F.col("h.terms").alias("term"), F.col("h.tfs").alias("tf"))
    # At most COMMON times as many as a document has distinct terms, on average.
    common = sorted(map(tuple, single.groupBy("term").count().where(F.col("count") * COMMON > size.documents).collect()))
    weights = {term: term_weight(size.documents, held) for term, held in common}
    weighed = single.join(F.broadcast(spark.createDataFrame(list(weights.items()), "term string, weight long")), "term")
    share = F.expr(f"weight * ((1000000000L * tf) div (1000L * tf + 12L * (75L + (25L * n * {size.documents}L) div {max(size.words, 1)}L)))")
    cuts = _cuts(weighed.groupBy(F.floor(share / STEP).alias("step")).count().collect())  # a row for each step
    postings = scratch(forward.mapInArrow(_deal(weights, cuts, size.documents, max(size.words, 1)), POSTINGS))
    tiers = None
    for t in range(TIERS):
        tier = postings.select(F.explode(f"tier{t}").alias("h")).groupBy("h.term").agg(F.count("*").alias("docs"), F.max("h.impact").alias("most")).withColumn("tier", F.lit(t))
        tiers = tier if tiers is None else tiers.unionByName(tier)
    return Index(postings, scratch(tiers), size.documents)


def _cuts(steps: list) -> list[int]:
    """From which value on the first tiers begin, by counts for each step."""
    above, total, cuts = 0, sum(r["count"] for r in steps), []
    for step, many in sorted(map(tuple, steps), reverse=True):
        above += many
        while len(cuts) < len(TIER_SHARES) and above >= TIER_SHARES[len(cuts)] * total:
            cuts.append(step * STEP)
    return cuts + [0] * (len(TIER_SHARES) - len(cuts))


POSTINGS = "row long, doc_id long, " + ", ".join(f"tier{t} array<struct<term:string,impact:long>>" for t in range(TIERS))


def _deal(weights: dict[str, int], cuts: list[int], documents: int, words: int):
    """Deals each row's postings to the tiers."""
    names, weight = list(weights), np.array(list(weights.values()), np.int64)
    posting = pa.struct([("term", pa.string()), ("impact", pa.int64())])
    kinds = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), *[(f"tier{t}", pa.list_(posting)) for t in range(TIERS)]])

    def run(batches):
        common = pa.array(names, pa.string())
        for batch in (b for whole in batches for b in sliced(whole, ROWS)):
            terms, tf = batch.column("terms"), batch.column("tfs").flatten().to_numpy()
            offsets = terms.offsets.to_numpy().astype(np.int64)
            offsets -= offsets[0]
            length = np.repeat(75 + 25 * batch.column("n").to_numpy() * documents // words, np.diff(offsets))
            impact = 1_000_000_000 * tf // (1000 * tf + 12 * length)
            flat = terms.flatten()
            place = pc.index_in(flat, value_set=common)
            rare = pc.is_null(place).to_numpy(zero_copy_only=False)
            value = np.append(weight, 0)[pc.fill_null(place, len(names)).to_numpy()] * impact
            tier = np.where(rare, 0, sum((value < c).astype(np.int64) for c in cuts))
            columns = []
            for t in range(TIERS):
                mine = np.flatnonzero(tier == t)
                held = pa.StructArray.from_arrays([flat.take(pa.array(mine)), pa.array(impact[mine])], fields=list(posting))
                columns.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(mine, offsets), pa.int32()), held))
            yield as_batch(kinds, batch.column("row"), batch.column("id"), *columns)

    return run


@dataclass
class Block:
    """Items to look for, as numbers. Term j stands in the items item[first[j]:first[j + 1]] with that weight; rest[t, j]
    is the largest impact it has below tier t. floor: a score that an item's answers reach."""

    keys: np.ndarray
    terms: list[str]
    first: np.ndarray
    item: np.ndarray
    weight: np.ndarray
    rest: np.ndarray
    floor: np.ndarray

    def left(self, t: int) -> np.ndarray:
        """What each item can still gain below tier t."""
        out = np.zeros(len(self.keys), np.int64)
        np.add.at(out, self.item, self.weight * np.repeat(self.rest[t], np.diff(self.first)))
        return out

    def some(self, chosen: np.ndarray) -> Block:
        """The chosen items alone."""
        number = np.cumsum(chosen) - 1
        stays = chosen[self.item]
        term = np.repeat(np.arange(len(self.terms)), np.diff(self.first))[stays]
        used = np.unique(term)
        first = np.searchsorted(term, np.append(used, len(self.terms)))
        return Block(self.keys[chosen], [self.terms[j] for j in used], first, number[self.item[stays]], self.weight[stays], self.rest[:, used], self.floor[chosen])


def _blocks(index: Index, items: DataFrame):
    """The items (row, terms, tfs) in blocks of some BLOCK_TERMS terms."""
    many = items.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = math.ceil(many / BLOCK_TERMS)
    for b in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).select("row", F.explode(F.arrays_zip("terms", "tfs")).alias("h")).select("row", F.col("h.terms").alias("term"), F.col("h.tfs").alias("times"))
        rest = [F.coalesce(F.max(F.when(F.col("tier") > t, F.col("most"))), F.lit(0)) for t in range(TIERS)]
        found = index.terms.join(F.broadcast(mine), "term").groupBy("term", "row").agg(F.first("times"), F.sum("docs"), *rest)  # mine: BLOCK_TERMS rows, or one item
        rows = sorted(map(tuple, found.collect()))
        if not rows:
            continue
        term, row, times, df = (np.array([r[c] for r in rows]) for c in range(4))
        weight = times * np.array([term_weight(index.documents, d) for d in df.tolist()], np.int64)
        keys, item = np.unique(row, return_inverse=True)
        new = np.append(True, term[1:] != term[:-1])
        yield Block(keys, term[new].tolist(), np.append(np.flatnonzero(new), len(rows)), item, weight, np.array([r[4:] for r in rows], np.int64)[new].T, np.ones(len(keys), np.int64))


class Best:
    """The k best rows of each item that a task has seen."""

    def __init__(self, items: int, k: int):
        self.k, self.floor, self.parts, self.size, self.limit = k, np.zeros(items, np.int64), [], 0, max(4 * k * items, 1 << 16)

    def add(self, *part: np.ndarray) -> None:
        self.parts.append(part)
        self.size += len(part[0])
        if self.size > self.limit:
            self.take()

    def take(self) -> list[np.ndarray]:
        """item, score, no_id, doc_id, row of the best so far, best first for each item."""
        columns = [np.concatenate(c) for c in zip(*self.parts, strict=True)] if self.parts else [np.zeros(0, np.int64)] * 5
        item, score, none, doc, row = columns
        order = np.lexsort((row, doc, none, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        order, last = order[place < self.k], place == self.k - 1
        self.floor[item[last]] = score[np.lexsort((row, doc, none, -score, columns[0]))][last]
        self.parts = [tuple(c[order] for c in columns)]
        self.size = len(order)
        return list(self.parts[0])


SCANNED = "item long, row long, doc_id long, score long"


def _scan(block: Block, t: int, k: int, complete: bool):
    """Each task's k best rows for each item of the block, by what tiers 0 to t hold; complete: scores are made whole
    from lower tiers, for documents that can reach the item's floor."""
    kinds = pa.schema([(c.split()[0], pa.int64()) for c in SCANNED.split(", ")])
    n = len(block.keys)

    def gains(postings: pa.Array, terms: pa.Array):
        """Cells (document, item), gains, and the bounds they make good, of the postings of some documents."""
        flat = postings.flatten()
        place = pc.index_in(flat.field(0), value_set=terms)
        hit = np.flatnonzero(pc.is_valid(place).to_numpy(zero_copy_only=False))
        term = place.take(pa.array(hit)).to_numpy(zero_copy_only=False).astype(np.int64)
        impact = flat.field(1).to_numpy(zero_copy_only=False)[hit]
        offsets = postings.offsets.to_numpy().astype(np.int64)
        doc = np.searchsorted(offsets - offsets[0], hit, side="right") - 1
        times = np.diff(block.first)[term]
        at = np.repeat(block.first[term] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        weight = block.weight[at]
        return np.repeat(doc, times) * n + block.item[at], weight * np.repeat(impact, times), weight * np.repeat(block.rest[t][term], times)

    def run(batches):
        terms, best, left = pa.array(block.terms, pa.string()), Best(n, k), block.left(t)
        floor = block.floor if complete else np.ones(n, np.int64)
        step = min(ROWS, max(1, CELLS // n))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                score = np.zeros(batch.num_rows * n, np.int64)
                upper = np.tile(left, batch.num_rows)
                for tier in range(t + 1):
                    cell, gain, bound = gains(batch.column(f"tier{tier}"), terms)
                    np.add.at(score, cell, gain)
                    np.add.at(upper, cell, gain - bound)
                if complete:
                    able = upper >= np.tile(block.floor, batch.num_rows)
                    for tier in range(t + 1, TIERS):
                        cell, gain, _ = gains(batch.column(f"tier{tier}"), terms)
                        np.add.at(score, cell[able[cell]], gain[able[cell]])
                    score[~able] = 0
                found = np.flatnonzero(score >= np.tile(np.maximum(floor, best.floor), batch.num_rows))
                doc, ids = found // n, batch.column("doc_id")
                best.add(found % n, score[found], pc.is_null(ids).to_numpy(zero_copy_only=False)[doc].astype(np.int64), pc.fill_null(ids, 0).to_numpy()[doc], batch.column("row").to_numpy()[doc])
            give_back()
        item, score, none, doc, row = best.take()
        yield as_batch(kinds, block.keys[item], row, pa.array(doc, mask=none.astype(bool)), score)

    return run


def _top(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, items: DataFrame, k: int, key: str = "item_id") -> DataFrame:
    """The k best documents of each item (key: a whole number, text): key, rank (from 1), doc_id, score, tier.

    Scores are integers as the index's impacts times the terms' weights, summed over the item's terms with
    repeats. Documents of score 0 are left out; equal scores go by doc_id (null last). tier: the last one that was
    read for all documents before the answer was proven. Items without a term, or with none that any document holds, have
    no rows; rows of items and documents with repeated ids are each ranked on their own.
    """
    spark = items.sparkSession
    asked = scratch(term_counts(items, key).where("n > 0"))
    found = None
    for block in _blocks(index, asked):
        for t in range(TIERS):
            columns = [f"tier{x}" for x in range(t + 1)]
            done = np.ones(len(block.keys), bool)
            if t < TIERS - 1:
                # Whole scores of the k documents that are best by these tiers: k documents reach the least of them.
                seen = _top(index.postings.select("row", "doc_id", *columns).mapInArrow(_scan(block, t, k, False), SCANNED), k)
                rows = seen.select("row").distinct()  # k for each item of the block
                whole = index.postings.join(F.broadcast(rows), "row", "left_semi").mapInArrow(_scan(block, TIERS - 1, k, False), SCANNED)
                known = dict(map(tuple, _top(whole, k).where(F.col("rank") == k).select("item", "score").collect()))  # a row for each item
                floor = np.array([known.get(i, 0) for i in block.keys.tolist()], np.int64)
                block = replace(block, floor=np.maximum(block.floor, floor))
                done = block.left(t) < block.floor
            if done.any():
                rows = index.postings.mapInArrow(_scan(block.some(done), t, k, True), SCANNED).withColumn("tier", F.lit(t))
                found = rows if found is None else found.unionByName(rows)
            if done.all():
                break
            block = block.some(~done)
    if found is None:
        found = spark.createDataFrame([], SCANNED + ", tier int")
    names = asked.select(F.col("row").alias("item"), F.col("id").alias(key))
    return _top(found, k).join(names, "item").select(key, "rank", "doc_id", "score", "tier")
