"""Benchmark decontamination with an FM-index per training shard.

A shard is a batch of whole documents in one task. Its words become numbers of the alphabet of the test
phrases; a word outside that alphabet can't be part of an occurrence and is a separator, and stretches
between separators that are shorter than the shortest phrase are left out of the index. Over the rest:

* the suffixes are sorted (prefix doubling), which gives the Burrows-Wheeler transform;
* a wavelet matrix answers how often a symbol stands before a row;
* all phrases are searched backward at once, a step for each word;
* occurrences are located by walking back to sampled suffix positions;
* the words of all occurrences merge into spans.

The phrases are broadcast in blocks of a bounded size, and the documents pass each block in turn: there
is no shuffle, and nothing grows with the corpus but the number of tasks.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import ALNUM, by_bytes, fresh, large_text, split_words

WINDOW, SAMPLE, BLOCK_BYTES = 10, 8, 8 << 20


class WaveletMatrix:
    """How often a symbol stands in the first i places of a sequence, for many i at once."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            ones = np.concatenate([[0], np.cumsum(bit)])
            self.levels.append((level, ones, len(symbols) - ones[-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, ones, zeros in self.levels:
            before = ones[at]
            at = np.where((symbol >> level) & 1, zeros + before, at - before)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._descend(symbol, at) - self._descend(symbol, np.zeros_like(at))


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The sorted suffixes of a text whose zeros are separators, each of them different (earlier: smaller)."""
    n = len(text)
    zeros = text == 0
    rank = np.where(zeros, np.cumsum(zeros) - 1, text + zeros.sum())
    width = 1
    while True:
        after = np.zeros(n, np.int64)
        after[:-width] = rank[width:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        width *= 2
        if fresh[-1] == n - 1 or width >= n:
            return order


class FMIndex:
    """Over a text of symbols 1 to sigma with separators 0; it ends with one and no two are neighbours."""

    def __init__(self, text: np.ndarray, sigma: int):
        order = suffix_array(text)
        self.bwt = text[order - 1]
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 1))])
        self.tree = WaveletMatrix(self.bwt, max(1, int(sigma).bit_length()))
        # Sampled: every SAMPLE-th place, and those after a separator, so that no walk crosses one.
        self.sampled = (order % SAMPLE == 0) | (self.bwt == 0)
        self.samples = order[self.sampled]
        self.sample_rank = np.cumsum(self.sampled) - 1

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last-plus-one row of the suffixes that begin with each pattern (rows right-aligned)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.bwt), np.int64)
        width = patterns.shape[1]
        for step in range(width):
            on = np.flatnonzero((lengths > step) & (low < high))
            symbol = patterns[on, width - 1 - step]
            low[on] = self.less[symbol] + self.tree.rank(symbol, low[on])
            high[on] = self.less[symbol] + self.tree.rank(symbol, high[on])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        left = np.arange(len(rows))
        while len(left):
            known = self.sampled[rows[left]]
            done = left[known]
            out[done] = self.samples[self.sample_rank[rows[done]]] + steps[done]
            left = left[~known]
            symbol = self.bwt[rows[left]]
            rows[left] = self.less[symbol] + self.tree.rank(symbol, rows[left])
            steps[left] += 1
        return out


@dataclass
class Phrases:
    """Distinct windows of items, as numbers of an alphabet, and the items of each."""

    alphabet: pa.Array
    windows: np.ndarray
    lengths: np.ndarray
    items: list[list[str]]


def phrases(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> Phrases:
    words = split_words(large_text(pa.array([t for _, t in items], pa.string()), lower=True), ALNUM)
    codes, alphabet = words.encoded()
    found: dict[tuple[int, ...], list[str]] = {}
    for (item, _), low, high in zip(items, words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        k = min(window, high - low)
        for at in range(low, high - k + 1 if k else low):
            owners = found.setdefault(tuple((codes[at : at + k] + 1).tolist()), [])
            if item is not None and item not in owners:
                owners.append(item)
    lengths = np.array([len(w) for w in found], np.int64)
    table = np.zeros((len(found), window), np.int64)
    for row, w in enumerate(found):
        table[row, window - len(w) :] = w
    return Phrases(alphabet, table, lengths, list(found.values()))


def occurrences(texts: pa.LargeStringArray, wanted: Phrases):
    """Words of the texts, and of each occurrence the first word and the window."""
    words = split_words(texts, ALNUM)
    none = np.zeros(0, np.int64)
    if not len(wanted.lengths) or not len(words):
        return words, none, none
    codes, distinct = words.encoded()
    symbol = pc.fill_null(pc.index_in(distinct, value_set=wanted.alphabet.cast(distinct.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    symbols = symbol[codes]
    # Stretches of alphabet words inside one document.
    doc = words.doc_of_word()
    known = symbols > 0
    begins = known.copy()
    begins[1:] &= ~(known[:-1] & (doc[1:] == doc[:-1]))
    start = np.flatnonzero(begins)
    ends = known.copy()
    ends[:-1] &= ~(known[1:] & (doc[1:] == doc[:-1]))
    length = np.flatnonzero(ends) + 1 - start
    long = length >= wanted.lengths.min()
    start, length = start[long], length[long]
    if not len(start):
        return words, none, none
    edges = np.concatenate([[0], np.cumsum(length + 1)])
    place = np.arange(edges[-1]) - np.repeat(edges[:-1], length + 1) + np.repeat(start, length + 1)
    text = symbols[np.minimum(place, len(symbols) - 1)]
    text[edges[1:] - 1] = 0
    index = FMIndex(text, len(wanted.alphabet))
    low, high = index.search(wanted.windows, wanted.lengths)
    many = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(many)), many)
    rows = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + low[which]
    return words, place[index.locate(rows)], which


def _lists(values: list[list], kind: pa.DataType) -> pa.Array:
    return pa.array(values, pa.list_(kind))


#: What with_hits adds
ADDED = ("firsts", "ends", "items")


def _add_hits(wanted, added: tuple[str, ...]):
    """Adds to each document the words (first, end) that a block of phrases covers, and the items."""

    def run(batches):
        given = wanted.value
        for whole in batches:
            for batch in by_bytes(whole):
                texts = large_text(batch.column("text"), lower=True)
                words, first, which = occurrences(texts, given)
                doc = words.doc_of_word()[first] if len(first) else first
                lists = [batch.column(n).to_pylist() for n in added]
                firsts, ends, items = lists
                for d, f, w in zip(doc.tolist(), first.tolist(), which.tolist(), strict=True):
                    firsts[d].append(f - int(words.first[d]))
                    ends[d].append(f - int(words.first[d]) + int(given.lengths[w]))
                pairs = np.unique(np.stack([doc, which]), axis=1) if len(doc) else np.zeros((2, 0), np.int64)
                found: dict[int, dict] = {}
                for d, w in zip(*pairs.tolist(), strict=True):
                    found.setdefault(d, dict.fromkeys(items[d])).update(dict.fromkeys(given.items[w]))
                for d, some in found.items():
                    items[d] = list(some)
                for name, values in zip(added, lists, strict=True):
                    at = batch.schema.get_field_index(name)
                    batch = batch.set_column(at, name, pa.array(values, batch.schema.field(at).type))
                yield batch

    return run


def with_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, added: tuple[str, ...] = ADDED, then=None, schema=None) -> DataFrame:
    """The documents with firsts and ends (spans of covered words, overlapping) and items (found item ids), under
    the names in added. then: what the task that has searched the last block does with the batches, and the schema
    that gives."""
    spark = docs.sparkSession
    kinds = ("array<int>", "array<int>", "array<string>")
    found = docs.select("*", *[F.array().cast(k).alias(n) for n, k in zip(added, kinds, strict=True)])
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text").cast("long") + 16)).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    for block in range(blocks):  # one, unless the benchmark is larger than the bound
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        search = _add_hits(spark.sparkContext.broadcast(phrases([tuple(r) for r in part.collect()], window)), added)
        if block < blocks - 1 or then is None:
            found = found.mapInArrow(search, found.schema)
        else:
            found = found.mapInArrow(lambda batches, search=search: then(search(batches)), schema)
    return found


def _merged(firsts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    spans: list[tuple[int, int]] = []
    for first, end in sorted(zip(firsts, ends, strict=True)):
        if spans and first <= spans[-1][1]:
            spans[-1] = spans[-1][0], max(end, spans[-1][1])
        else:
            spans.append((first, end))
    return spans


REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _report(batches):
    for whole in batches:
        for batch in by_bytes(whole):
            counts = split_words(large_text(batch.column("text"), lower=True), ALNUM).counts
            hits = [sum(e - f for f, e in _merged(fs, es)) for fs, es in zip(batch.column("firsts").to_pylist(), batch.column("ends").to_pylist(), strict=True)]
            items = batch.column("items").to_pylist()
            digests = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_words": pa.array(counts), "n_hit": pa.array(hits, pa.int64()), "n_items": pa.array([len(x) for x in items], pa.int64()), "items_sha256": pa.array(digests), "contaminated": pa.array([h > 0 for h in hits])})


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """What each document shares with the benchmark: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is WINDOW consecutive words of an item, or all words of a shorter one. Null texts have no
    words; items without words have no window. An item with a null id hits but isn't listed. Repeated
    rows are kept; other columns are ignored; an empty benchmark hits nothing.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_hits(texts, benchmark, then=_report, schema=REPORT)


def _cut(added: tuple[str, ...], was_hit: str):
    def run(batches):
        for whole in batches:
            for batch in by_bytes(whole):
                texts = batch.column("text").to_pylist()
                firsts, ends = (batch.column(n).to_pylist() for n in added[:2])
                for d in [d for d, f in enumerate(firsts) if f]:
                    data = np.frombuffer(texts[d].encode(), np.uint8)
                    inside = ALNUM[np.where((data >= 65) & (data <= 90), data + 32, data)]
                    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
                    stops = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1
                    keep = np.ones(len(data), bool)
                    for first, end in _merged(firsts[d], ends[d]):
                        keep[starts[first] : stops[end - 1]] = False
                    texts[d] = data[keep].tobytes().decode()
                at = batch.schema.get_field_index("text")
                cut = batch.set_column(at, "text", pa.array(texts, batch.schema.field(at).type)).drop_columns(list(added))
                yield cut.append_column(was_hit, pa.array([bool(f) for f in firsts]))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, without the spans that occurrences of windows cover.

    A document of which no letter or digit is left after a cut is dropped; others, and those without a
    hit, stay as they are: null and empty texts, repeated rows and rows without an id too. Columns may have any name.
    """
    added, was_hit = tuple(fresh(docs, n) for n in ADDED), fresh(docs, "was_hit")
    cut = with_hits(docs, benchmark, added=added, then=_cut(added, was_hit), schema=docs.select("*", F.lit(False).alias(was_hit)).schema)
    return cut.where(~F.col(was_hit) | F.col("text").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")).drop(was_hit)
