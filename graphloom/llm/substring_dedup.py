"""Removal of repeated passages by seed and extend.

A word goes if a run of WINDOW words over it also starts in a document with a smaller id.

* Seeds: in every run of WINDOW words the smallest hash of its k-grams is the anchor (winnowing), so two
  documents that share such a run have the same anchor at the same place of it. Anchors that stand in one
  document alone are dropped.
* Join: each place of a shared anchor brings its surroundings, up to REACH words to either side; places of a block of
  documents with the same surroundings are one row, with the smallest document. Rows meet by anchor.
* Extension: matches at an anchor are extended to both sides, by every split of the REACH words that a run has
  besides the anchor; the words themselves are compared. Of all that agree the smallest document is found, so
  nothing is compared pair by pair, and a passage that thousands of documents share costs a row for each block.
* Maximal repeats: in each document the extended matches that overlap or touch merge, and their words go.

An anchor with more than HOT places (a common phrase in ever different surroundings) would be a large group. Its
rows meet by all words of a run instead: these are as many groups as there are runs, and are combined before the
shuffle.

Documents are dealt once into blocks of a bounded size, many to a partition; that exchange is shared by all
three passes. What else is shuffled has been reduced to distinct rows for a block before.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import BASES, MASK64, SPACED, as_batch, block_count, by_bytes, inside_docs, large_text, mix, rolling, split_words, to_signed

WINDOW, GRAM, BLOCK_BYTES, PARTITION_BYTES = 13, 5, 8 << 20, 256 << 20
#: Words of a run besides its anchor
REACH = WINDOW - GRAM
HOT, CHUNK = 100_000, 1 << 13
NO_ID = 2**63 - 1

#: A tag is the block, whether several documents of it are meant, and how many places
SEEDS = pa.schema([("seed", pa.int64()), ("tag", pa.int64())])
SHARED = pa.schema([("block", pa.int32()), ("seed", pa.int64()), ("hot", pa.bool_())])
#: c1 and c2 tell surroundings of a block apart; left: words before the anchor
SURROUNDINGS = pa.schema([("seed", pa.int64()), ("block", pa.int32()), ("c1", pa.int64()), ("c2", pa.int32()), ("left", pa.int8()), ("words", pa.binary()), ("least", pa.int64()), ("many", pa.bool_()), ("hot", pa.bool_())])
#: least: for each split the smallest document with that run (8 bytes each)
REPEATS = pa.schema([("block", pa.int32()), ("c1", pa.int64()), ("c2", pa.int32()), ("least", pa.binary())])
RUNS = pa.schema([("run", pa.binary()), ("block", pa.int32()), ("c1", pa.int64()), ("c2", pa.int32()), ("split", pa.int8()), ("own", pa.int64()), ("many", pa.bool_())])


def _group_starts(*keys: np.ndarray) -> np.ndarray:
    first = np.zeros(len(keys[0]), bool)
    first[:1] = True
    for k in keys:
        first[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(first)


class Block:
    """The words of some documents, and the places of their anchors."""

    def __init__(self, texts):
        self.words = split_words(large_text(texts, lower=False), SPACED)
        self.hashes = self.words.hashes()
        self.doc = self.words.doc_of_word()
        grams, n = rolling(self.hashes, GRAM, BASES[0]), len(self.words) - WINDOW + 1
        self.at, self.anchor = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if n <= 0:
            return
        span, width, least = REACH + 1, 1, grams
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[:n], least[span - width : span - width + n])
        place = np.zeros(n, np.int64)
        for back in range(REACH, -1, -1):  # the first of equal ones
            place[grams[back : back + n] == least] = back
        inside = np.flatnonzero(inside_docs(self.words.first, n, WINDOW))
        self.at = np.unique(inside + place[inside])
        self.anchor = grams[self.at]

    def surroundings(self, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of anchors at the given words: where their surroundings begin and end, and two hashes of both."""
        first = self.words.first[self.doc[at]]
        low, high = np.maximum(at - REACH, first), np.minimum(at + WINDOW, self.words.first[self.doc[at] + 1])
        hashes = []
        for base in BASES:
            base = base | 1
            power, back = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(self.words), b, np.uint64)])) for b in (base, pow(base, -1, MASK64 + 1)))
            sums = np.concatenate([[np.uint64(0)], np.add.accumulate(mix(self.hashes) * power[:-1])])
            hashes.append(to_signed(mix((sums[high] - sums[low]) * back[low] + (at - low).astype(np.uint64))))
        return low, high, hashes[0], (hashes[1] >> 32).astype(np.int32)


def _seeds(batches):
    for whole in batches:
        for batch in by_bytes(whole, most=BLOCK_BYTES):
            b = Block(batch.column("text"))
            if not len(b.at):
                continue
            doc = b.doc[b.at]
            block = batch.column("block").to_numpy()[doc]
            order = np.lexsort((doc, block, b.anchor))
            anchor, doc, block = b.anchor[order], doc[order], block[order]
            start = _group_starts(anchor, block)
            end = np.append(start[1:], len(anchor))
            many = doc[end - 1] != doc[start]
            yield as_batch(SEEDS, to_signed(anchor[start]), (block[start].astype(np.int64) << 33) + (many.astype(np.int64) << 32) + (end - start))


def _shared(hot: int):
    """Of the seeds of a partition, those that stand in two documents or more."""

    def run(batches):
        parts = list(batches)
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        seed, tag = (t.column(c).to_numpy() for c in SEEDS.names)
        order = np.lexsort((tag, seed))
        seed, tag = seed[order], tag[order]
        start = _group_starts(seed)
        sizes = np.diff(np.append(start, len(seed)))
        places = np.repeat(np.add.reduceat(tag & 0xFFFFFFFF, start), sizes)
        # Rows of a seed come from different blocks, or from different texts of one.
        shared = np.repeat((sizes > 1) | np.logical_or.reduceat((tag >> 32 & 1).astype(bool), start), sizes)
        one = _group_starts(seed, tag >> 33)
        one = one[shared[one]]
        if len(one):
            yield as_batch(SHARED, (tag[one] >> 33).astype(np.int32), seed[one], places[one] > hot)

    return run


def _ids(docs: pa.Table) -> np.ndarray:
    return docs.column("doc_id").fill_null(NO_ID).to_numpy()


def _pieces(b: Block, low: np.ndarray, high: np.ndarray) -> pa.Array:
    """The words from low to high, a blank after each, as bytes."""
    size = np.diff(b.words.offsets) + 1
    joined = np.insert(b.words.bytes, b.words.offsets[1:], 0x20)
    edges = np.concatenate([[0], np.cumsum(size)])
    return _cut_bytes(joined, edges[low], edges[high])


def _cut_bytes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, most: int = 1 << 20) -> pa.Array:
    """The bytes from begin to end, for each pair, gathered about a megabyte at a time."""
    offsets = np.concatenate([[0], np.cumsum(end - begin)])
    taken, low = np.empty(offsets[-1], np.uint8), 0
    while low < len(begin):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most)) - 1)
        lengths = end[low:high] - begin[low:high]
        taken[offsets[low] : offsets[high]] = data[np.repeat(begin[low:high] - offsets[low:high], lengths) + np.arange(offsets[low], offsets[high])]
        low = high
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(taken)])


def _bring(docs: pa.Table, seeds: pa.Table) -> pa.Table:
    """The distinct surroundings of the block's shared anchors, with the smallest document of each."""
    if not docs.num_rows or not seeds.num_rows:
        return SURROUNDINGS.empty_table()
    b = Block(docs.column("text"))
    known = seeds.column("seed").to_numpy()
    order = np.argsort(known)
    known, hot = known[order], seeds.column("hot").to_numpy()[order]
    place = np.minimum(np.searchsorted(known, to_signed(b.anchor)), len(known) - 1)
    on = known[place] == to_signed(b.anchor)
    at, place = b.at[on], place[on]
    if not len(at):
        return SURROUNDINGS.empty_table()
    low, high, c1, c2 = b.surroundings(at)
    doc = _ids(docs)[b.doc[at]]
    order = np.lexsort((doc, c2, c1))
    start = _group_starts(c1[order], c2[order])
    last = order[np.append(start[1:] - 1, len(order) - 1)]
    one = order[start]
    block = np.full(len(one), docs.column("block")[0].as_py(), np.int32)
    columns = known[place[one]], block, c1[one], c2[one], (at[one] - low[one]).astype(np.int8), _pieces(b, low[one], high[one]).cast(pa.binary()), doc[one], doc[last] != doc[one], hot[place[one]]
    return pa.Table.from_batches([as_batch(SURROUNDINGS, *columns)])


def _runs(t: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """All runs of WINDOW words over the anchors of surroundings: row, split (words before the anchor) and words."""
    words = pa.concat_arrays([t.column("words").cast(pa.large_binary())])
    bounds = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    ends = np.flatnonzero(data[bounds[0] : bounds[-1]] == 0x20) + bounds[0] + 1
    edges = np.concatenate([bounds[:1], ends])  # of words
    first = np.searchsorted(edges, bounds)
    left = t.column("left").to_numpy().astype(np.int64)
    size = np.diff(first)
    row, split = np.repeat(np.arange(len(left)), REACH + 1), np.tile(np.arange(REACH + 1), len(left))
    begin = left[row] - split
    ok = (begin >= 0) & (begin + WINDOW <= size[row])
    row, split, begin = row[ok], split[ok], first[row[ok]] + begin[ok]
    return row, split, _cut_bytes(data, edges[begin], edges[begin + WINDOW])


def _agree(batches):
    """Of the surroundings of a partition, those with a run that stands in a smaller document than some of theirs."""
    parts = list(batches)
    if not parts:
        return
    t = pa.Table.from_batches(parts)
    t = t.filter(pc.invert(t.column("hot"))).sort_by("seed")
    seed = t.column("seed").to_numpy()
    groups = np.append(_group_starts(seed), len(seed))
    low = 0
    while low < len(seed):  # whole anchors, some ten thousand rows at a time
        high = max(int(groups[np.searchsorted(groups, low, side="right")]), int(groups[np.searchsorted(groups, min(low + CHUNK, len(seed)), side="right") - 1]))
        some = t.slice(low, high - low).combine_chunks().to_batches()[0]
        low = high
        row, split, runs = _runs(some)
        if not len(row):
            continue
        code = runs.dictionary_encode().indices.to_numpy()
        own, many = some.column("least").to_numpy(), some.column("many").to_numpy(zero_copy_only=False)
        smallest = np.full(int(code.max()) + 1, NO_ID)
        np.minimum.at(smallest, code, own[row])
        found = np.full((some.num_rows, REACH + 1), NO_ID)
        found[row, split] = smallest[code]
        out = (found < own[:, None]).any(axis=1) | many
        yield as_batch(REPEATS, some.column("block").to_numpy()[out], some.column("c1").to_numpy()[out], some.column("c2").to_numpy()[out], [x.tobytes() for x in found[out]])


def _all_runs(batches):
    for batch in batches:
        batch = batch.filter(batch.column("hot"))
        for at in range(0, batch.num_rows, CHUNK):
            some = batch.slice(at, CHUNK)
            row, split, runs = _runs(some)
            take = lambda c, row=row, some=some: some.column(c).to_numpy(zero_copy_only=False)[row]
            yield as_batch(RUNS, runs.cast(pa.binary()), take("block"), take("c1"), take("c2"), split.astype(np.int8), take("least"), take("many"))


def _hot_repeats(surroundings: DataFrame) -> DataFrame:
    """The same as _agree for anchors with many places: runs meet by their words."""
    runs = surroundings.mapInArrow(_all_runs, "run binary, block int, c1 long, c2 int, split tinyint, own long, many boolean")
    least = runs.groupBy("run").agg(F.min("own").alias("least"))
    found = runs.join(least, "run").where("least < own OR many")
    # A row for each split that counts; others stay as they are.
    return found.select("block", "c1", "c2", "split", "least")


def _lookup(b: Block, repeats: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places of anchors with repeats, and for each split the smallest document with that run."""
    low, high, c1, c2 = b.surroundings(b.at)
    known = repeats.column("c1").to_numpy()
    order = np.argsort(known, kind="stable")
    known, second = known[order], repeats.column("c2").to_numpy()[order]
    begin, end = np.searchsorted(known, c1), np.searchsorted(known, c1, side="right")
    many = end - begin
    which = np.repeat(np.arange(len(c1)), many)
    at = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + begin[which]
    same = second[at] == c2[which]
    which, at = which[same], order[at[same]]
    least = np.full((len(b.at), REACH + 1), NO_ID)
    split = repeats.column("split").to_numpy()
    whole = split[at] < 0
    table = np.frombuffer(b"".join(repeats.column("all").fill_null(b"").to_pylist()), np.int64).reshape(-1, REACH + 1)
    number = np.cumsum(split < 0) - 1
    least[which[whole]] = table[number[at[whole]]]
    np.minimum.at(least, (which[~whole], split[at[~whole]]), repeats.column("least").to_numpy()[at[~whole]])
    on = np.flatnonzero((least < NO_ID).any(axis=1))
    return on, least[on]


def _remove(with_text: bool):
    def run(docs: pa.Table, repeats: pa.Table) -> pa.Table:
        b = Block(docs.column("text"))
        words, keep = b.words, np.ones(len(b.words), bool)
        if len(b.at) and repeats.num_rows:
            on, least = _lookup(b, repeats)
            ids = _ids(docs)[b.doc[b.at[on]]]
            hit, split = np.nonzero(least < ids[:, None])
            begin = b.at[on][hit] - split
            edge = np.bincount(begin, minlength=len(words) + 1) - np.bincount(begin + WINDOW, minlength=len(words) + 1)
            keep = np.cumsum(edge[:-1]) == 0
        joined = np.insert(words.bytes, words.offsets[1:], 0x20)
        lengths = np.diff(words.offsets) + 1
        joined = joined[np.repeat(keep, lengths)].tobytes()
        kept = np.concatenate([[0], np.cumsum(keep)])[words.first]
        ends = np.concatenate([[0], np.cumsum(lengths[keep])])[kept].tolist()
        texts = [joined[s : e - 1] if e > s else b"" for s, e in zip(ends, ends[1:], strict=False)]
        n = words.counts
        out = {"doc_id": docs.column("doc_id"), "n_words": pa.array(n), "n_removed": pa.array(n - np.diff(kept)), "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts])}
        return pa.table(out | ({"kept_text": pa.array([t.decode() for t in texts], pa.string())} if with_text else {}))

    return run


def remove_repeats(docs: DataFrame, with_text: bool = False, block_bytes: int = BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """What is left of each document: doc_id, n_words, n_removed, kept_sha256, and kept_text if asked for.

    A word goes if one of the runs of WINDOW words over it also stands in a document with a smaller
    doc_id. Kept words are joined by one space. Null texts have no words. A null doc_id is larger than
    any other; rows with the same doc_id (or none) don't remove each other's words. Other columns are
    ignored.
    """
    blocks = block_count(docs, block_bytes)
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(blocks * block_bytes / PARTITION_BYTES))
    block = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), block.alias("block")).repartition(n, "block")
    seeds = base.mapInArrow(_seeds, "seed long, tag long").repartition(n, "seed").mapInArrow(_shared(hot), "block int, seed long, hot boolean")
    kinds = "seed long, block int, c1 long, c2 int, left tinyint, words binary, least long, many boolean, hot boolean"
    around = base.groupBy("block").cogroup(seeds.groupBy("block")).applyInArrow(_bring, kinds).repartition(n, F.when(F.col("hot"), F.xxhash64("c1", "c2")).otherwise(F.col("seed")))
    cold = around.mapInArrow(_agree, "block int, c1 long, c2 int, least binary")
    repeats = cold.select("block", "c1", "c2", F.lit(-1).cast("tinyint").alias("split"), F.lit(None).cast("long").alias("least"), F.col("least").alias("all"))
    repeats = repeats.unionByName(_hot_repeats(around).withColumn("all", F.lit(None).cast("binary")))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return base.groupBy("block").cogroup(repeats.groupBy("block")).applyInArrow(_remove(with_text), schema)
