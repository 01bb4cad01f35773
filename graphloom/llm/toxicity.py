"""Toxicity by compression distance.

A text is cut into overlapping windows of running words. Every window is compressed with zstandard twice,
with a dictionary of ordinary text and with one of toxic text, and the difference of the two lengths says
which of them the window is nearer to. Both dictionaries end in the same trained piece of ordinary text, so that
lengths differ by what is toxic and not by what happens to be in one sample only; before it stand as much
ordinary text again in the one and toxic text in the other. Matches are looked for in the nearest text first,
so a window takes from the front only what the common part lacks.

Labels are of documents, and most of a toxic document is ordinary. So the toxic dictionary is trained in rounds:
at first on all windows of toxic documents, then on those that a dictionary from other toxic documents (the
documents are dealt to two folds) shortens by as much as it rarely does with windows of ordinary documents that
no dictionary has seen.

Differences of length are calibrated on the same unseen windows: each has a log-likelihood ratio of toxic
against ordinary documents, and large ones count. A document's sum of them, set against its length, becomes
the score; 0.5 is the threshold that keeps most toxic documents out for few ordinary ones.

Training reads a bounded sample (TOXIC_DOCS and ORDINARY_DOCS labelled documents); scoring reads every window
of every text and needs no shuffle.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import byte_class, by_bytes, large_text, split_words, with_text

TOXIC_DOCS, ORDINARY_DOCS = 2_000, 6_000
#: Words of a window, and from one to the next in scoring and in training
WINDOW, STEP, TRAIN_STEP = 12, 8, 4
#: Bytes of the common part of both dictionaries, and of what stands before it
COMMON_BYTES, OWN_BYTES = 2_000_000, 128 << 10
#: Bytes of the segments that dictionaries are trained to pick: long ones for the common part
COMMON_SEGMENT, SEGMENT, ROUNDS = 200, 48, 3
#: Longer differences come from copied passages, whatever they say
FURTHEST = 10
LEAST_RATIO, LEAST_WEIGHT, PER_WINDOWS, FALSE_ALARM = 2.0, 0.7, 15, 10

#: ASCII letters and all bytes of other characters
LETTERS = byte_class([(0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])


@dataclass
class Windows:
    """Windows of texts: window i is data[begin[i]:end[i]] and belongs to text doc[i]."""

    data: bytes
    begin: np.ndarray
    end: np.ndarray
    doc: np.ndarray

    def some(self, chosen: np.ndarray) -> list[bytes]:
        return [self.data[a:b] for a, b in zip(self.begin[chosen].tolist(), self.end[chosen].tolist(), strict=True)]

    def lengths(self, compressor: zstandard.ZstdCompressor, chosen: np.ndarray | slice = slice(None)) -> np.ndarray:
        compress, data, begin, end = compressor.compress, self.data, self.begin[chosen], self.end[chosen]
        return np.fromiter((len(compress(data[a:b])) for a, b in zip(begin.tolist(), end.tolist(), strict=True)), np.int64, len(begin))


def windows_of(texts: pa.LargeStringArray, step: int = STEP, size: int = WINDOW) -> Windows:
    """The windows of each text (in lower case): its words with a blank between and at both ends; the last window
    of a text may be shorter, and a text without words has none."""
    words = split_words(texts, LETTERS)
    data = np.concatenate([np.full(1, 0x20, np.uint8), np.insert(words.bytes, words.offsets[1:], 0x20)]).tobytes()
    counts = words.counts
    many = np.where(counts > 0, -(-np.maximum(counts - size, 0) // step) + 1, 0)
    doc = np.repeat(np.arange(len(counts)), many)
    first = words.first[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * step
    last = np.minimum(first + size, words.first[doc + 1]) - 1
    return Windows(data, words.offsets[first] + first, words.offsets[last + 1] + last + 2, doc)


def trained(samples: list[bytes], size: int, segment: int = SEGMENT) -> bytes:
    """A trained dictionary, or the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 2)), samples, k=segment, d=8, f=22, accel=1).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(
        window_log=22, chain_log=21, hash_log=20, search_log=1, min_match=5, target_length=32, strategy=3, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    known = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=known, compression_params=params)


def _place(difference: np.ndarray) -> np.ndarray:
    return np.clip(difference, -FURTHEST - 1, FURTHEST + 1) + FURTHEST + 1


def _ratios(toxic: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """The log-likelihood ratio of each difference from -FURTHEST - 1 to FURTHEST + 1; none for those beyond."""
    a, b = (np.bincount(_place(d), minlength=2 * FURTHEST + 3) / max(1, len(d)) for d in (toxic, ordinary))
    ratio = np.log((a + 3e-5) / (b + 3e-5))
    ratio[[0, -1]] = 0.0
    return ratio


@dataclass
class Model:
    """Without a toxic dictionary nothing is toxic."""

    common: bytes
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    threshold: float

    def __post_init__(self):
        self._made = None

    def __getstate__(self):
        return self.__dict__ | {"_made": None}

    def sums(self, texts: pa.LargeStringArray) -> np.ndarray:
        if not self.toxic:
            return np.zeros(len(texts))
        if self._made is None:
            self._made = compressor(self.ordinary + self.common), compressor(self.toxic + self.common)
        windows = windows_of(texts)
        near_ordinary, near_toxic = (windows.lengths(c) for c in self._made)
        return _sums(windows.doc, self.weights[_place(near_ordinary - near_toxic)], len(texts))

    def scores(self, texts: pa.LargeStringArray) -> np.ndarray:
        """0 to 1; 0.5 at the threshold."""
        s = self.sums(texts)
        return s / (s + self.threshold)


def _sums(doc: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weight, n) / (1 + np.bincount(doc, minlength=n) / PER_WINDOWS)


def fit(texts: list[str], labels: list[int]) -> Model:
    """Learns from labelled texts. Without a toxic text, or without an ordinary one, nothing is toxic."""
    nothing = Model(b"", b"", b"", np.zeros(2 * FURTHEST + 3), 1.0)
    y = np.array(labels, bool)
    column = large_text(pa.array(texts, pa.string()), lower=True)
    # Copies of a text are in one fold.
    deal = np.array([zlib.crc32((t or "").encode()) >> 7 & 3 for t in texts], np.int64)
    fold, apart = deal & 1, ~y & (deal == 3)
    if not y.any() or y.all():
        return nothing

    windows = windows_of(column, TRAIN_STEP)
    seen = np.flatnonzero((~y & (deal != 3))[windows.doc])[:: -(-WINDOW // TRAIN_STEP)]
    bad, unseen = np.flatnonzero(y[windows.doc]), np.flatnonzero(apart[windows.doc])[::2]
    if not len(bad) or not len(seen) or not len(unseen):
        return nothing
    of_fold = fold[windows.doc[bad]]
    common = trained(windows.some(seen), COMMON_BYTES, COMMON_SEGMENT)
    ordinary = trained(windows.some(seen[:: max(1, len(seen) * 64 // OWN_BYTES)]), OWN_BYTES)
    plain = compressor(ordinary + common)
    bad_plain, unseen_plain = windows.lengths(plain, bad), windows.lengths(plain, unseen)

    def other_folds(picked: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
        """With a dictionary from the picked windows of the other fold: the differences of each fold's windows."""
        made = [compressor(trained(windows.some(bad[picked & (of_fold != f)]), OWN_BYTES) + common) for f in (0, 1)]
        found = np.zeros(len(bad), np.int64)
        for f in (0, 1):
            on = of_fold == f
            found[on] = bad_plain[on] - windows.lengths(made[f], bad[on])
        return made, found, np.concatenate([unseen_plain - windows.lengths(c, unseen) for c in made])

    picked = np.ones(len(bad), bool)
    for _ in range(ROUNDS):
        made, found, clean = other_folds(picked)
        picked = (found > 0) & (_ratios(found, clean)[_place(found)] > LEAST_RATIO)
        if not picked.any():
            return nothing
    made, found, clean = other_folds(picked)
    ratio = _ratios(found, clean)
    weights = np.where((ratio > LEAST_WEIGHT) & (np.arange(len(ratio)) > FURTHEST + 1), ratio, 0.0)
    toxic = trained(windows.some(bad[picked]), OWN_BYTES)
    del windows, bad_plain, unseen_plain

    # The threshold on a document's sum, from the windows that are scored, with dictionaries that haven't seen them.
    windows, n = windows_of(column), len(y)
    weight = np.zeros(len(windows.doc))
    whole = compressor(toxic + common)
    for on, other in (((y & (fold == 0)), made[0]), ((y & (fold == 1)), made[1]), (apart, whole)):
        at = np.flatnonzero(on[windows.doc])
        weight[at] = weights[_place(windows.lengths(plain, at) - windows.lengths(other, at))]
    s = _sums(windows.doc, weight, n)
    cuts = np.unique(np.concatenate([s[y | apart], [0.0]]))
    cuts = (cuts[1:] + cuts[:-1]) / 2
    if not len(cuts):
        return nothing
    gain = [(s[y] >= c).mean() - FALSE_ALARM * (s[apart] >= c).mean() for c in cuts]
    best = np.flatnonzero(np.array(gain) >= max(gain) - 1e-12)
    return Model(common, ordinary, toxic, weights, float(cuts[best[len(best) // 2]]))


def train(docs: DataFrame, labels: DataFrame, wanted=None, toxic_docs: int = TOXIC_DOCS, ordinary_docs: int = ORDINARY_DOCS) -> Model:
    """Fits a model on at most toxic_docs and ordinary_docs labelled documents, chosen by a hash of doc_id.

    wanted: a condition on doc_id for rows that may be learned from. Rows with a null id or label are
    left out; a null text is empty.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    rows = rows.where(wanted) if wanted is not None else rows
    order = F.xxhash64("doc_id", F.lit(11)), F.col("doc_id")
    chosen = rows.where("toxic = 1").orderBy(*order).limit(toxic_docs).union(rows.where("toxic = 0").orderBy(*order).limit(ordinary_docs))
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "toxic", "text").toArrow()
    return fit(sample.column("text").to_pylist(), sample.column("toxic").to_pylist())


def with_toxicity(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """The documents, all columns, with one more: the score, 0 to 1; 0 for texts without a letter, empty and null
    texts. A column that has this name goes. Each row is scored by its text alone, so repeated rows and
    null ids are rows like any other."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.drop(name)
    given, text, added = with_text(rows)

    def run(batches):
        for whole in batches:
            for batch in by_bytes(whole, text):
                scores = shared.value.scores(large_text(batch.column(text), lower=True))
                yield batch.drop_columns(added).append_column(name, pa.array(scores))

    return given.mapInArrow(run, rows.select("*", F.lit(0.0).alias(name)).schema)
