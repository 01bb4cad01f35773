"""Quality rules by repetition: characters inside n-grams and lines that a text repeats.

Every whole text is split into words once; rolling hashes of several lengths are taken over the words of a
slice of texts together, and windows that share a hash are compared word by word. A text's repeats are its
own: windows of different texts are never matched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import BASES, SPACED, Words, as_batch, by_bytes, byte_class, inside_docs, large_text, mix, rolling, split_words, with_text

#: A text fails with fewer words, or with more than so many words in a hundred inside repeated windows.
LEAST_WORDS, BASE_WINDOW, BASE_PERCENT = 20, 8, 30

#: Of a hundred word characters at most so many may stand in later copies of n-grams (by n), or of lines. A line or
#: sentence that a short text says twice stays below.
NGRAM_PERCENT = {5: 25, 6: 24, 7: 23, 8: 22, 9: 21, 10: 20}
LINE_CHAR_PERCENT = 25

SYMBOLS = ~byte_class([(b, b) for b in b"#*$%&|<>"])

LENGTHS = tuple(sorted({BASE_WINDOW, *NGRAM_PERCENT}))

COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "dup_line_chars", "n_repeat_words", *[f"dup{n}_chars" for n in NGRAM_PERCENT]]


@dataclass
class Repeats:
    """Starts of windows that stand more than once in their text, in order; later: not the first of their kind."""

    starts: np.ndarray
    later: np.ndarray


def repeated_windows(words: Words, codes: np.ndarray, hashes: np.ndarray, doc: np.ndarray, n: int) -> Repeats:
    """The windows of n words that stand at least twice in their text."""
    h = rolling(hashes, n, BASES[0])
    here = np.flatnonzero(inside_docs(words.first, len(h), n))
    h = mix(h[here] + mix(doc[here].astype(np.uint64) + np.uint64(1)))
    ordered = np.sort(h)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return Repeats(np.zeros(0, np.int64), np.zeros(0, bool))
    at = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
    among = twice[at] == h
    starts, group = here[among], at[among]
    first = np.full(len(twice), len(doc), np.int64)
    np.minimum.at(first, group, starts)
    leader = first[group]
    same = doc[starts] == doc[leader]
    for j in range(n):  # words that a hash alone made equal don't count
        same &= codes[starts + j] == codes[leader + j]
    starts, leader = starts[same], leader[same]
    found = np.isin(leader, leader[starts != leader])
    return Repeats(starts[found], (starts != leader)[found])


def covered(starts: np.ndarray, n: int, n_words: int) -> np.ndarray:
    """Which of the words lie in a window of n words from one of the starts."""
    edge = np.zeros(n_words + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def _between(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the values between neighbouring bounds."""
    run = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return run[bounds[1:]] - run[bounds[:-1]]


def _line_counts(data: np.ndarray, bounds: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines with a word, those of them equal to an earlier one, and word characters in these, for each text."""
    docs, breaks = len(bounds) - 1, np.flatnonzero(data == 10)
    starts, ends = np.sort(np.concatenate([bounds[:-1], breaks + 1])), np.sort(np.concatenate([breaks, bounds[1:]]))
    run = np.concatenate([[0], np.cumsum(chars, dtype=np.int64)])
    size = run[ends] - run[starts]
    # A word has at least one byte that begins a character, so a line with a word has characters.
    starts, ends, size = starts[size > 0], ends[size > 0], size[size > 0]
    if not len(starts):
        return (np.zeros(docs, np.int64),) * 3
    doc = np.searchsorted(bounds[1:], ends, side="left")
    # The gaps (line breaks and lines without words) are values of their own in between, at odd places.
    edges = np.empty(2 * len(starts) + 1, np.int64)
    edges[0:-1:2], edges[1::2], edges[-1] = starts, ends, len(data)
    values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
    line = values.take(pa.array(np.arange(0, len(edges) - 1, 2))).dictionary_encode().indices.to_numpy().astype(np.int64)
    _, first = np.unique(doc * np.int64(len(line)) + line, return_index=True)
    copy = np.ones(len(line), bool)
    copy[first] = False
    count = lambda weight: np.bincount(doc, weights=weight, minlength=docs).astype(np.int64)
    return count(np.ones(len(line))), count(copy), count(np.where(copy, size, 0))


def counts_of(texts: pa.LargeStringArray) -> dict[str, np.ndarray]:
    """COUNTS of each text."""
    n = len(texts)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    words = split_words(texts, SPACED)
    out = {"n_words": words.counts, "word_chars": _between(SPACED[data] & ((data & 0xC0) != 0x80), bounds), "n_symbols": _between(SYMBOLS[data], bounds)}
    out["n_lines"], out["n_dup_lines"], out["dup_line_chars"] = _line_counts(data, bounds, SPACED[data] & ((data & 0xC0) != 0x80))
    size = _between((words.bytes & 0xC0) != 0x80, words.offsets)
    codes, _ = words.encoded()
    hashes, doc = mix(codes.astype(np.uint64) + np.uint64(1)), words.doc_of_word()
    for length in LENGTHS:
        found = repeated_windows(words, codes, hashes, doc, length)
        if length == BASE_WINDOW:
            out["n_repeat_words"] = _between(covered(found.starts, length, len(words)), words.first)
        if length in NGRAM_PERCENT:
            out[f"dup{length}_chars"] = _between(np.where(covered(found.starts[found.later], length, len(words)), size, 0), words.first)
    return out


def verdicts(counts: dict) -> tuple:
    """base_failed and kept, of numpy arrays or of columns."""
    failed = (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > BASE_PERCENT * counts["n_words"])
    bad = failed | (100 * counts["dup_line_chars"] > LINE_CHAR_PERCENT * counts["word_chars"])
    for n, percent in NGRAM_PERCENT.items():
        bad = bad | (100 * counts[f"dup{n}_chars"] > percent * counts["word_chars"])
    return failed, ~bad


def _measure(batches):
    kinds = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("base_failed", pa.bool_()), ("kept", pa.bool_())])
    for whole in batches:
        for batch in by_bytes(whole):
            counts = counts_of(large_text(batch.column("text"), lower=False))
            yield as_batch(kinds, batch.column("doc_id"), *[counts[c] for c in COUNTS], *verdicts(counts))


def repetition(docs: DataFrame) -> DataFrame:
    """Repetition in each whole text: doc_id, COUNTS, base_failed, kept; a row for each row of docs.

    word_chars: code points in words; n_symbols; n_lines: lines with a word; n_dup_lines: those equal to an
    earlier one; dup_line_chars: word characters in these; n_repeat_words: words in windows of BASE_WINDOW
    that stand at least twice; dupN_chars: word characters in later copies of windows of N words. base_failed
    and kept follow the fixed values above. A null or empty text has no words: all counts are 0, base_failed
    is true. Repeated or null ids are rows like any other; other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_measure, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean")


def _keep(column: str):
    def run(batches):
        for whole in batches:
            for batch in by_bytes(whole, column):
                yield batch.filter(pa.array(verdicts(counts_of(large_text(batch.column(column), lower=False)))[1]))

    return run


def drop_repetitive(docs: DataFrame, but: Column | None = None) -> DataFrame:
    """The rows of docs, all columns, whose text is kept by the rules of repetition(). Rows for which but holds stay
    whatever they repeat."""
    given, column, added = with_text(docs)
    judged = given if but is None else given.where(~F.coalesce(but, F.lit(False)))
    kept = judged.mapInArrow(_keep(column), given.schema)
    return (kept if but is None else kept.unionByName(given.where(F.coalesce(but, F.lit(False))))).drop(*added)
