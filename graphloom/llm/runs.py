"""Periodic runs of words by longest previous factors.

A slice of texts is one sequence of numbers, with a mark of its own before the first text and after each. Its
suffix array comes from prefix doubling, and the ranks of every doubling step stay: they tell at once whether
two stretches of 2**k words are equal, so longest common extensions to either side of many places are found
level by level, all places together. Suffix array and common prefixes give the longest previous factor at each
word, and these the Lempel-Ziv blocks. A run that crosses or touches the start of a block is found there by
extending to both sides over each period that the neighbouring blocks allow (Main 1989); a run strictly inside
a block also lies inside the block's earlier copy and is copied from there, out of buckets by start (Kolpakov
and Kucherov 1999). Texts never match one another.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import SPACED, Words, as_batch, by_bytes, large_text, split_words

#: A run counts from so many words and so many periods on.
LEAST_LENGTH, LEAST_PERIODS = 6, 4


class Ranks:
    """Prefix doubling over numbers in which every mark (0 to marks - 1) stands once; levels[k] has the ranks of the
    stretches of 2**k from each place. A stretch that holds a mark is equal to no other."""

    def __init__(self, numbers: np.ndarray):
        n = len(numbers)
        order = np.argsort(numbers, kind="stable")
        rank, slots = np.empty(n, np.int64), np.arange(n)
        rank[order] = self._firsts(numbers[order], slots)
        self.levels, width = [rank.astype(np.int32)], 1
        active = self._shared(rank[order])
        slots = slots[active]
        while len(slots):
            at = order[slots]
            # Two equal stretches hold no mark, so the words after them are in the same text, or its mark.
            key = rank[at] * n + rank[at + width]
            by_key = np.argsort(key, kind="stable")
            at, key = at[by_key], key[by_key]
            order[slots] = at
            rank[at] = self._firsts(key, slots)
            self.levels.append(rank.astype(np.int32))
            width *= 2
            slots = slots[self._shared(rank[at])]
        self.order = order

    @staticmethod
    def _firsts(key: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """For each place in a sorted key the slot of the first place with its value."""
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        return slots[new][np.cumsum(new) - 1]

    @staticmethod
    def _shared(rank: np.ndarray) -> np.ndarray:
        same = rank[1:] == rank[:-1]
        return np.append(same, False) | np.append(False, same)

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j (other places) on are equal."""
        found, alive = np.zeros(len(i), np.int64), np.flatnonzero(self.levels[0][i] == self.levels[0][j])
        i, j, length = i[alive], j[alive], np.zeros(len(alive), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            length += (self.levels[k][i + length] == self.levels[k][j + length]).astype(np.int64) << k
        found[alive] = length
        return found

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i and before j are equal."""
        found, alive = np.zeros(len(i), np.int64), np.flatnonzero(self.levels[0][i - 1] == self.levels[0][j - 1])
        i, j, length = i[alive], j[alive], np.zeros(len(alive), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = i - length - (1 << k), j - length - (1 << k)
            same = (a >= 0) & (b >= 0)
            length += (same & (self.levels[k][np.maximum(a, 0)] == self.levels[k][np.maximum(b, 0)])).astype(np.int64) << k
        found[alive] = length
        return found


def previous_factors(order: np.ndarray, common: np.ndarray) -> tuple[list[int], list[int]]:
    """For each place the length of the longest stretch from it that also begins at an earlier place, and that
    place: the longer of the common prefixes with the nearest earlier places on either side in the suffix array."""
    length, source = [0] * len(order), [0] * len(order)
    stack, prefix = [-1], [0]
    for place, c in zip(order.tolist(), common.tolist(), strict=True):
        while stack[-1] > place:
            top, left = stack.pop(), prefix.pop()
            if left > c:
                length[top], source[top] = left, stack[-1]
                # what the places on both sides of top share is bounded by c already
            else:
                length[top], source[top] = c, place
                c = left
        stack.append(place)
        prefix.append(c)
    while len(stack) > 1:
        top, left = stack.pop(), prefix.pop()
        length[top], source[top] = left, stack[-1]
    return length, source


def blocks(length: list[int], starts: list[int], ends: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of the Lempel-Ziv blocks of each text; at a text's end stands one of size 0."""
    at, size = [], []
    for i, end in zip(starts, ends, strict=True):
        while i < end:
            step = length[i] or 1
            at.append(i)
            size.append(step)
            i += step
        at.append(end)
        size.append(0)
    return np.array(at, np.int64), np.array(size, np.int64)


def _crossing(ranks: Ranks, at: np.ndarray, size: np.ndarray, opens: np.ndarray, budget: int = 1 << 20) -> np.ndarray:
    """Runs (start, end, period) that cross or touch the start of a block other than a text's first (opens).
    A run that ends in a block of u words, after one of v, has a period below u + v: were it longer, or did the run
    begin a period before the block ahead, that block would have been longer."""
    here = np.flatnonzero(~opens)
    if not len(here):
        return np.zeros((0, 3), np.int64)
    b, u, v = at[here], size[here], size[here - 1]
    found, cut = [], np.concatenate([[0], np.cumsum(2 * u + v)])
    low = 0
    while low < len(b):
        high = max(low + 1, int(np.searchsorted(cut, cut[low] + budget, side="right")) - 1)
        for side, most in (("right", u[low:high]), ("left", u[low:high] + v[low:high])):
            start = np.repeat(b[low:high], most)
            p = np.arange(len(start)) - np.repeat(np.cumsum(most) - most, most) + 1
            i = start if side == "right" else start - p
            ok = i > 0
            i, p = i[ok], p[ok]
            near = (ranks.levels[0][i] == ranks.levels[0][i + p]) | (ranks.levels[0][i - 1] == ranks.levels[0][i + p - 1])
            i, p = i[near], p[near]
            ahead, back = ranks.forward(i, i + p), ranks.backward(i, i + p)
            run = ahead + back >= p
            found.append(np.stack([(i - back)[run], (i + p + ahead)[run], p[run]], axis=1))
        low = high
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    return rows[first]


def _with_copies(crossing: np.ndarray, at: np.ndarray, size: np.ndarray, source: list[int]) -> np.ndarray:
    """The runs, and those strictly inside a block, copied from where the block stands before."""
    if not len(crossing):
        return crossing
    bucket: dict[int, dict[int, int]] = {}
    for s, e, p in crossing.tolist():
        bucket.setdefault(s, {})[e] = p
    starts = sorted(bucket)
    for b, u in zip(at[size >= 4].tolist(), size[size >= 4].tolist(), strict=True):
        shift = b - source[b]
        k = bisect_right(starts, b - shift)
        while k < len(starts) and starts[k] + shift < b + u:
            s = starts[k] + shift
            inside = {e + shift: p for e, p in bucket[starts[k]].items() if e + shift < b + u}
            if inside:
                if s not in bucket:
                    insort(starts, s)
                bucket.setdefault(s, {}).update(inside)
            k += 1
    return np.array([(s, e, p) for s in starts for e, p in bucket[s].items()], np.int64)


def find_runs(codes: np.ndarray, first: np.ndarray, least_length: int = 2, least_periods: int = 2) -> np.ndarray:
    """All runs of the texts: rows (text, start, length, period), by text, start and period. A run is a stretch with
    smallest period p of at least two (or least_periods) times p that no neighbouring word extends. codes: a number
    for each word; text d has words first[d]:first[d+1]."""
    docs, counts = len(first) - 1, np.diff(first)
    if not len(codes):
        return np.zeros((0, 4), np.int64)
    doc = np.repeat(np.arange(docs), counts)
    words_at = np.arange(len(codes)) + doc + 1
    # Marks are 0 to docs; a word's number is told apart by its text.
    numbers = np.empty(len(codes) + docs + 1, np.int64)
    numbers[0] = 0
    ends = first[1:] + np.arange(docs) + 1
    numbers[ends] = np.arange(1, docs + 1)
    numbers[words_at] = docs + 1 + doc * (int(codes.max()) + 1) + codes
    ranks = Ranks(numbers)
    order = ranks.order
    common = np.zeros(len(order), np.int64)
    common[1:] = ranks.forward(order[:-1], order[1:])
    length, source = previous_factors(order, common)
    begins = first[:-1] + np.arange(docs) + 1
    at, size = blocks(length, begins.tolist(), ends.tolist())
    opens = np.isin(at, begins)
    rows = _with_copies(_crossing(ranks, at, size, opens), at, size, source)
    if not len(rows):
        return np.zeros((0, 4), np.int64)
    n, p = rows[:, 1] - rows[:, 0], rows[:, 2]
    rows, n, p = (x[(n >= least_length) & (n >= least_periods * p)] for x in (rows, n, p))
    text = np.searchsorted(ends, rows[:, 0], side="right")
    out = np.stack([text, rows[:, 0] - begins[text], n, p], axis=1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def repeats_covered(runs: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The words that a run holds after its first period."""
    edge = np.zeros(first[-1] + 1, np.int32)
    start = first[runs[:, 0]] + runs[:, 1]
    np.add.at(edge, start + runs[:, 3], 1)
    np.add.at(edge, start + runs[:, 2], -1)
    return np.cumsum(edge[:-1]) > 0


def joined(words: Words, kept: np.ndarray) -> pa.LargeBinaryArray:
    """The kept words of each text, joined by one blank."""
    lengths, docs = np.diff(words.offsets), len(words.first) - 1
    stay = words.bytes[np.repeat(kept, lengths)]
    number = np.repeat(np.arange(int(kept.sum())), lengths[kept])
    run = np.concatenate([[0], np.cumsum(np.where(kept, lengths + 1, 0))])[words.first]
    out = np.full(run[-1], 0x20, np.uint8)
    out[np.arange(len(stay)) + number] = stay
    # Each text ends in a blank too many; these are values of their own, at odd places.
    edges = np.empty(2 * docs + 1, np.int64)
    edges[0::2], edges[1::2] = run, np.maximum(run[1:] - 1, run[:-1])
    every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * docs, [None, pa.py_buffer(edges), pa.py_buffer(out)])
    return every.take(pa.array(np.arange(0, 2 * docs, 2)))


def runs_of(texts: pa.LargeStringArray, least_length: int, least_periods: int) -> tuple[np.ndarray, pa.LargeBinaryArray]:
    """The runs of the texts, and the texts without the words that runs repeat."""
    words = split_words(texts, SPACED)
    codes, _ = words.encoded() if len(words) else (np.zeros(0, np.int64), None)
    runs = find_runs(codes.astype(np.int64), words.first, least_length, least_periods)
    return runs, joined(words, ~repeats_covered(runs, words.first))


NONE = hashlib.sha256(b"").hexdigest()
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _digests(least_length: int, least_periods: int):
    kinds = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in SCHEMA.split(", ")])

    def run(batches):
        for whole in batches:
            for batch in by_bytes(whole):
                runs, collapsed = runs_of(large_text(batch.column("text"), lower=False), least_length, least_periods)
                n = batch.num_rows
                bounds = np.searchsorted(runs[:, 0], np.arange(n + 1))
                longest, listed = [[None] * n for _ in range(4)], [NONE] * n
                for d in np.unique(runs[:, 0]).tolist():
                    mine = runs[bounds[d] : bounds[d + 1], 1:].tolist()
                    listed[d] = hashlib.sha256("".join(f"{s},{size},{p}\n" for s, size, p in mine).encode()).hexdigest()
                    s, size, p = min(mine, key=lambda r: (-r[1], r[0], r[2]))
                    for column, value in zip(longest, (s, size, p, 1000 * size // p), strict=True):
                        column[d] = value
                digest = [hashlib.sha256(t.as_buffer()).hexdigest() for t in collapsed]
                yield as_batch(kinds, batch.column("doc_id"), np.diff(bounds), *longest, listed, digest)

    return run


def periodic_runs(docs: DataFrame, least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """Runs of each whole text: doc_id, n_runs, the longest one's start, length, period and exponent_milli (ties:
    smaller start, then period; null without a run), digests of all runs and of the words that stay.

    A run is a stretch of words with smallest period p, at least least_length words and least_periods times p
    long, that cannot be extended. Null, empty and blank texts have no runs. Repeated or null ids are rows like any
    other; other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_digests(least_length, least_periods), SCHEMA)


def _list(least_length: int, least_periods: int):
    def run(batches):
        kinds = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "period")])
        for whole in batches:
            for batch in by_bytes(whole):
                runs, _ = runs_of(large_text(batch.column("text"), lower=False), least_length, least_periods)
                yield as_batch(kinds, batch.column("doc_id").take(pa.array(runs[:, 0])), *(runs[:, c] for c in (1, 2, 3)))

    return run


def list_runs(docs: DataFrame, least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """A row for each run: doc_id, start (word), length, period. Texts as in periodic_runs()."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_list(least_length, least_periods), "doc_id long, start long, length long, period long")


def _collapse(least_length: int, least_periods: int):
    def run(batches):
        for whole in batches:
            for batch in by_bytes(whole):
                texts = batch.column("text")
                runs, collapsed = runs_of(large_text(texts, lower=False), least_length, least_periods)
                has = np.isin(np.arange(batch.num_rows), runs[:, 0])
                new = [t.as_py().decode() if h else old.as_py() for t, old, h in zip(collapsed, texts, has.tolist(), strict=True)]
                at = batch.schema.get_field_index("text")
                yield batch.set_column(at, batch.schema.field(at), pa.array(new, texts.type))

    return run


def collapse_runs(docs: DataFrame, least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """The rows of docs, all columns; in texts with runs the words after each run's first period are gone and those
    that stay are joined by one blank. Other texts, null ones too, are as they were."""
    given = docs.withColumn("text", F.col("text").cast("string"))
    return given.mapInArrow(_collapse(least_length, least_periods), given.schema)
