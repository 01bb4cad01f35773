"""Bounded-space online packing of token sequences.

Every partition keeps OPEN windows. A document's ids are cut into full windows and a rest; the rest goes to
the open window it fits best. If it fits none, the fullest is emitted - topped up with the head of the rest
if more than SLACK places are free - and the rest is placed again, in a new window at last. What is open at
the end of a partition is merged: those pieces are dealt to as many tasks as their tokens need and laid end
to end, so each of these tasks leaves one window that isn't full.
"""

from __future__ import annotations

import bisect
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import SPACED, by_bytes, large_text, split_words
from graphloom.llm.subwords import encoder, gathered
from graphloom.plans.scratch import scratch

CONTEXT, OPEN, SLACK, END_ID, MERGE_WINDOWS = 2048, 32, 32, 1, 256

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, crc long, ids array<int>, open boolean"
FIELDS = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "crc", "ids", "open"]


class Packer:
    """Open windows of a partition. A window is its number and its pieces (doc, start, length, ids)."""

    def __init__(self, context: int, slots: int, slack: int, first: int):
        self.context, self.slots, self.slack, self.next = context, slots, slack, first
        self.gaps: list[tuple[int, int]] = []  # (free places, window), sorted
        self.windows: dict[int, list] = {}
        self.done: list[tuple[int, list]] = []

    def add(self, doc: tuple, ids: np.ndarray) -> None:
        full = len(ids) - len(ids) % self.context
        for at in range(0, full, self.context):
            self.done.append((self._number(), [(doc, at, ids[at : at + self.context])]))
        if full < len(ids):
            self._place(doc, full, ids[full:])

    def _number(self) -> int:
        self.next += 1
        return self.next - 1

    def _place(self, doc: tuple, start: int, ids: np.ndarray) -> None:
        at = bisect.bisect_left(self.gaps, (len(ids), -1))
        if at < len(self.gaps):
            self._fill(at, doc, start, ids)
        elif len(self.gaps) < self.slots:
            window = self._number()
            self.windows[window] = []
            bisect.insort(self.gaps, (self.context, window))
            self._place(doc, start, ids)
        else:
            gap, window = self.gaps[0]
            if gap > self.slack:
                self._fill(0, doc, start, ids[:gap])
                self._place(doc, start + gap, ids[gap:])
            else:
                self._emit(0)
                self._place(doc, start, ids)

    def _fill(self, at: int, doc: tuple, start: int, ids: np.ndarray) -> None:
        gap, window = self.gaps.pop(at)
        self.windows[window].append((doc, start, ids))
        bisect.insort(self.gaps, (gap - len(ids), window))
        if gap == len(ids):
            self._emit(0)

    def _emit(self, at: int) -> None:
        _, window = self.gaps.pop(at)
        self.done.append((window, self.windows.pop(window)))

    def take(self) -> list[tuple[int, list]]:
        done, self.done = self.done, []
        return done


def _rows(windows: list[tuple[int, list]], is_open: bool, with_ids: bool) -> pa.RecordBatch:
    columns: dict[str, list] = {f: [] for f in FIELDS}
    for window, pieces in windows:
        offset = 0
        for (doc, tokens), start, ids in pieces:
            row = doc, start, len(ids), tokens, window, offset, zlib.crc32(ids.astype("<u4").tobytes()), ids if with_ids else None, is_open
            for name, value in zip(FIELDS, row, strict=True):
                columns[name].append(value)
            offset += len(ids)
    kinds = [pa.int64()] * 7 + [pa.list_(pa.int32()), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(columns[f], k) for f, k in zip(FIELDS, kinds, strict=True)], names=FIELDS)


def _pack(tokenizer: str, context: int, slots: int, with_ids: bool):
    def run(batches):
        words_to_ids = encoder(tokenizer)
        packer = Packer(context, slots, SLACK, TaskContext.get().partitionId() << 32)
        end = np.array([END_ID], np.int32)
        for whole in batches:
            for batch in by_bytes(whole):
                words = split_words(large_text(batch.column("text"), lower=False), SPACED)
                codes, distinct = words.encoded()
                values, bounds = words_to_ids.encode(distinct)
                values = values.astype(np.int32)
                docs = batch.column("doc_id").to_pylist()
                for low in range(0, len(docs), 512):
                    first = words.first[low : low + 513]
                    flat, counts = gathered(values, bounds, codes[first[0] : first[-1]])
                    edges = np.concatenate([[0], np.cumsum(counts)])[first - first[0]]
                    for doc, s, e in zip(docs[low : low + 512], edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                        ids = np.concatenate([flat[s:e], end])
                        packer.add((doc, len(ids)), ids)
                    yield _rows(packer.take(), False, with_ids)
        yield _rows(sorted(packer.windows.items()), True, True)

    return run


def _merge(context: int, with_ids: bool):
    def run(batches):
        parts = list(batches)
        if not parts:
            return
        t = pa.Table.from_batches(parts).sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        number, room, pieces = (1 << 62) + (TaskContext.get().partitionId() << 32), context, []
        for doc, start, tokens, ids in zip(*(t.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")), strict=True):
            ids = np.array(ids, np.int32)
            while len(ids):
                pieces.append(((doc, tokens), start, ids[:room]))
                start, ids, room = start + min(room, len(ids)), ids[room:], room - min(room, len(ids))
                if not room:
                    yield _rows([(number, pieces)], False, with_ids)
                    number, room, pieces = number + 1, context, []
        if pieces:
            yield _rows([(number, pieces)], False, with_ids)

    return run


def pack_documents(docs: DataFrame, tokenizer: str, context: int = CONTEXT, slots: int = OPEN, with_ids: bool = True) -> DataFrame:
    """Packs the documents' ids into sequences of at most context ids; a row for each piece.

    A document is its subword ids and END_ID, so an empty or null text is END_ID alone. Returns doc_id,
    start, length, ids_crc32 (of the little-endian 32-bit ids), doc_tokens, sequence_id, offset, and ids if
    asked for. Rows with repeated or null ids are packed like any other; other columns are ignored.
    tokenizer: path of the vocabulary file, there on every executor.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = scratch(texts.mapInArrow(_pack(tokenizer, context, slots, with_ids), PIECES))
    rest = found.where("open")
    tokens = rest.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, math.ceil(tokens / (context * MERGE_WINDOWS)))
    merged = rest.repartition(tasks, "sequence_id").mapInArrow(_merge(context, with_ids), PIECES)
    out = found.where("NOT open").union(merged)
    return out.select("doc_id", "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)
