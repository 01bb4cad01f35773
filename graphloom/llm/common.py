"""What the operators of this subpackage share: word tables over Arrow text.

Text columns are handled as UTF-8 bytes. All word rules used here are rules on bytes (every byte of
0x80 and above belongs to a word), so one numpy pass over an Arrow buffer splits a whole batch.
"""

from __future__ import annotations

import ctypes
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

MASK64 = (1 << 64) - 1
C_LIBRARY = ctypes.CDLL(None)


def byte_class(delimiters: list[tuple[int, int]]) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    for low, high in delimiters:
        table[low : high + 1] = False
    return table


#: `[^\x20\x09-\x0D]+`
SPACED = byte_class([(0x09, 0x0D), (0x20, 0x20)])
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, on text whose A-Z are in lower case
ALNUM = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])


def large_text(column: pa.Array | pa.ChunkedArray, lower: bool) -> pa.LargeStringArray:
    """The column as one array without nulls (null: empty), A-Z in lower case if asked."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.chunked_array([c.cast(pa.large_string()) for c in column.chunks], pa.large_string()).combine_chunks()
    # The copy matters: ascii_lower is wrong on a cast slice, whose bytes don't begin at its buffer's start.
    column = pa.concat_arrays([pc.fill_null(column.cast(pa.large_string()), "")])
    return pc.ascii_lower(column) if lower else column


@dataclass
class Words:
    """The words of some texts. Word i is bytes[offsets[i]:offsets[i+1]]; text d has words first[d]:first[d+1]."""

    bytes: np.ndarray
    offsets: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1, dtype=np.int32), self.counts)

    def encoded(self) -> tuple[np.ndarray, pa.Array]:
        """Each word's place in the list of distinct words, and that list (binary)."""
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(self.offsets), pa.py_buffer(self.bytes)])
        coded = words.dictionary_encode()
        return coded.indices.to_numpy(), coded.dictionary

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same on every machine."""
        codes, distinct = self.encoded()
        return hash_all(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)


def hash_all(words: pa.LargeBinaryArray) -> np.ndarray:
    """A 64-bit hash of each word: of up to 64 bytes by a polynomial in them, all words at once, of longer ones by XXH3."""
    n = len(words)
    if not n or words.buffers()[2] is None:
        return np.zeros(n, np.uint64)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + n + 1]
    data, offsets = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]
    lengths, out = np.diff(offsets), np.zeros(n, np.uint64)
    place = np.minimum(np.arange(len(data)) - np.repeat(offsets[:-1], lengths), 64)
    terms = mix(data.astype(np.uint64) + np.uint64(1)) * POWERS[place]
    full = lengths > 0
    out[full] = np.add.reduceat(terms, offsets[:-1][full]) if full.any() else 0
    out = mix(out + lengths.astype(np.uint64))
    for i in np.flatnonzero(lengths > 64).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[offsets[i] : offsets[i + 1]].tobytes())
    return out


def split_words(texts: pa.LargeStringArray, table: np.ndarray) -> Words:
    """Splits the texts into words, the longest runs of bytes for which the table holds."""
    n = len(texts)
    if n == 0 or texts.buffers()[1] is None:
        return Words(np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(n + 1, np.int64))
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    inside = table[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    at = bounds[:-1][bounds[:-1] < len(data)]
    starts[at] = inside[at]
    places = np.flatnonzero(starts)
    kept = data[inside]
    offsets = np.append(np.flatnonzero(starts[inside]), len(kept)).astype(np.int64)
    return Words(kept, offsets, np.searchsorted(places, bounds).astype(np.int64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


POWERS = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(64, 0x9E3779B97F4A7C15, np.uint64)]))


def rolling(h: np.ndarray, k: int, base: int) -> np.ndarray:
    """A hash of each run of k numbers: one value per start that leaves room for k."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, taken, power, width, power_step = np.zeros(n, np.uint64), 0, 1, 1, base
    step = h
    while True:
        if k & width:
            out += step[taken : taken + n] * np.uint64(power)
            power = power * power_step & MASK64
            taken += width
        if width * 2 > k:
            return mix(out)
        step = step[:-width] + step[width:] * np.uint64(power_step)
        power_step = power_step * power_step & MASK64
        width *= 2


BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def inside_docs(first: np.ndarray, n_starts: int, k: int) -> np.ndarray:
    """Whether the run of k words from each start lies in one text."""
    ok = np.ones(max(n_starts, 0), bool)
    # The last k-1 starts of every text but the last reach into the next one.
    ends = first[1:-1]
    for back in range(1, k):
        at = ends - back
        at = at[(at >= 0) & (at < n_starts)]
        ok[at] = False
    return ok


def to_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def as_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def sliced(batch: pa.RecordBatch, rows: int = 65536):
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


#: What a task works on at a time. The tables of a slice take some tens of bytes for each byte of text.
SLICE_BYTES = 1 << 20


def give_back() -> None:
    """Freed memory goes back to the system, so that the Python workers of an executor don't keep their peaks."""
    pa.default_memory_pool().release_unused()
    if hasattr(C_LIBRARY, "malloc_trim"):
        C_LIBRARY.malloc_trim(0)


def by_bytes(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES):
    """Slices of the batch whose texts take at most so many bytes together; a longer text is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    low = 0
    while low < len(ends):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + most, side="right")))
        yield batch.slice(low, high - low)
        low = high
        give_back()


# --- Spark side -------------------------------------------------------------------------------


def fresh(df: DataFrame, name: str) -> str:
    """The name, or a longer one where the table has a column of that name (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_text(docs: DataFrame) -> tuple[DataFrame, str, list[str]]:
    """The table with its text as a string column, the name of that column, and it again in a list if it was added."""
    if isinstance(docs.schema["text"].dataType, StringType):
        return docs, "text", []
    name = fresh(docs, "text_string")
    return docs.withColumn(name, F.col("text").cast("string")), name, [name]


def row_key(docs: DataFrame) -> Column:
    """A hash of the whole row. Rows that share it and doc_id are the same row, there more than once."""
    kinds = {f.name: f.dataType for f in docs.schema}
    return F.xxhash64(*[F.to_json(F.struct(f"`{c}`")) if isinstance(k, MapType) or "map<" in k.simpleString() else F.col(f"`{c}`") for c, k in kinds.items()])


def rows_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The documents, all columns, that are among kept (doc_id, row: their row_key, n: how many rows have both);
    of rows that are the same in every column, one. kept is read twice, so it should be a written table."""
    doc, row = fresh(docs, "kept_doc"), fresh(docs, "kept_row")
    tagged = docs.withColumns({doc: F.col("doc_id").cast("long"), row: row_key(docs)})
    keys = kept.select(F.col("doc_id").alias("k"), F.col("row").alias("r"))
    found = tagged.join(keys, tagged[doc].eqNullSafe(keys["k"]) & (tagged[row] == keys["r"]), "left_semi")
    if not kept.where("n > 1").isEmpty():
        found = found.dropDuplicates([doc, row])
    return found.drop(doc, row)


def block_count(docs: DataFrame, block_bytes: int) -> int:
    """How many blocks of about block_bytes of text the documents make; it grows with the input."""
    total = docs.agg(F.sum(F.octet_length("text").cast("long") + 32)).first()[0] or 0
    return max(1, math.ceil(total / block_bytes))
