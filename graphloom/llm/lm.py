"""Language-model scoring of documents.

Two scores, both log10 probabilities of a text's words and its end:

* a base: word unigrams with add-one smoothing, from counts over all training documents;
* a model: causal self-attention over subword ids, written in numpy.

What the model predicts are symbols: a subword id and whether it begins a word, or the end of a text. So words
and their borders can be read off a row of symbols, and two texts have the same one only if their words differ
in ways the vocabulary folds (capitals beyond A-Z, composed letters). Such spellings share the mass of their
symbols: that of the symbols themselves, that with a capital first letter, and all others letter by letter, by the
corpus counts of the three kinds. So the probabilities of all texts sum to 1 at most.

A symbol's probability is that of its class, given all symbols before it in the window, times that of the symbol in
the class, given the symbol before it. The class comes from attention: windows of CONTEXT symbols overlap by
OVERLAP, masked attention is batched over windows, and each symbol is scored once. The attention starts from the
class bigrams of the corpus and learns what the rest of the window adds. The second factor is a bigram over the
INPUTS - 1 most frequent symbols (all others are one, split by their counts), smoothed by Kneser-Ney.

Each document is split and encoded once; slices of some megabytes of text are kept as arrays in a scratch
table, and all passes read those. All counts cover every training document, and so does gradient descent, which is
data-parallel: every task takes steps on all of its training documents and the weights are averaged, after a first
round over one slice a task. What reaches the driver is bounded by INPUTS and the vocabulary.

Word counts are shuffled as arrays: for each slice and range of word hashes one row, with which document holds
which word how often. Ranges are dealt again to salts by slice, so that a word of every slice is no large group.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import SPACED, by_bytes, hash_all, large_text, split_words
from graphloom.llm.subwords import encoder, gathered
from graphloom.plans.scratch import scratch

CONTEXT, OVERLAP, CLASSES, WIDTH, INPUTS = 32, 4, 64, 16, 4096
BUCKETS, CLUSTER_STEPS, DISCOUNT, UNSEEN = 64, 8, 0.6, 0.05
BATCH, RATE = 256, 0.01
SLICE_BYTES, RANGE_BYTES, SALT_SLICES = 4 << 20, 64 << 20, 4096
#: Shares are kept as whole numbers of this part of a log10, rounded to the smaller share
STEPS = 4096
#: Places among symbols: the end of a text, and a word without ids
END, NONE = -2, -1


# --- The model --------------------------------------------------------------------------------


@dataclass
class Tables:
    """What the counts say. Outputs are symbols by frequency, the last one stands for all rarer ones: of_symbol: the
    output of each symbol; rare: log10 share of each rarer symbol in that output; of_class: the class of each
    output; start: log probability of each class after each output; share: log10 of each output's share of its class
    after each output, in whole STEPS."""

    of_symbol: np.ndarray
    rare: np.ndarray
    of_class: np.ndarray
    start: np.ndarray
    share: np.ndarray

    @property
    def first(self) -> int:
        """What stands before a text: an end."""
        return int(self.of_symbol[END])


def clusters(profiles: np.ndarray, weights: np.ndarray, k: int, steps: int = CLUSTER_STEPS) -> np.ndarray:
    """k-means of rows with weights, from the heaviest rows that are far from those taken before."""
    rows = np.sqrt(profiles / np.maximum(profiles.sum(axis=1, keepdims=True), 1e-9))
    far = np.full(len(rows), np.inf)
    centres = []
    for _ in range(min(k, len(rows))):
        pick = int(np.argmax(np.where(np.isinf(far), weights, weights * far)))
        centres.append(rows[pick])
        far = np.minimum(far, ((rows - rows[pick]) ** 2).sum(axis=1))
    centres, label = np.array(centres), np.zeros(len(rows), np.int64)
    for _ in range(steps):
        label = np.argmin((centres**2).sum(axis=1) - 2 * rows @ centres.T, axis=1)
        mass = np.bincount(label, weights, len(centres))
        for d in range(rows.shape[1]):
            centres[:, d] = np.where(mass > 0, np.bincount(label, weights * rows[:, d], len(centres)) / np.maximum(mass, 1e-9), centres[:, d])
    return label


def outputs(counts: np.ndarray, inputs: int = INPUTS) -> tuple[np.ndarray, np.ndarray]:
    """of_symbol and rare, from the training counts of symbols. The end is always an output of its own."""
    order, end = np.argsort(-counts, kind="stable"), len(counts) + END
    order = np.concatenate([[end], order[order != end]])
    of_symbol = np.full(len(counts), inputs - 1, np.int64)
    of_symbol[order[: inputs - 1]] = np.arange(min(inputs - 1, len(order)))
    rare = of_symbol == inputs - 1
    return of_symbol, np.where(rare, np.log10((counts + 1.0) / max(1.0, (counts[rare] + 1.0).sum())), 0.0)


def tables(of_symbol: np.ndarray, rare: np.ndarray, place: np.ndarray, n: np.ndarray, classes: int = CLASSES, inputs: int = INPUTS) -> Tables:
    """place, n: training counts of pairs of outputs (the one before times inputs, plus the next)."""
    before, after = np.divmod(place, inputs)
    mass = np.bincount(after, n, inputs)
    own = classes // 2
    of_class = np.full(inputs, classes - 1, np.int64)
    of_class[np.argsort(-mass, kind="stable")[:own]] = np.arange(own)
    others = np.flatnonzero((of_class == classes - 1) & (mass > 0))
    profile = np.bincount(after * BUCKETS + before % BUCKETS, n, inputs * BUCKETS).reshape(inputs, BUCKETS)
    if len(others):
        of_class[others] = own + clusters(profile[others], mass[others], classes - own - 1)
    kinds, total = np.bincount(before, minlength=inputs), np.bincount(before, n, inputs)
    known = np.bincount(after, minlength=inputs) + UNSEEN
    known /= known.sum()
    by_class = np.argsort(of_class, kind="stable")
    edges = np.searchsorted(of_class[by_class], np.arange(classes))
    filled = np.append(edges[1:], inputs) > edges
    start, share = np.empty((inputs, classes), np.float32), np.empty((inputs, inputs), np.uint16)
    order = np.argsort(place, kind="stable")
    place, n = place[order], n[order]
    for low in range(0, inputs, 256):
        high = min(inputs, low + 256)
        some = slice(*np.searchsorted(place, [low * inputs, high * inputs]))
        p = np.zeros((high - low) * inputs)
        p[place[some] - low * inputs] = n[some] - DISCOUNT
        p = p.reshape(high - low, inputs) + (DISCOUNT * kinds[low:high, None]) * known
        p = np.where(total[low:high, None] > 0, p, known)
        p /= p.sum(axis=1, keepdims=True)
        sums = np.zeros((high - low, classes))
        sums[:, filled] = np.add.reduceat(p[:, by_class], edges[filled], axis=1)
        start[low:high] = np.log(np.maximum(sums, 1e-30))
        share[low:high] = np.minimum(np.ceil(-STEPS * np.log10(p / sums[:, of_class])), 65535)
    return Tables(of_symbol, rare, of_class, start, share)


def for_training(t: Tables) -> Tables:
    """What gradients need of the tables. Shares are by far the largest part, and each executor writes what is broadcast to
    its disk."""
    return replace(t, rare=np.zeros(0), share=np.zeros((0, 0), np.uint16))


def initial(width: int = WIDTH, classes: int = CLASSES, inputs: int = INPUTS, context: int = CONTEXT, seed: int = 5) -> dict[str, np.ndarray]:
    """q, k, v: a query, key and value for each input; near: what a distance adds to an attention; out: from the
    mixed values to the logits of classes, which is zero at first."""
    rng = np.random.default_rng(seed)
    w = {n: (rng.standard_normal((inputs, width)) * s).astype(np.float32) for n, s in (("q", 0.3), ("k", 0.3), ("v", 0.5))}
    return w | {"near": (-0.5 * np.arange(context)).astype(np.float32), "out": np.zeros((width, classes), np.float32)}


def _distances(near: np.ndarray, n: int) -> np.ndarray:
    """What each place adds to its attention on each other, and the mask: nothing is seen of what comes later."""
    apart = np.arange(n)[:, None] - np.arange(n)
    return np.where(apart >= 0, near[np.maximum(apart, 0)], np.float32(-1e9)).astype(np.float32)


def forward(w: dict, start: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, tuple]:
    """x: inputs, windows by places. The logits of the class after each place, and what the gradients need."""
    many, n = x.shape
    q, k, v = (w[name][x] for name in "qkv")
    a = (q * np.float32(q.shape[-1] ** -0.5)) @ k.transpose(0, 2, 1)
    a += _distances(w["near"], n)
    if a.max() > 60:
        a -= a.max(axis=-1, keepdims=True)
    np.exp(a, out=a)
    a /= (a @ np.ones(n, a.dtype))[:, :, None]
    mixed = (a @ v).reshape(many * n, -1)
    logits = mixed @ w["out"]
    logits += start[x.reshape(-1)]
    return logits, (x, q, k, v, a, mixed)


def _added(x: np.ndarray, g: np.ndarray, rows: int) -> np.ndarray:
    """The sums of the rows of g by x."""
    order = np.argsort(x.astype(np.uint16), kind="stable")
    at = np.flatnonzero(np.diff(x[order], prepend=-1))
    out = np.zeros((rows, g.shape[1]), np.float32)
    out[x[order[at]]] = np.add.reduceat(g[order], at, axis=0)
    return out


def gradients(w: dict, kept: tuple, d: np.ndarray) -> dict[str, np.ndarray]:
    """d: the gradient of the loss by the logits."""
    x, q, k, v, a, mixed = kept
    many, n = x.shape
    g = {"out": mixed.T @ d}
    dm = (d @ w["out"].T).reshape(many, n, -1)
    ds = dm @ v.transpose(0, 2, 1)
    dv = a.transpose(0, 2, 1) @ dm
    ds *= a
    ds -= a * (ds @ np.ones(n, ds.dtype))[:, :, None]
    scale = np.float32(q.shape[-1] ** -0.5)
    dq, dk = ds @ k, ds.transpose(0, 2, 1) @ q
    dq *= scale
    dk *= scale
    total = ds.sum(axis=0)
    g["near"] = np.zeros_like(w["near"])
    g["near"][:n] = [np.trace(total, -apart) for apart in range(n)]
    sums = _added(x.reshape(-1), np.concatenate([dq, dk, dv], axis=-1).reshape(many * n, -1), len(w["q"]))
    g |= dict(zip("qkv", np.split(sums, 3, axis=1), strict=True))
    return g


class Adam:
    def __init__(self, w: dict, rate: float = RATE):
        self.w, self.rate, self.step = {n: a.copy() for n, a in w.items()}, rate, 0
        self.m, self.s, self.part = ({n: np.zeros_like(a) for n, a in w.items()} for _ in range(3))

    def descend(self, start: np.ndarray, x: np.ndarray, y: np.ndarray, valid: np.ndarray, batch: int = BATCH) -> None:
        """A pass over windows: inputs x, classes y, and which places count."""
        for low in range(0, len(x), batch):
            d, kept = forward(self.w, start, x[low : low + batch])
            if d.max() > 60:
                d -= d.max(axis=1, keepdims=True)
            np.exp(d, out=d)
            on = valid[low : low + batch].reshape(-1).astype(np.float32)
            on /= max(1.0, on.sum())
            d *= (on / (d @ np.ones(d.shape[1], d.dtype)))[:, None]
            d[np.arange(len(d)), y[low : low + batch].reshape(-1)] -= on
            self.step += 1
            ahead = self.rate * math.sqrt(1 - 0.99**self.step) / (1 - 0.9**self.step)
            for n, g in gradients(self.w, kept, d).items():
                w, m, s, part = self.w[n], self.m[n], self.s[n], self.part[n]
                m *= 0.9
                np.multiply(g, 0.1, out=part)
                m += part
                s *= 0.99
                np.multiply(g, g, out=part)
                part *= 0.01
                s += part
                np.sqrt(s, out=part)
                part += 1e-6
                np.divide(m, part, out=part)
                part *= ahead
                w -= part


def windows_of(lengths: np.ndarray, context: int = CONTEXT, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows over texts of the given lengths: the text, the first symbol, how many symbols, and how many the
    first of them were scored by the window before."""
    step = context - overlap
    many = np.maximum(1, -(-(lengths - overlap) // step))
    doc = np.repeat(np.arange(len(lengths)), many)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    first = number * step
    return doc, first, np.minimum(context, lengths[doc] - first), np.where(number > 0, overlap, 0)


def window_arrays(out: np.ndarray, starts: np.ndarray, win: tuple, first_input: int, context: int = CONTEXT):
    """Places, inputs and scored places of windows over outputs. The input of a place is the output before it."""
    doc, first, size, skip = win
    place = np.arange(context)
    at = starts[doc][:, None] + first[:, None] + np.minimum(place, size[:, None] - 1)
    x = np.where((first[:, None] + place) == 0, first_input, out[np.maximum(at - 1, 0)])
    return at, x, (place < size[:, None]) & (place >= skip[:, None])


def class_logs(w: dict, t: Tables, out: np.ndarray, lengths: np.ndarray, batch: int = BATCH) -> np.ndarray:
    """log10 probability of the class of each output, given those before it: outputs in a row, lengths of the texts
    (at least 1)."""
    starts, win = np.cumsum(lengths) - lengths, windows_of(lengths)
    logs = np.empty(len(out))
    for low in range(0, len(win[0]), batch):
        at, x, valid = window_arrays(out, starts, tuple(a[low : low + batch] for a in win), t.first)
        logits, _ = forward(w, t.start, x)
        at, on = at.reshape(-1), valid.reshape(-1)
        hit = logits[np.arange(len(logits)), t.of_class[out[at]]]
        if logits.max() > 60:
            top = logits.max(axis=1)
            logits -= top[:, None]
            hit -= top
        each = hit - np.log(np.exp(logits, out=logits) @ np.ones(logits.shape[1], logits.dtype))
        logs[at[on]] = each[on]
    return logs / math.log(10)


def symbol_logs(w: dict, t: Tables, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 probability of each symbol, given those before it in its text."""
    out = t.of_symbol[symbols]
    before = np.concatenate([[t.first], out[:-1]])
    before[np.cumsum(lengths)[:-1]] = t.first
    return class_logs(w, t, out, lengths) - t.share[before, out] / STEPS + t.rare[symbols]


# --- Texts as symbols ---------------------------------------------------------------------------


class Symbols:
    """The words of some texts, and the symbols of each text: 2 * id + (1 if it begins a word), for a word
    without ids 2 * size + 1, and at the end of a text 2 * size."""

    def __init__(self, texts: pa.Array, tokenizer: str):
        self.words = split_words(large_text(texts, lower=True), SPACED)
        self.codes, self.distinct = self.words.encoded()
        coder = encoder(tokenizer)
        values, bounds = coder.encode(self.distinct)
        self.kinds, self.letters = spellings(self.distinct, values, bounds, coder)
        size = coder.tokenizer.get_vocab_size()
        # A word without ids has one symbol of its own.
        none = np.flatnonzero(np.diff(bounds) == 0)
        values = np.insert(values, bounds[none], size)
        bounds = bounds + np.concatenate([[0], np.cumsum(np.diff(bounds) == 0)])
        symbols = values * 2
        symbols[bounds[:-1]] += 1
        flat, counts = gathered(symbols, bounds, self.codes)
        edges = np.concatenate([[0], np.cumsum(counts)])[self.words.first]
        self.symbols, self.lengths = np.insert(flat, edges[1:], 2 * size).astype(np.int32), np.diff(edges) + 1


def spellings(words: pa.Array, values: np.ndarray, bounds: np.ndarray, coder) -> tuple[np.ndarray, np.ndarray]:
    """For each word its kind - 0: spelled as its ids are, 1: so but for a capital first letter, 2: otherwise - and
    its bytes and one more."""
    pieces, piece_bytes, piece_ends = coder.pieces()
    n = len(words)
    lengths = pc.binary_length(words).to_numpy().astype(np.int64)
    sizes = np.diff(piece_ends)[values]
    spelled = np.diff(np.concatenate([[0], np.cumsum(sizes)])[bounds])
    kinds = np.where(spelled == lengths, 0, 2)
    # Where lengths agree, compare the bytes.
    same = np.flatnonzero(kinds == 0)
    flat, counts = gathered(values, bounds, same)
    ours, _ = gathered(piece_bytes, piece_ends, flat)
    begin = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + n] if n else np.zeros(0, np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8) if n else np.zeros(0, np.uint8)
    edges = np.cumsum(lengths[same]) - lengths[same]
    theirs = data[np.repeat(begin[same] - edges, lengths[same]) + np.arange(len(ours))]
    if len(ours):
        kinds[same[np.logical_or.reduceat(ours != theirs, edges)]] = 2
    for i in np.flatnonzero(kinds).tolist():
        text = b"".join(pieces[x] for x in values[bounds[i] : bounds[i + 1]].tolist()).decode("utf-8", "replace")
        kinds[i] = 1 if text and text[:1].upper() != text[:1] and (text[:1].upper() + text[1:]).encode() == words[i].as_py() else 2
    return kinds, lengths + 1


def spelling_logs(counts: list[int]) -> np.ndarray:
    """log10 share of each kind of spelling, from the words of each kind in training texts."""
    return np.log10((np.array(counts, float) + [1, 0.01, 0.01]) / (sum(counts) + 1.02))


LETTER = math.log10(257)


# --- Spark --------------------------------------------------------------------------------------

def packed(values: np.ndarray, kind: str) -> bytes:
    """Whole numbers as bytes of a kind, first bytes first, compressed."""
    values = np.ascontiguousarray(values.astype(kind))
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), 1)


def unpacked(value: pa.Scalar, kind: str) -> np.ndarray:
    data = np.frombuffer(zstandard.decompress(value.as_buffer()), np.uint8)
    return np.ascontiguousarray(data.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


ENCODED = (
    "slice long, doc_id array<long>, learned array<boolean>, n_words array<int>, lengths array<int>, spelled array<array<int>>, ids binary, begins binary, "
    "range int, hashes binary, trained binary, holders binary, docs binary, uses binary"
)
SLICE_FIELDS, RANGE_FIELDS = ["doc_id", "learned", "n_words", "lengths", "spelled", "ids", "begins"], ["range", "hashes", "trained", "holders", "docs", "uses"]


def _slice_row(t: Symbols, batch: pa.RecordBatch) -> dict:
    """The texts of a slice as arrays. spelled: for each text its words of each kind, and the letters of kind 2."""
    doc = t.words.doc_of_word()
    kind = t.kinds[t.codes] if len(t.codes) else np.zeros(0, np.int64)
    n = batch.num_rows
    spelled = np.bincount(doc * 4 + kind, minlength=4 * n)[: 4 * n].reshape(n, 4)
    odd = kind == 2
    spelled[:, 3] = np.bincount(doc[odd], t.letters[t.codes[odd]] if odd.any() else None, n)
    return {
        "doc_id": batch.column("doc_id").to_pylist(), "learned": batch.column("learned").to_pylist(), "n_words": t.words.counts, "lengths": t.lengths, "spelled": spelled.tolist(),
        "ids": packed(t.symbols >> 1, "<u2"), "begins": packed(np.packbits((t.symbols & 1).astype(bool)), "u1"),
    }


def _range_rows(t: Symbols, batch: pa.RecordBatch, ranges: int):
    """For each range of word hashes: the words of the slice (sorted), how often each is in training texts, in how
    many texts it is, and those texts with how often each has it."""
    if not len(t.codes):
        return
    n = batch.num_rows
    h = hash_all(t.distinct)
    order = np.argsort(h)
    rank = np.empty(len(h), np.int64)
    rank[order] = np.arange(len(h))
    h, doc = h[order], t.words.doc_of_word().astype(np.int64)
    pair, uses = np.unique(rank[t.codes] * n + doc, return_counts=True)
    word, doc = np.divmod(pair, n)
    learned = batch.column("learned").to_numpy(zero_copy_only=False)
    trained, holders = np.bincount(word, uses * learned[doc], len(h)), np.bincount(word, minlength=len(h))
    edges = np.searchsorted((h >> np.uint64(32)).astype(np.int64) * ranges >> 32, np.arange(ranges + 1))
    ends = np.concatenate([[0], np.cumsum(holders)])
    for r in np.flatnonzero(np.diff(edges)):
        w, p = slice(edges[r], edges[r + 1]), slice(ends[edges[r]], ends[edges[r + 1]])
        yield {"range": int(r), "hashes": packed(h[w], "<u8"), "trained": packed(trained[w], "<u4"), "holders": packed(holders[w], "<u4"), "docs": packed(doc[p], "<u4"), "uses": packed(uses[p], "<u4")}


def _encode(tokenizer: str, ranges: int, slice_bytes: int):
    fields = {"slice": pa.int64(), "doc_id": pa.list_(pa.int64()), "learned": pa.list_(pa.bool_()), "n_words": pa.list_(pa.int32()), "lengths": pa.list_(pa.int32()), "spelled": pa.list_(pa.list_(pa.int32())), "ids": pa.binary(), "begins": pa.binary(), "range": pa.int32()}
    schema = pa.schema(list(fields.items()) + [(n, pa.binary()) for n in RANGE_FIELDS[1:]])

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in by_bytes(whole, most=slice_bytes):
                t = Symbols(batch.column("text"), tokenizer)
                rows = [_slice_row(t, batch), *_range_rows(t, batch, ranges)]
                yield pa.RecordBatch.from_arrays([pa.array([number if n == "slice" else r.get(n) for r in rows], k) for n, k in zip(schema.names, schema.types, strict=True)], schema=schema)
                number += 1

    return run


@dataclass
class Slice:
    """A slice read back: symbols, and lengths and marks of its texts."""

    symbols: np.ndarray
    lengths: np.ndarray
    learned: np.ndarray

    def training(self) -> tuple[np.ndarray, np.ndarray]:
        return self.symbols[np.repeat(self.learned, self.lengths)], self.lengths[self.learned]


def _slices(batches):
    for batch in batches:
        for row in range(batch.num_rows):
            ids, begins, lengths, learned = (batch.column(n)[row] for n in ("ids", "begins", "lengths", "learned"))
            ids = unpacked(ids, "<u2").astype(np.int64)
            symbols = ids * 2 + np.unpackbits(unpacked(begins, "u1"), count=len(ids))
            yield batch.column("slice")[row].as_py(), Slice(symbols, lengths.values.to_numpy().astype(np.int64), learned.values.to_numpy(zero_copy_only=False).astype(bool))


def _placed(total: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(total)
    return pa.RecordBatch.from_pydict({"place": at.astype(np.int64), "n": total[at].astype(np.int64)})


def _count_symbols(size: int):
    def run(batches):
        total = np.zeros(size, np.int64)
        for _, s in _slices(batches):
            total += np.bincount(s.training()[0], minlength=size)
        yield _placed(total)

    return run


def _count_pairs(shared):
    def run(batches):
        of_symbol = shared.value
        end = of_symbol[END]
        total = np.zeros(INPUTS * INPUTS, np.int32)
        for _, s in _slices(batches):
            symbols, lengths = s.training()
            out = of_symbol[symbols]
            before = np.concatenate([[end], out[:-1]]) if len(out) else out
            place = np.sort((before * INPUTS + out).astype(np.int32))  # before the first symbol stands an end
            at = np.flatnonzero(np.diff(place, prepend=-1))
            total[place[at]] += np.diff(at, append=len(place)).astype(np.int32)
        yield _placed(total)

    return run


def _train_part(shared, all_slices: bool):
    def run(batches):
        w, t = shared.value
        adam, trained = Adam(w), 0
        for number, s in _slices(batches):
            symbols, lengths = s.training()
            if len(lengths):
                out, starts = t.of_symbol[symbols], np.cumsum(lengths) - lengths
                win = windows_of(lengths, overlap=0)
                mixed = np.random.default_rng(number & 0xFFFFFFFF).permutation(len(win[0]))
                for low in range(0, len(mixed), 16 * BATCH):
                    at, x, valid = window_arrays(out, starts, tuple(a[mixed[low : low + 16 * BATCH]] for a in win), t.first)
                    adam.descend(t.start, x, t.of_class[out[at]], valid)
                trained += len(symbols)
                if not all_slices:
                    break
        for _ in batches:
            pass
        if trained:
            flat = np.concatenate([a.reshape(-1) for a in adam.w.values()]).astype(np.float64) * trained
            rows = [flat[i : i + 1024] for i in range(0, len(flat), 1024)]
            yield pa.RecordBatch.from_pydict({"place": pa.array(range(len(rows)), pa.int64()), "sums": pa.array(rows, pa.list_(pa.float64())), "parts": pa.array([trained] * len(rows), pa.int64())})

    return run


@dataclass
class Model:
    weights: dict[str, np.ndarray]
    tables: Tables


def _counts(rows: DataFrame, size: int) -> np.ndarray:
    found, out = rows.groupBy("place").agg(F.sum("n").alias("n")).toArrow(), np.zeros(size, np.int64)
    out[found.column("place").to_numpy()] = found.column("n").to_numpy()
    return out


def train(slices: DataFrame, tokenizer: str, rounds: int = 2) -> Model:
    """Learns from the training texts of all slices: the first round reads one slice of each partition, each further
    one all of them."""
    context = slices.sparkSession.sparkContext
    size = 2 * encoder(tokenizer).tokenizer.get_vocab_size() + 2
    counts = _counts(slices.mapInArrow(_count_symbols(size), "place long, n long"), size)
    of_symbol, rare = outputs(counts)
    pairs = slices.mapInArrow(_count_pairs(context.broadcast(of_symbol)), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()  # INPUTS * INPUTS rows at most
    t = tables(of_symbol, rare, pairs.column("place").to_numpy(), pairs.column("n").to_numpy())
    w, few = initial(), for_training(t)
    for number in range(rounds):
        steps = slices.mapInArrow(_train_part(context.broadcast((w, few)), number > 0), "place long, sums array<double>, parts long")
        sums = steps.select("place", F.posexplode("sums").alias("at", "x"), "parts").groupBy("place", "at").agg((F.sum("x") / F.sum("parts")).alias("x"))
        found = sums.orderBy("place", "at").select("x").toArrow().column("x").to_numpy()
        if not len(found):
            break
        edges = np.cumsum([a.size for a in w.values()])[:-1]
        w = {n: f.reshape(w[n].shape).astype(np.float32) for (n, f) in zip(w, np.split(found, edges), strict=True)}
    return Model(w, t)


def _score(shared):
    def run(batches):
        model = shared.value
        for number, s in _slices(batches):
            scores, ends = np.empty(len(s.lengths)), np.cumsum(s.lengths)
            low = 0
            while low < len(ends):  # some hundred thousand symbols at a time
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + (1 << 18))))
                own = slice(ends[low - 1] if low else 0, ends[high - 1])
                logs = symbol_logs(model.weights, model.tables, s.symbols[own], s.lengths[low:high])
                scores[low:high] = np.add.reduceat(logs, np.cumsum(s.lengths[low:high]) - s.lengths[low:high])
                low = high
            yield pa.RecordBatch.from_pydict({"slice": pa.array([number]), "model": pa.array([scores], pa.list_(pa.float64()))})

    return run


def _joined(t: pa.Table, name: str, kind) -> list[np.ndarray]:
    return [unpacked(x, kind) for x in t.column(name)]


def _summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[at], np.add.reduceat(n, at)


def _range_totals(t: pa.Table) -> pa.Table:
    """The words of a range that are in training texts, with their counts over all rows given."""
    h = np.concatenate(_joined(t, "hashes", np.uint64))
    width = "<u4" if "trained" in t.column_names else "<i8"
    h, n = _summed(h, np.concatenate(_joined(t, "trained" if width == "<u4" else "totals", width)).astype(np.int64))
    h, n = h[n > 0], n[n > 0]
    return pa.table({"range": pa.array([t.column("range")[0].as_py()], pa.int32()), "hashes": pa.array([packed(h, "<u8")], pa.binary()), "totals": pa.array([packed(n, "<i8")], pa.binary()), "n": pa.array([int(n.sum())]), "kinds": pa.array([len(h)])})


def _base_sums(rows: pa.Table, totals: pa.Table) -> pa.Table:
    """For each slice the sums over a range's words of log10(count + 1), and how many were seen, by text."""
    h, n = (np.concatenate([*_joined(totals, name, kind), np.zeros(0, kind)]) for name, kind in (("hashes", np.uint64), ("totals", "<i8")))
    out: dict[str, list] = {"slice": [], "docs": [], "logs": [], "known": []}
    columns = (rows.column("slice").to_pylist(), *(_joined(rows, name, kind) for name, kind in (("hashes", np.uint64), ("holders", "<u4"), ("docs", "<u4"), ("uses", "<u4"))))
    for number, words, holders, docs, uses in zip(*columns, strict=True):
        at = np.minimum(np.searchsorted(h, words), max(0, len(h) - 1))
        c = np.where(h[at] == words, n[at], 0) if len(h) else np.zeros(len(words), np.int64)
        c = np.repeat(c, holders)
        some, back = np.unique(docs, return_inverse=True)
        out["slice"].append(number)
        out["docs"].append(some.astype(np.int32))
        out["logs"].append(np.bincount(back, uses * np.log10(c + 1.0), len(some)))
        out["known"].append(np.bincount(back, uses * (c > 0), len(some)).astype(np.int64))
    return pa.table({"slice": pa.array(out["slice"], pa.int64()), "docs": pa.array(out["docs"], pa.list_(pa.int32())), "logs": pa.array(out["logs"], pa.list_(pa.float64())), "known": pa.array(out["known"], pa.list_(pa.int64()))})


def _slice_sums(t: pa.Table) -> pa.Table:
    docs, logs, known = (t.column(c).combine_chunks().flatten().to_numpy() for c in ("docs", "logs", "known"))
    order = np.argsort(docs, kind="stable")  # in a fixed order, whatever order the ranges came in
    order = order[np.lexsort((logs[order], docs[order]))]
    logs, known = np.bincount(docs[order], logs[order]), np.bincount(docs[order], known[order])
    return pa.table({"slice": t.column("slice").slice(0, 1), "logs": pa.array([logs], pa.list_(pa.float64())), "known": pa.array([known.astype(np.int64)], pa.list_(pa.int64()))})


def score_documents(docs: DataFrame, learned, tokenizer: str, slice_bytes: int = SLICE_BYTES, rounds: int = 2) -> DataFrame:
    """Scores every document with models of those for which the condition learned holds.

    Returns doc_id, learned, n_tokens (words and the end), n_known (tokens seen in training), train_tokens,
    base_score and score. A-Z are folded; a null text is empty, so its only token is the end. Repeated rows
    and null ids are scored like any other (a null condition: not learned from); other columns are
    ignored. Without training text every token is unknown.
    """
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(learned, F.lit(False)).alias("learned"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ranges = max(1, math.ceil(size / RANGE_BYTES))
    salts = max(1, math.ceil(size / slice_bytes / SALT_SLICES))
    encoded = scratch(rows.mapInArrow(_encode(tokenizer, ranges, slice_bytes), ENCODED))
    slices = encoded.where("range IS NULL").select("slice", *SLICE_FIELDS)
    arrays = slices.select("slice", "ids", "begins", "lengths", "learned")

    salt = F.pmod(F.xxhash64("slice"), F.lit(salts)).cast("int").alias("salt")
    by_range = encoded.where("range IS NOT NULL").select("slice", salt, *RANGE_FIELDS)
    part = "range int, hashes binary, totals binary, n long, kinds long"
    totals = by_range.select("range", "salt", "hashes", "trained").groupBy("range", "salt").applyInArrow(_range_totals, part)
    totals = scratch(totals.select("range", "hashes", "totals").groupBy("range").applyInArrow(_range_totals, part))
    N, V = (x or 0 for x in totals.agg(F.sum("n"), F.sum("kinds")).first())
    every = totals.select("range", "hashes", "totals", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    sums = by_range.groupBy("range", "salt").cogroup(every.groupBy("range", "salt")).applyInArrow(_base_sums, "slice long, docs array<int>, logs array<double>, known array<long>")
    base = sums.groupBy("slice").applyInArrow(_slice_sums, "slice long, logs array<double>, known array<long>")

    model = train(arrays, tokenizer, rounds)
    scored = arrays.mapInArrow(_score(context.broadcast(model)), "slice long, model array<double>")
    learners = slices.select(F.explode(F.arrays_zip("learned", "spelled")).alias("d")).where("d.learned")
    of_kinds = learners.agg(F.count("*"), *[F.sum(F.col("d.spelled")[k]) for k in range(3)]).first()
    ends, kinds = of_kinds[0], [int(x or 0) for x in of_kinds[1:]]
    N, V = N + ends, V + (ends > 0)

    meta = slices.select("slice", "doc_id", "learned", "n_words", "spelled")
    joined = meta.join(scored, "slice").join(base, "slice", "left")
    each = joined.select(F.posexplode(F.arrays_zip("doc_id", "learned", "n_words", "spelled", "model")).alias("at", "d"), "logs", "known").select("d.*", F.get("logs", "at").alias("logs"), F.get("known", "at").alias("known"))
    spelling = spelling_logs(kinds)
    spelled = sum((F.col("spelled")[k] * float(spelling[k]) for k in range(3)), F.lit(0.0)) - F.col("spelled")[3] * LETTER
    tokens = (F.col("n_words") + 1).cast("long")
    return each.select(
        "doc_id",
        "learned",
        tokens.alias("n_tokens"),
        (F.coalesce("known", F.lit(0)) + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(N).cast("long").alias("train_tokens"),
        (F.coalesce("logs", F.lit(0.0)) + F.log10(F.lit(ends + 1.0)) - tokens * F.log10(F.lit(N + V + 1.0))).alias("base_score"),
        (F.col("model") + spelled).alias("score"),
    )
