"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary, and every single byte, so each word can be segmented.
Each language has a probability for each piece. The probability of a word is the sum over all its
segmentations of the product of its pieces' probabilities, which a forward pass over the word computes;
the probabilities are learned by expectation maximisation with the matching backward pass. A text's
log-probability is the sum over its words.

Training reads at most SAMPLE_DOCS documents of a language, and of languages the LANGUAGES most frequent. Scoring
segments each distinct word of a slice once, for all languages together, and needs no shuffle. Words of up to
MATRIX bytes go through the passes together, by length; longer ones (scripts without blanks) one by one, with
the sums kept as logarithms.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import byte_class, by_bytes, large_text, mix, split_words, with_text

SAMPLE_DOCS, LANGUAGES, ROUNDS, SMOOTHING = 400, 256, 4, 0.1
MATRIX = 64
#: A factor for each byte that keeps products of probabilities in range over MATRIX bytes
PER_BYTE = 500.0
#: ASCII letters and all bytes of other characters
LETTERS = byte_class([(0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
START, BASE = 0x5F, np.uint64(0x100000001B3)


@dataclass
class Vocabulary:
    """Pieces by hash. Pieces 0 to 255 are the bytes."""

    hashes: np.ndarray
    numbers: np.ndarray
    lengths: np.ndarray

    @property
    def size(self) -> int:
        return len(self.lengths)

    @property
    def longest(self) -> int:
        return int(self.lengths.max())

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == hashes, self.numbers[at], -1)


def _hash_bytes(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for column in rows.T:
        h = (h + column + np.uint64(1)) * BASE
    return mix(h)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {bytes([b]) for b in range(256)}
    for i in range(model.get_piece_size()):
        text = model.id_to_piece(i).replace("▁", chr(START)).encode()
        body = np.frombuffer(text.removeprefix(b"_"), np.uint8)
        if len(text) > 1 and LETTERS[body].all() and not ((body >= 65) & (body <= 90)).any():
            pieces.add(text)
    ordered = sorted(pieces, key=lambda p: (len(p), p))
    hashes = np.concatenate([_hash_bytes(np.array([list(p) for p in ordered if len(p) == n], np.uint64)) for n in sorted({len(p) for p in ordered})])
    order = np.argsort(hashes)
    return Vocabulary(hashes[order], order.astype(np.int64), np.array([len(p) for p in ordered], np.int64))


def _groups(words: list[bytes], most: int = 20_000):
    """Words of the same length of up to MATRIX bytes, as a matrix of bytes, with their numbers."""
    lengths = np.array([len(p) for p in words], np.int64)
    for n in np.unique(lengths[lengths <= MATRIX]):
        same = np.flatnonzero(lengths == n)
        for low in range(0, len(same), most):
            rows = same[low : low + most]
            yield rows, np.frombuffer(b"".join(words[r] for r in rows.tolist()), np.uint8).reshape(-1, n).astype(np.uint64)


def _piece_table(vocab: Vocabulary, matrix: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """The piece from each place to each later one (no entry: there is none in any row)."""
    table, n = {}, matrix.shape[1]
    for begin in range(n):
        h = np.zeros(len(matrix), np.uint64)
        for end in range(begin + 1, min(n, begin + vocab.longest) + 1):
            h = (h + matrix[:, end - 1] + np.uint64(1)) * BASE
            ids = vocab.lookup(mix(h))
            if (ids >= 0).any():
                table[begin, end] = ids
    return table


def _scaled(vocab: Vocabulary, prob: np.ndarray) -> np.ndarray:
    """prob: a row for each piece (the last is 0, for none) and a column for each language."""
    return prob * np.append(PER_BYTE**vocab.lengths.astype(float), 0.0)[:, None]


def _forward(table, n: int, rows: int, scaled: np.ndarray) -> list[np.ndarray]:
    alpha = [np.zeros((rows, scaled.shape[1])) for _ in range(n + 1)]
    alpha[0] += 1
    for begin, end in sorted(table):
        alpha[end] += alpha[begin] * scaled[table[begin, end]]
    return alpha


def _pieces_of(vocab: Vocabulary, word: bytes) -> list[tuple[int, int, int]]:
    """The pieces in a word: where they begin and end, and which; by their beginnings."""
    data = np.frombuffer(word, np.uint8).astype(np.uint64)
    found, h = [], np.zeros(len(data), np.uint64)
    for size in range(1, min(vocab.longest, len(data)) + 1):
        h = (h[: len(data) - size + 1] + data[size - 1 :] + np.uint64(1)) * BASE
        ids = vocab.lookup(mix(h))
        at = np.flatnonzero(ids >= 0)
        found += zip(at.tolist(), (at + size).tolist(), ids[at].tolist(), strict=True)
    return sorted(found)


def _log_forward(pieces: list, n: int, log_prob: np.ndarray) -> np.ndarray:
    alpha = np.full((n + 1, log_prob.shape[1]), -np.inf)
    alpha[0] = 0
    for begin, end, piece in pieces:
        alpha[end] = np.logaddexp(alpha[end], alpha[begin] + log_prob[piece])
    return alpha


def log_probabilities(vocab: Vocabulary, words: pa.Array, prob: np.ndarray) -> np.ndarray:
    """log P of each word, with a mark before it, under each language."""
    marked = [bytes([START]) + w for w in words.to_pylist()]
    out, scaled = np.zeros((len(words), prob.shape[1])), _scaled(vocab, prob)
    for rows, matrix in _groups(marked):
        n = matrix.shape[1]
        out[rows] = np.log(_forward(_piece_table(vocab, matrix), n, len(rows), scaled)[n]) - n * np.log(PER_BYTE)
    for i, w in enumerate(marked):
        if len(w) > MATRIX:
            out[i] = _log_forward(_pieces_of(vocab, w), len(w), np.log(prob[:-1]))[-1]
    return out


def learn(vocab: Vocabulary, words: pa.Array, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of each language (a column), by expectation maximisation. counts: of each word in each language."""
    marked = [bytes([START]) + w for w in words.to_pylist()]
    groups = [(rows, matrix.shape[1], _piece_table(vocab, matrix)) for rows, matrix in _groups(marked)]
    long = [(i, len(w), _pieces_of(vocab, w)) for i, w in enumerate(marked) if len(w) > MATRIX]
    prob = np.full((vocab.size + 1, counts.shape[1]), 1.0 / vocab.size)
    prob[-1] = 0
    for _ in range(rounds):
        expected, scaled, log_prob = np.full_like(prob, SMOOTHING), _scaled(vocab, prob), np.log(prob[:-1])
        for rows, n, table in groups:
            alpha = _forward(table, n, len(rows), scaled)
            beta = [np.zeros_like(alpha[0]) for _ in range(n + 1)]
            beta[n] += counts[rows] / alpha[n]
            for begin, end in sorted(table, reverse=True):
                ids = table[begin, end]
                through = scaled[ids] * beta[end]
                beta[begin] += through
                for language in range(counts.shape[1]):
                    expected[:, language] += np.bincount(ids % (vocab.size + 1), alpha[begin][:, language] * through[:, language], vocab.size + 1)
        for i, n, pieces in long:
            alpha = _log_forward(pieces, n, log_prob)
            beta = np.full_like(alpha, -np.inf)
            beta[n] = 0
            for begin, end, piece in reversed(pieces):
                through = log_prob[piece] + beta[end]
                beta[begin] = np.logaddexp(beta[begin], through)
                expected[piece] += counts[i] * np.exp(alpha[begin] + through - alpha[n])
        expected[-1] = 0
        prob = expected / expected.sum(axis=0)
    return prob


@dataclass
class Model:
    vocabulary_path: str
    languages: list[str]
    prob: np.ndarray


def fit(texts: list[str | None], langs: list[str], vocabulary_path: str) -> Model:
    languages = sorted(set(langs))
    vocab = vocabulary(vocabulary_path)
    words = split_words(large_text(pa.array(texts, pa.string()), lower=True), LETTERS)
    codes, distinct = words.encoded()
    number = np.array([languages.index(x) for x in langs], np.int64)
    place = codes * len(languages) + number[words.doc_of_word()] if len(codes) else np.zeros(0, np.int64)
    counts = np.bincount(place, minlength=len(distinct) * len(languages)).reshape(len(distinct), -1) if languages else np.zeros((0, 0))
    return Model(vocabulary_path, languages, learn(vocab, distinct, counts.astype(float)) if languages else np.zeros((vocab.size + 1, 0)))


def train(docs: DataFrame, vocabulary_path: str, wanted=None, sample_docs: int = SAMPLE_DOCS, languages: int = LANGUAGES) -> Model:
    """Learns from at most sample_docs documents of each language, chosen by a hash of doc_id, and of the most
    frequent languages. Rows with a null lang are left out. wanted: a condition on doc_id for rows that may be
    learned from."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang IS NOT NULL")
    rows = rows.where(wanted) if wanted is not None else rows
    common = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).select("lang")
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(13)), "doc_id")
    keys = rows.select("doc_id", "lang").join(F.broadcast(common), "lang", "left_semi").withColumn("n", F.row_number().over(first)).where(F.col("n") <= sample_docs)
    chosen = keys.select("doc_id").distinct()  # sample_docs * languages rows at most
    found = rows.join(F.broadcast(chosen), "doc_id", "left_semi").join(F.broadcast(common), "lang", "left_semi").select("text", "lang")
    sample = sorted(map(tuple, found.collect()), key=str)
    return fit([t for t, _ in sample], [x for _, x in sample], vocabulary_path)


def identify(texts: pa.LargeStringArray, model: Model) -> tuple[list[str], np.ndarray]:
    """The most likely language of each text and its posterior probability; und and 0 without a letter."""
    lettered = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
    if not model.languages:
        return ["und"] * len(texts), np.zeros(len(texts))
    words = split_words(pc.ascii_lower(texts), LETTERS)
    codes, distinct = words.encoded()
    by_word = log_probabilities(vocabulary(model.vocabulary_path), distinct, model.prob)
    total = np.zeros((len(texts), len(model.languages)))
    for language in range(len(model.languages)):
        total[:, language] = np.diff(np.concatenate([[0.0], np.cumsum(by_word[:, language][codes])])[words.first])
    best = total.argmax(axis=1)
    score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    names = [model.languages[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
    return names, np.where(lettered, score, 0.0)


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, all columns, with lang_pred and lang_score. Null texts and texts without a letter are
    und with score 0; ties go to the first language by name. Columns of these names go; each row is judged by
    its text alone, so repeated rows and null ids are rows like any other."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.drop("lang_pred", "lang_score")
    given, text, added = with_text(rows)

    def run(batches):
        for whole in batches:
            for batch in by_bytes(whole, text):
                names, scores = identify(large_text(batch.column(text), lower=False), shared.value)
                yield batch.drop_columns(added).append_column("lang_pred", pa.array(names, pa.string())).append_column("lang_score", pa.array(scores, pa.float64()))

    schema = rows.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("lang_score")).schema
    return given.mapInArrow(run, schema)
