"""Subword ids of a public word-BPE vocabulary, for the distinct words of a batch.

The vocabulary's pipeline (compose, fold case, split off letters, digits and signs, merge inside each
piece) never looks across white space, so a text's ids are those of its words in a row, and a batch needs
each distinct word once. Words of ASCII and Latin-1 letters, signs and digits go through a byte-pair
merger that is given the same merges; all others through the tokenizer itself.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from tokenizers import Tokenizer

END = b"\x00"  # stands for the end of a piece; words that contain it are not plain
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+|\n")
PLAIN = "^[\\x21-\\x7EÀ-ÖØ-öø-ÿ]*$"


def _byte_letters() -> dict[str, int]:
    """The printable letters by which such vocabularies write bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    return letters | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


class WordEncoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        model = json.load(open(path, encoding="utf-8"))["model"]
        letters, suffix = _byte_letters(), model["end_of_word_suffix"]

        def raw(token: str) -> bytes:
            body, end = (token[: -len(suffix)], END) if token.endswith(suffix) and token != suffix else (token, b"")
            return bytes(letters[c] for c in body) + end

        # Ranks: bytes, each byte with the end of a piece, then the merges in their order.
        ranks = {bytes([b]): b for b in range(256)}
        ranks |= {bytes([b]) + END: 256 + b for b in range(256)}
        for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            ranks.setdefault(raw(a) + raw(b), len(ranks))
        self.separator = len(ranks)
        ranks[b"\n\n" + END] = self.separator
        ids = {raw(t): i for t, i in model["vocab"].items() if not t.startswith("<|")}
        self.ids = np.array([ids.get(t, -1) for t in ranks], np.int64)
        self.rows = None
        self.texts = [b""] * self.tokenizer.get_vocab_size()
        for t, i in model["vocab"].items():
            self.texts[i] = t.encode() if t.startswith("<|") else raw(t).removesuffix(END)
        self.merger = tiktoken.Encoding("words", pat_str="[^\\x00]+\\x00", mergeable_ranks=ranks, special_tokens={})

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and where each word's begin (one more than words)."""
        words = words.cast(pa.large_string())
        plain = pc.and_not(pc.match_substring_regex(words, PLAIN), pc.match_substring(words, "<|")).to_numpy(zero_copy_only=False)
        counts = np.zeros(len(words), np.int64)
        flat, flat_counts = self._merged(words.filter(pa.array(plain)))
        counts[plain] = flat_counts
        others = self.tokenizer.encode_batch_fast(words.filter(pa.array(~plain)).to_pylist(), add_special_tokens=False)
        counts[~plain] = [len(e.ids) for e in others]
        bounds = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(bounds[-1], np.int64)
        of_plain = np.repeat(plain, counts)
        out[of_plain] = flat
        out[~of_plain] = [i for e in others for i in e.ids]
        return out, bounds

    def pieces(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """What each id spells: as a list, and as bytes in a row with where each begins (one more than ids)."""
        if self.rows is None:
            self.rows = np.frombuffer(b"".join(self.texts), np.uint8), np.cumsum([0, *map(len, self.texts)])
        return self.texts, *self.rows

    def _merged(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pieces = PIECES.findall("\n".join(words.to_pylist()).lower() + "\n")
        text = "\x00".join(pieces) + "\x00"
        tokens = np.array(self.merger.encode_ordinary(text.replace("\n\x00", "\n\n\x00")), np.int64)
        ends = np.flatnonzero(tokens == self.separator)
        counts = np.diff(np.concatenate([[-1], ends])) - 1
        return self.ids[tokens[tokens != self.separator]], counts


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and vocabulary file."""
    return WordEncoder(path)


def gathered(values: np.ndarray, bounds: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of each code in a row, and how many each has."""
    counts = np.diff(bounds)[codes]
    total = int(counts.sum())
    begin = np.repeat(bounds[codes] - (np.cumsum(counts) - counts), counts)
    return values[begin + np.arange(total)], counts
