"""Quality rules, ranked search and runs against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import common, quality, runs, search
from graphloom.llm.common import split_words
from tests.llm.conftest import AWKWARD, fold, table

SPACED = "[^\x20\x09-\x0d]+"
ALNUM = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def some_texts(seed, n=60):
    rng = random.Random(seed)
    words = ["a", "bé", "c|c", "dd", "ee", "İx", "f#"]
    out = []
    for i in range(n):
        few = words[: rng.randrange(1, len(words) + 1)]
        part = [rng.choice(few) for _ in range(rng.randrange(0, 30))]
        text = " ".join(part * rng.randrange(1, 5))
        lines = ["\n".join([text[:9]] * rng.randrange(1, 4)), text, "same line\nsame line ", "\n\n", text]
        out.append((100 + i, rng.choice([" ", "\n"]).join(rng.sample(lines, rng.randrange(1, 5)))))
    return out


# --- Quality rules ------------------------------------------------------------------------------


def plain_quality(text):
    text = text or ""
    w = re.findall(SPACED, text)
    out = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text))}
    seen, lines = set(), [x for x in text.split("\n") if re.search(SPACED, x)]
    out |= {"n_lines": len(lines), "n_dup_lines": 0, "dup_line_chars": 0}
    for x in lines:
        if x in seen:
            out["n_dup_lines"] += 1
            out["dup_line_chars"] += sum(map(len, re.findall(SPACED, x)))
        seen.add(x)
    for n in sorted({8, *quality.NGRAM_PERCENT}):
        grams = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
        many, before, repeat, later = Counter(grams), set(), set(), set()
        for i, g in enumerate(grams):
            repeat |= set(range(i, i + n)) if many[g] > 1 else set()
            later |= set(range(i, i + n)) if g in before else set()
            before.add(g)
        if n == 8:
            out["n_repeat_words"] = len(repeat)
        if n in quality.NGRAM_PERCENT:
            out[f"dup{n}_chars"] = sum(len(w[i]) for i in later)
    out["base_failed"] = len(w) < 20 or 100 * out["n_repeat_words"] > 30 * len(w)
    good = 100 * out["dup_line_chars"] <= quality.LINE_CHAR_PERCENT * out["word_chars"]
    good &= all(100 * out[f"dup{n}_chars"] <= k * out["word_chars"] for n, k in quality.NGRAM_PERCENT.items())
    out["kept"] = good and not out["base_failed"]
    return out


def test_repetition_against_plain_counts(spark, documents):
    rows = AWKWARD + some_texts(1) + [(None, "x y z " * 20), (None, None)] + documents[:60]
    got = quality.repetition(table(spark, rows)).collect()
    want = sorted((repr(i), sorted(plain_quality(t).items())) for i, t in rows)
    assert sorted((repr(r.doc_id), sorted((c, v) for c, v in r.asDict().items() if c != "doc_id")) for r in got) == want


def test_windows_of_other_texts_do_not_count(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = quality.repetition(table(spark, [(i, text) for i in range(50)])).collect()
    assert all(r.kept and r.dup5_chars == 0 and r.n_repeat_words == 0 for r in rows)


def test_words_of_one_hash_are_told_apart():
    words = split_words(pa.array(["a b c d e f g h a b c d e f g x"], pa.large_string()), common.SPACED)
    codes, _ = words.encoded()
    same = np.ones(len(words), np.uint64)  # all words share a hash
    found = quality.repeated_windows(words, codes, same, words.doc_of_word(), 7)
    assert found.starts.tolist() == [0, 8] and found.later.tolist() == [False, True]


def test_drop_repetitive_keeps_rows_whole(spark):
    rows = AWKWARD + some_texts(2)
    docs = table(spark, rows)
    kept = quality.drop_repetitive(docs)
    assert kept.schema == docs.schema
    assert sorted(map(repr, kept.collect())) == sorted(repr(r) for r in docs.collect() if plain_quality(r.text)["kept"])
    assert quality.drop_repetitive(docs, but=docs.doc_id > 0).count() == len(rows)
    assert quality.drop_repetitive(docs.where("false")).count() == quality.repetition(docs.where("false")).count() == 0


# --- Runs -----------------------------------------------------------------------------------------


def plain_runs(w, least_length, least_periods):
    found = {}
    for q in range(1, len(w) // least_periods + 1):
        at = 0
        while at + q < len(w):
            if w[at] != w[at + q]:
                at += 1
                continue
            start = at
            while at + q < len(w) and w[at] == w[at + q]:
                at += 1
            if at + q - start >= max(least_length, least_periods * q):
                found.setdefault((start, at + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("seed", range(40))
def test_all_runs_of_small_texts(seed):
    rng = random.Random(seed)
    for _ in range(25):
        texts = [[rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.randrange(40))] for _ in range(rng.randrange(1, 5))]
        if rng.random() < 0.5:
            texts = [x * rng.randrange(1, 5) + x[: rng.randrange(len(x) + 1)] for x in texts]
        first = np.cumsum([0, *map(len, texts)])
        codes = np.array([c for x in texts for c in x], np.int64)
        want = sorted((i, s, n, q) for i, x in enumerate(texts) for s, n, q in plain_runs(x, 2, 2))
        assert sorted(map(tuple, runs.find_runs(codes, first).tolist())) == want


def test_runs_of_long_and_fibonacci_texts():
    a, b = [0], [0, 1]
    while len(b) < 2000:
        a, b = b, b + a
    long = [0] * 5000 + [1, 2, 3] * 4000 + [7] + [1, 2, 3] * 4000
    for text in (b, [*b, 3, *b]):
        assert [tuple(r[1:]) for r in runs.find_runs(np.array(text), np.array([0, len(text)])).tolist()] == sorted(plain_runs(text, 2, 2), key=lambda r: (r[0], r[2]))
    assert runs.find_runs(np.array(long), np.array([0, len(long)]), 6, 4).tolist() == [[0, 0, 5000, 1], [0, 5000, 12000, 3], [0, 17001, 12000, 3]]


def test_periodic_runs_against_plain_runs(spark, documents):
    rows = AWKWARD + some_texts(3) + [(None, "x y " * 9)] + [d for d in documents[:60] if len(d[1] or "") < 20_000]
    docs = table(spark, rows)
    got = sorted(map(tuple, runs.periodic_runs(docs).collect()), key=repr)
    want, texts, every = [], [], []
    for i, text in rows:
        w = re.findall(SPACED, text or "")
        found = sorted(plain_runs(w, 6, 4), key=lambda r: (r[0], r[2]))
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        collapsed = plain_collapsed(w, found)
        want.append((i, len(found), *best, 1000 * best[1] // best[2] if found else None, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, collapsed))))
        texts.append((i, collapsed if found else text))
        every += [(i, *r) for r in found]
    assert got == sorted(want, key=repr)
    assert sorted(map(tuple, runs.list_runs(docs).collect()), key=repr) == sorted(every, key=repr)
    out = runs.collapse_runs(docs)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(texts, key=repr)
    assert runs.periodic_runs(docs.where("false")).count() == runs.collapse_runs(docs.where("false")).count() == 0


# --- Search ---------------------------------------------------------------------------------------


def plain_search(docs, items, k):
    held = [(i, Counter(re.findall(ALNUM, fold(t)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, words, df = len(held), sum(sum(c.values()) for _, c in held), Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * n // words
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, q in Counter(re.findall(ALNUM, fold(text))).items() if t in c)
            scores += [(-score, i is None, i or 0)] if score > 0 else []
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def ranked(found):
    return sorted((tuple(r)[:4] for r in found.collect()), key=repr)


def test_search_against_plain_scores(spark, documents, monkeypatch):
    rows = AWKWARD + some_texts(4) + [(None, "one two a")] + documents
    items = [(1, "one two THREE three"), (2, None), (3, "..."), (4, "nowhere atall"), (5, "a a a dd word"), (6, "ée the of and"), (6, "seven eight"), *((10 + j, t[:200]) for j, (_, t) in enumerate(documents[:20]))]
    docs, asked = table(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    want = plain_search(rows, items, 5)
    index = search.build_index(docs)
    found = search.search(index, asked, 5)
    assert ranked(found) == want
    assert {r.tier for r in found.select("tier").distinct().collect()} - {search.TIERS - 1}, "no item was proven early"
    monkeypatch.setattr(search, "BLOCK_TERMS", 40)
    monkeypatch.setattr(search, "CELLS", 7)
    assert ranked(search.search(index, asked, 5)) == want


def test_search_of_one_hot_term_and_of_nothing(spark):
    rows = [(i, "hot " * (1 + i % 3) + ("rare" if i == 77 else "")) for i in range(300)]
    docs, asked = table(spark, rows), spark.createDataFrame([(1, "hot rare hot"), (2, "hot")], "item_id long, text string")
    index = search.build_index(docs)
    assert ranked(search.search(index, asked, 20)) == plain_search(rows, [(1, "hot rare hot"), (2, "hot")], 20)
    assert search.search(index, asked.where("false"), 20).count() == 0
    assert search.search(search.build_index(docs.where("false")), asked, 20).count() == 0


def test_every_row_is_indexed(spark, documents):
    index = search.build_index(table(spark, documents))
    terms = sum(len(set(re.findall(ALNUM, fold(t)))) for _, t in documents)
    assert index.terms.agg({"docs": "sum"}).first()[0] == terms
    assert index.postings.selectExpr("sum(" + "+".join(f"size(tier{t})" for t in range(search.TIERS)) + ")").first()[0] == terms
