"""The operators against SQL, brute force, round trips and held-out accuracy."""

import itertools
import math
import os
import pickle
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from graphloom.llm import decontaminate, exact_dedup, langid, licenses, lm, packing, sharding, simhash, substring_dedup, toxicity
from graphloom.llm.queries import QUERIES, SQL
from pyspark.sql import functions as F
from tests.llm.conftest import AWKWARD, SF, fold, table

WORD_BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
SPACED, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def held(doc_id, divisor, remainder=0):
    return zlib.crc32(str(doc_id).encode()) % divisor == remainder


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = QUERIES[name](spark, SF)
    wanted = con.execute(SQL[name])
    names = [d[0] for d in wanted.description]
    assert sorted(names) == sorted(found.columns)
    assert sorted(map(str, (tuple(r) for r in found.select(*names).collect()))) == sorted(map(str, wanted.fetchall()))


def bench_table(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def every_operator(spark, docs):
    """Row counts of all operators over one table."""
    labels = spark.createDataFrame([(5, 1), (6, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    bench = bench_table(spark, [(1, "one two three"), (2, None), (3, ""), (None, "日本語")])
    return {
        "lm": lm.score_documents(docs, F.col("doc_id") != 6, WORD_BPE, rounds=1),
        "shards": sharding.shard_documents(docs, 4),
        "substring": substring_dedup.remove_repeats(docs),
        "exact": exact_dedup.exact_groups(docs),
        "bench": decontaminate.contamination(docs, bench),
        "language": langid.with_language(docs, langid.train(docs, PIECES)),
        "toxic": toxicity.with_toxicity(docs, toxicity.train(docs, labels)),
        "simhash": simhash.near_components(docs),
        "licenses": licenses.license_scan(docs),
    }


def plain_repeats(rows):
    first, out = {}, []
    words = {i: SPACED.findall(t or "") for i, t in rows}
    for i, w in words.items():
        for p in range(len(w) - 12):
            g = tuple(w[p : p + 13])
            first[g] = min(i, first.get(g, i))
    for i, w in words.items():
        gone = {q for p in range(len(w) - 12) if first[tuple(w[p : p + 13])] < i for q in range(p, p + 13)}
        out.append((i, len(w), len(gone), " ".join(x for q, x in enumerate(w) if q not in gone)))
    return sorted(out)


def test_repeats_against_plain_search(spark, documents):
    """Small blocks, and anchors with so few places hot that all paths are taken."""
    rng = np.random.default_rng(6)
    phrase = [f"p{i}" for i in range(40)]
    rows = documents[:120] + [(10_000 + i, " ".join([*(f"w{x}" for x in rng.integers(0, 50, rng.integers(0, 30))), *phrase[a : a + n], *(f"v{x}" for x in rng.integers(0, 9, 20))])) for i, (a, n) in enumerate(zip(rng.integers(0, 25, 150), rng.integers(8, 40, 150), strict=True))]
    rows += [(20_000, "a " * 50), (20_001, "a " * 14), (20_002, "b " * 13), (20_003, None), (20_004, "")]
    wanted = plain_repeats(rows)
    for bound in ({}, {"block_bytes": 20_000}, {"block_bytes": 20_000, "hot": 3}, {"hot": 0}):
        found = substring_dedup.remove_repeats(table(spark, rows), with_text=True, **bound).select("doc_id", "n_words", "n_removed", "kept_text").collect()
        assert sorted(map(tuple, found)) == wanted, bound


def test_awkward_rows_are_kept(spark):
    for name, found in every_operator(spark, table(spark, AWKWARD)).items():
        assert sorted(r.doc_id for r in found.select("doc_id").collect()) == sorted(i for i, _ in AWKWARD), name


def test_empty_tables_give_empty_results(spark):
    docs = table(spark, AWKWARD).limit(0)
    for name, found in every_operator(spark, docs).items():
        assert found.count() == 0, name
    assert packing.pack_documents(docs, WORD_BPE).count() == 0


def test_null_ids_do_not_crash(spark):
    docs = table(spark, [(None, "a b c d e"), (None, None), (1, "a b c d e")])
    for name, found in every_operator(spark, docs).items():
        assert found.count() == 3, name


def test_base_score_is_add_one_unigrams(spark, documents):
    tokens = {i: SPACED.findall(fold(t)) + [None] for i, t in documents}
    counts = Counter(w for i, ws in tokens.items() if not held(i, 7, 2) for w in ws)
    n, v = sum(counts.values()), len(counts)
    rows = QUERIES["op1_lm_score"](spark, SF).collect()
    assert len(rows) == len(documents)
    for r in rows:
        ws = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(counts[w] > 0 for w in ws), n, held(r.doc_id, 7, 2))
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)


def test_model_beats_the_base_on_held_out_rows(spark):
    """Needs text to learn from: below some 3 million training words the base's free mass for unknown words wins."""
    out = QUERIES["op1_lm_score"](spark, "/root/testdata/sf0.1").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


@pytest.fixture(scope="module")
def small_model(spark, documents):
    """A model of half of the small table."""
    rows = spark.createDataFrame([(i, t, i % 2 == 0) for i, t in documents], "doc_id long, text string, learned boolean").repartition(3)
    slices = rows.mapInArrow(lm._encode(WORD_BPE, 1, 1 << 18), lm.ENCODED).where("range IS NULL").select("slice", "ids", "begins", "lengths", "learned").cache()
    return lm.train(slices, WORD_BPE)


def plain_scores(model, texts, kinds=(900, 30, 10)):
    t = lm.Symbols(lm.pa.array(texts, lm.pa.string()), WORD_BPE)
    logs = lm.symbol_logs(model.weights, model.tables, t.symbols, t.lengths)
    each = lm.spelling_logs(list(kinds))[t.kinds] - np.where(t.kinds == 2, t.letters * lm.LETTER, 0.0)
    words = np.concatenate([[0.0], np.cumsum(each[t.codes] if len(t.codes) else [])])[t.words.first]
    return np.add.reduceat(logs, np.cumsum(t.lengths) - t.lengths) + np.diff(words)


def test_probabilities_of_all_next_symbols_sum_to_one(small_model):
    t = small_model.tables
    for before in ([], [2 * 320 + 1], [2 * 320 + 1, 1000, 7], list(range(1, 80, 2))):
        size = len(t.of_symbol)
        symbols = np.concatenate([np.tile(np.array(before, np.int64), (size, 1)), np.arange(size)[:, None]], axis=1)
        logs = lm.symbol_logs(small_model.weights, t, symbols.reshape(-1), np.full(size, len(before) + 1)).reshape(size, -1)
        assert 0.99 < np.power(10.0, logs[:, -1]).sum() <= 1 + 1e-5


@pytest.mark.parametrize("letters, longest", [("ab' ", 6), ("eéÉ ", 5), ("t.s\u00a0 ", 5)])
def test_probabilities_of_all_short_texts_sum_to_at_most_one(small_model, letters, longest):
    texts = {" ".join("".join(x).split(" ")).strip(" ") for n in range(longest + 1) for x in itertools.product(letters, repeat=n)}
    texts = sorted({" ".join(w for w in x.split(" ") if w) for x in texts})
    scores = plain_scores(small_model, texts)
    assert 0 < np.power(10.0, scores).sum() <= 1


def test_texts_that_share_ids_have_scores_of_their_own(small_model):
    a, b, c, d = plain_scores(small_model, ["don't stop", "don 't stop", "a.b", "a .b"])
    assert a != b and c != d
    plain, capital = plain_scores(small_model, ["étude", "Étude"])
    assert capital < plain


def test_each_symbol_is_scored_once():
    rng = np.random.default_rng(2)
    lengths = np.concatenate([[1, 2, lm.CONTEXT - 1, lm.CONTEXT, lm.CONTEXT + 1, 2 * lm.CONTEXT - lm.OVERLAP], rng.integers(1, 300, 50)])
    starts = np.cumsum(lengths) - lengths
    for overlap in (0, lm.OVERLAP):
        at, x, valid = lm.window_arrays(np.arange(lengths.sum()), starts, lm.windows_of(lengths, overlap=overlap), -1)
        assert np.array_equal(np.sort(at[valid]), np.arange(lengths.sum()))
        assert np.array_equal(x[valid], np.where(np.isin(at[valid], starts), -1, at[valid] - 1))


def test_nothing_later_is_seen(small_model):
    t = lm.Symbols(lm.pa.array(["one two three four five six"]), WORD_BPE)
    other = t.symbols.copy()
    other[-2] = 77
    a, b = (lm.symbol_logs(small_model.weights, small_model.tables, s, t.lengths) for s in (t.symbols, other))
    assert np.allclose(a[:-2], b[:-2]) and not np.allclose(a[-2:], b[-2:])


def test_gradients_against_differences():
    rng = np.random.default_rng(1)
    w = {n: a.astype(np.float64) for n, a in lm.initial(width=4, classes=5, inputs=9, context=6).items()}
    w["out"] = rng.standard_normal(w["out"].shape)
    start, x, y = rng.standard_normal((9, 5)), rng.integers(0, 9, (3, 6)), rng.integers(0, 5, 18)

    def loss(w):
        logits, kept = lm.forward(w, start, x)
        p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
        return -np.log(p[np.arange(18), y]).sum(), p, kept

    _, d, kept = loss(w)
    d[np.arange(18), y] -= 1
    g = lm.gradients(w, kept, d)
    for name, a in w.items():
        at = tuple(rng.integers(0, n) for n in a.shape)
        moved = [{**w, name: a + step * (np.arange(a.size).reshape(a.shape) == np.ravel_multi_index(at, a.shape))} for step in (1e-3, -1e-3)]
        assert g[name][at] == pytest.approx((loss(moved[0])[0] - loss(moved[1])[0]) / 2e-3, rel=2e-2, abs=2e-4), name


def test_every_training_document_gives_a_gradient(monkeypatch):
    steps = []
    monkeypatch.setattr(lm.Adam, "descend", lambda self, start, x, y, valid: steps.append(int(valid.sum())))
    counts = np.ones(2 * Tokenizer.from_file(WORD_BPE).get_vocab_size() + 2)
    of_symbol, rare = lm.outputs(counts)
    shared = type("Shared", (), {"value": (lm.initial(), lm.tables(of_symbol, rare, np.array([0]), np.array([1])))})
    for n in (1, 15, 16, 100):
        steps.clear()
        texts = lm.pa.RecordBatch.from_pydict({"doc_id": list(range(n)), "text": ["one two " * i for i in range(n)], "learned": [i % 3 != 2 for i in range(n)]})
        rows = [b for b in _in_task(lm._encode(WORD_BPE, 1, 200), [texts])]
        batches = [b.filter(lm.pa.compute.is_null(b.column("range"))) for b in rows]
        wanted = sum(len(Tokenizer.from_file(WORD_BPE).encode("one two " * i, add_special_tokens=False).ids) + 1 for i in range(n) if i % 3 != 2)
        list(lm._train_part(shared, True)(iter(batches)))
        assert sum(steps) == wanted


def test_what_training_broadcasts_is_small(spark, documents, monkeypatch):
    """Each executor writes what is broadcast to its disk, so only the scores get the table of shares, once."""
    sizes, rounds = [], 3
    context = type(spark.sparkContext)
    broadcast = context.broadcast
    monkeypatch.setattr(context, "broadcast", lambda self, value: (sizes.append(len(pickle.dumps(value))), broadcast(self, value))[1])
    docs = spark.createDataFrame(list(documents)[:20], "doc_id long, text string")
    assert lm.score_documents(docs, F.lit(True), WORD_BPE, rounds=rounds).count() == 20
    large = lm.INPUTS * lm.INPUTS * 2
    assert len(sizes) == rounds + 2 and max(sizes) > large and sum(sizes) < 1.5 * large


def _in_task(run, batches):
    from unittest import mock

    with mock.patch.object(lm, "TaskContext") as context:
        context.get.return_value.partitionId.return_value = 0
        return list(run(iter(batches)))


def test_scores_of_the_query_are_those_of_plain_symbols(spark):
    """Slices of any size give the same base, and the model's score is the sum over symbols and spellings."""
    docs = table(spark, AWKWARD)
    one, many = ({(r.doc_id, r.n_tokens): r for r in lm.score_documents(docs, F.lit(True), WORD_BPE, slice_bytes=b, rounds=1).collect()} for b in (1 << 22, 64))
    assert one.keys() == many.keys()
    for k, r in one.items():
        assert (r.n_known, r.train_tokens) == (many[k].n_known, many[k].train_tokens) and r.base_score == pytest.approx(many[k].base_score, rel=1e-9) and r.score < 0


def test_shards_are_even_and_gapless(spark, documents):
    rows = QUERIES["op2_sharding"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in documents)
    text = dict(documents)
    slots, loads = defaultdict(list), Counter()
    for r in rows:
        data = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        slots[r.shard].append(r.slot)
        loads[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(loads.values()) - min(loads[s] for s in range(16)) <= 2 * max(r["size"] for r in rows)


def test_shards_of_one_hot_text(spark):
    found = sharding.shard_documents(table(spark, [(i, "same text") for i in range(400)] + [(i, f"text {i}") for i in range(400, 800)]), 4)
    assert {r["count"] for r in found.groupBy("shard").count().collect()} <= set(range(150, 251))


def test_licenses_against_plain_search(spark, documents):
    rows = {r.doc_id: r for r in QUERIES["op9_licenses"](spark, SF).collect()}
    for i, t in documents:
        words = ALNUM.findall(fold(t))
        hits = [(p, label) for phrase, label in licenses.PHRASES.items() for p in range(len(words)) if words[p : p + len(phrase.split())] == phrase.split()]
        r = rows[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(hits), ",".join(sorted({x for _, x in hits})))
        assert (r.first_word, r.last_word) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))


def test_licenses_in_other_words(spark):
    """One word replaced, put in or left out in each notice of eight words or more, and in long texts one in sixteen."""
    rows, wanted = [], {}
    for text, label in [*licenses.NOTICES.items(), *licenses.TEXTS.items()]:
        w = text.split()
        if len(w) < licenses.PER_CHANGE:
            continue
        places = range(5, len(w) - 2, 40)
        for how in ("replaced", "put in", "left out"):
            new = [y for i, x in enumerate(w) for y in ([x] if i not in places else {"replaced": ["zzz"], "put in": ["zzz", x], "left out": []}[how])]
            wanted[len(rows)] = label
            rows.append((len(rows), "x " * 50 + " ".join(new) + ", y" * 9))
    rows += [(-1, "permission granted"), (-2, "free software is free and this software is subject to the license")]
    found = {r.doc_id: (r.base_labels, r.labels.split(","), r.score) for r in licenses.license_scan(table(spark, rows)).collect()}
    assert [i for i, label in wanted.items() if label not in found[i][1] or not 0 < found[i][2] <= 1] == []
    assert found[-1] == found[-2] == ("", [""], 0.0)
    kelvin = licenses.license_scan(table(spark, [(1, "under the MİT license"), (2, "UNDER the MIT K license"), (3, "UNDER THE MIT LICENSE")])).orderBy("doc_id").collect()
    assert [k.base_labels for k in kelvin] == ["", "", "mit"]


def test_language_on_held_out_rows(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op6_language"](spark, "/root/testdata/sf0.01").collect()
    assert all(0 <= r.score <= 1 and r.held_out == held(r.doc_id, 5) for r in rows)
    out = [r for r in rows if r.held_out and lang[r.doc_id] is not None]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in out]) > 0.9


def test_toxicity_on_held_out_rows(spark):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = QUERIES["op7_toxicity"](spark, "/root/testdata/sf0.01").collect()
    out = [r for r in rows if r.held_out and r.doc_id in toxic]
    assert all(r.predicted == int(r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted == toxic[r.doc_id] for r in out]) > 0.9


def test_words_are_summed_over_all_segmentations():
    """Every segmentation listed, of short words and of one that is longer than a matrix takes."""
    vocab = langid.vocabulary(PIECES)
    words = ["the", "straße", "日本", "x"]
    prob = np.random.default_rng(8).random((vocab.size + 1, 2)) / vocab.size
    got = langid.log_probabilities(vocab, langid.pa.array([w.encode() for w in words], langid.pa.binary()), prob)

    def total(word, language):
        if not word:
            return 1.0
        pieces = {e: i for b, e, i in langid._pieces_of(vocab, word) if b == 0}
        return sum(prob[i, language] * total(word[e:], language) for e, i in pieces.items())

    for w, row in zip(words, got, strict=True):
        assert row.tolist() == pytest.approx([math.log(total(b"_" + w.encode(), k)) for k in (0, 1)])
    assert vocab.longest > 12 and {len(w.encode()) for w in words} == {3, 7, 6, 1}


def test_long_words_are_summed_like_short_ones(monkeypatch):
    vocab = langid.vocabulary(PIECES)
    prob = np.random.default_rng(9).random((vocab.size + 1, 3)) / vocab.size
    words = langid.pa.array([("lichungenverdonaudampf" * k).encode() for k in (1, 2)] + ["日本語の文章です".encode() * 2], langid.pa.binary())
    counts = np.ones((3, 3))
    short, learned = langid.log_probabilities(vocab, words, prob), langid.learn(vocab, words, counts, 2)
    monkeypatch.setattr(langid, "MATRIX", 4)
    assert np.allclose(langid.log_probabilities(vocab, words, prob), short) and np.allclose(langid.learn(vocab, words, counts, 2), learned)
    assert np.isfinite(langid.log_probabilities(vocab, langid.pa.array([b"\xe6\x97" * 20_000]), prob)).all()


def _labelled(sf, where=""):
    con = duckdb.connect()
    at = f"/root/testdata/{sf}"
    files = {t: f"{at}/{t}.parquet" if sf.startswith("sf") else f"{at}/{t}.parquet/*.parquet" for t in ("documents", "labels")}
    return con.execute(f"SELECT doc_id, lang, toxic, text FROM '{files['documents']}' JOIN '{files['labels']}' USING (doc_id) {where} ORDER BY hash(doc_id), doc_id").fetchall()


def _judged(rows):
    """A model fitted as the query fits it on the rows of a table, and the held-out rows with its judgement."""
    learned, apart = ([r for r in rows if held(r[0], 5) == k] for k in (False, True))
    learned = [r for r in learned if r[2] == 1][: toxicity.TOXIC_DOCS] + [r for r in learned if r[2] == 0][: toxicity.ORDINARY_DOCS]
    model = toxicity.fit([r[3] for r in learned], [r[2] for r in learned])
    said = [x for low in range(0, len(apart), 500) for x in (model.scores(toxicity.large_text(toxicity.pa.array([r[3] for r in apart[low : low + 500]]), lower=True)) >= 0.5).tolist()]
    return model, [(r, x) for r, x in zip(apart, said, strict=True)]


@pytest.fixture(scope="module")
def small_judged():
    return _judged(_labelled("sf0.1"))


def test_toxic_recall_on_few_labels(small_judged):
    """sf0.1 has 359 toxic rows to learn from, 221 of them English: enough for English words only (README)."""
    out = small_judged[1]
    assert np.mean([x for r, x in out if r[2] == 1 and r[1] == "en"]) >= 0.8
    assert np.mean([x for r, x in out if r[2] == 0]) < 0.01


@pytest.mark.skipif(not os.path.isdir("/root/testdata/check_s"), reason="needs a table with thousands of labels")
def test_toxic_recall_of_each_language_on_held_out_rows():
    out = _judged(_labelled("check_s"))[1]
    recall = {k: np.mean([x for r, x in out if r[2] == 1 and r[1] == k]) for k in ("en", "de", "fr", "es")}
    assert min(recall.values()) >= 0.85, recall
    assert np.mean([x for r, x in out if r[2] == 0]) < 0.01


def test_scores_are_compression_distances_of_all_windows(small_judged):
    """Whole texts scored again word by word in plain Python."""
    model, out = small_judged
    ordinary, toxic = (toxicity.compressor(d + model.common) for d in (model.ordinary, model.toxic))
    texts = [r[3] for r, _ in out[:40]] + ["", None, "one", "1 2 3", "idiot " * 30, "ÄÖ ß日本 x" * 40]
    got = model.scores(toxicity.large_text(toxicity.pa.array(texts), lower=True))
    for text, score in zip(texts, got, strict=True):
        words, weight = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", fold(text)), []
        starts = [s for s in range(0, len(words), toxicity.STEP) if s == 0 or s + toxicity.WINDOW - toxicity.STEP < len(words)]
        for s in starts:
            window = f" {' '.join(words[s : s + toxicity.WINDOW])} ".encode()
            d = len(ordinary.compress(window)) - len(toxic.compress(window))
            weight.append(model.weights[max(-toxicity.FURTHEST - 1, min(toxicity.FURTHEST + 1, d)) + toxicity.FURTHEST + 1])
        total = sum(weight) / (1 + len(weight) / toxicity.PER_WINDOWS)
        assert score == pytest.approx(total / (total + model.threshold), abs=1e-9)


def test_without_labels_of_both_kinds_nothing_is_toxic():
    for texts, labels in (([], []), (["a b"], [1]), (["a b"], [0]), (["", ""], [0, 1]), (["a", "b"], [0, 1])):
        assert toxicity.fit(texts, labels).scores(toxicity.large_text(toxicity.pa.array(["a b", ""]), lower=True)).tolist() == [0.0, 0.0]


def test_packing_round_trip(spark, documents):
    rows = packing.pack_documents(spark.read.parquet(f"{SF}/documents.parquet"), WORD_BPE).collect()
    plain = Tokenizer.from_file(WORD_BPE)
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        pieces[r.doc_id].append((r.start, r.ids))
        windows[r.sequence_id].append((r.offset, r.length))
    for i, t in documents:
        got = [x for _, ids in sorted(pieces[i]) for x in ids]
        assert got == plain.encode(t or "", add_special_tokens=False).ids + [1]
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r.length for r in rows) / (2048 * len(windows)) > 0.9


def test_decontamination_cuts_spans_only(spark):
    bench = bench_table(spark, [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda")])
    rows = [(1, "Before. Alpha, beta gamma delta epsilon zeta eta theta iota kappa; after"), (2, "alpha beta gamma"), (3, None), (4, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda!")]
    found = {r.doc_id: r.text for r in decontaminate.decontaminate(table(spark, rows), bench).collect()}
    assert found == {1: "Before. ; after", 2: "alpha beta gamma", 3: None}


def test_decontamination_in_blocks_is_the_same(spark, documents):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    one, many = (decontaminate.with_hits(docs.select("doc_id", "text"), bench, block_bytes=b) for b in (8 << 20, 4 << 10))
    spans = lambda df: {r.doc_id: decontaminate._merged(r.firsts, r.ends) for r in df.collect()}
    assert spans(one) == spans(many)


def test_exact_dedup_with_a_weak_digest(spark):
    docs = table(spark, [(1, "A"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "À"), (7, "à")])
    found = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(docs, digest=lambda c: F.lit("x")).collect()}
    assert found == {1: (3, 2), 3: (3, 2), 2: (2, 1), 4: (5, 2), 5: (5, 2), 6: (6, 1), 7: (7, 1)}
    assert sorted(r.doc_id for r in exact_dedup.exact_dedup(docs).collect()) == [2, 3, 5, 6, 7]


def test_pipeline_against_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        steps[name] = [tuple(r) for r in now.select("doc_id", "text").collect()]
        now = stage(spark, now, SF)
    best = {}
    for i, t in steps["exact dedup"]:
        best[fold(t)] = max(i, best.get(fold(t), i))
    assert sorted(best.values()) == sorted(i for i, _ in steps["near dedup"])
    ids = {i for i, _ in steps["near dedup"]}
    groups = simhash.near_components(spark.createDataFrame(steps["near dedup"], "doc_id long, text string")).collect()
    assert {r.component_id for r in groups} == {i for i, _ in steps["decontamination"]} <= ids
    packed = {r.doc_id for r in now.collect()}
    assert packed == {i for i, _ in steps["packing"]}
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scored = toxicity.with_toxicity(docs, model).collect()
    assert {r.doc_id for r in scored if r.toxicity < 0.5} == {i for i, _ in steps["exact dedup"]}


def test_all_eleven_are_registered():
    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
