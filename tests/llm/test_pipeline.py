"""The pipeline's stages, and the operators of op2 and op10, on rows that are hard to handle."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from graphloom.llm import decontaminate, exact_dedup, langid, packing, sharding, simhash, toxicity
from tests.llm.conftest import AWKWARD, SF, fold, table

WORD_BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
STAGES = dict(corpus_pipeline.STAGES)
#: Names that the stages use inside, or used to
CLASHING = "doc_id long, text string, toxicity double, __kept long, items string, firsts long, ends long, kept_doc long, kept_row long, was_hit boolean, text_bytes string, lang_pred string, row long, norm string, key int, n long, m map<string,int>"


def clashing(spark, rows):
    full = [(i, t, 0.25, 7, "x", 1, 2, 3, 4, True, "b", "zz", 5, "n", 6, 9, {"a": 1}) for i, t in rows]
    return spark.createDataFrame(full, CLASHING)


REPEATED = [(1, "same words here"), (1, "Same words here"), (2, "a b"), (2, "other words there"), (3, "other words there"), (None, "other words there"), (None, "alone"), (None, "alone"), (4, None), (5, ""), (None, None), (7, "Ä b"), (8, "ä b"), (9, "same line")]


def plain_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[fold(t)].append((i is not None, i or 0))
    return Counter((g, max(ids)[1] if max(ids)[0] else None) for g, ids in groups.items())


@pytest.mark.parametrize("make", [table, clashing])
def test_exact_dedup_leaves_one_row_of_each_text(spark, make):
    for rows in (REPEATED, REPEATED * 3, AWKWARD, [(None, "x")] * 5, [(1, "x")] * 4 + [(1, "X")], [(i % 3, "word " * 3_000) for i in range(50)]):
        docs = make(spark, rows)
        found = STAGES["exact dedup"](spark, docs, SF)
        assert found.columns == docs.columns
        assert Counter((fold(r.text), r.doc_id) for r in found.select("doc_id", "text").collect()) == plain_exact(rows)


@pytest.mark.parametrize("make", [table, clashing])
def test_near_dedup_leaves_one_row_of_each_group(spark, make):
    far = [(i, " ".join(f"{k}{j}" for j in range(30))) for i, k in ((11, "p"), (12, "q"), (12, "p"), (None, "q"))]
    for rows in (REPEATED + far, (REPEATED + far) * 2, AWKWARD, [(None, "x")] * 5, [(1, "x")] * 4):
        docs = make(spark, rows)
        found = STAGES["near dedup"](spark, docs, SF)
        prints = [(r.doc_id, int(r.fingerprint, 16)) for r in simhash.near_components(docs).collect()]
        groups = [{fp} for fp in {fp for _, fp in prints}]
        for fp in {fp for _, fp in prints}:
            near = [g for g in groups if any((fp ^ x).bit_count() <= simhash.LIMIT for x in g)]
            groups = [g for g in groups if g not in near] + [set().union(*near)]
        want = [min((i is None, i or 0) for i, fp in prints if fp in g) for g in groups]
        assert found.columns == docs.columns
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in found.select("doc_id").collect()) == sorted(want)


@pytest.mark.parametrize("make", [table, clashing])
def test_toxicity_and_decontamination_keep_columns_and_rows(spark, make):
    bench = spark.createDataFrame([(1, "one two three four five. six seven eight nine ten"), (None, "日本語"), (2, None), (3, "")], "item_id long, text string")
    for rows in (AWKWARD, REPEATED, [(8, "word " * 300_000), (None, "x" * 3_000_000)], []):
        docs = make(spark, rows)
        cut = decontaminate.decontaminate(docs, bench)
        assert cut.columns == docs.columns
        want = [(i, t) for i, t in rows if "日本語" not in (t or "") and "four five" not in (t or "").lower()]
        got = [tuple(r) for r in cut.select("doc_id", "text").collect()]
        assert not Counter(want) - Counter(got)
        assert all("six seven" not in (t or "") for _, t in got)
        labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (9, None)], "doc_id long, toxic int")
        scored = toxicity.with_toxicity(docs, toxicity.train(docs, labels), "judged")
        assert scored.columns == [*docs.columns, "judged"] and scored.count() == len(rows)
        again = toxicity.with_toxicity(docs, toxicity.train(docs, labels))
        assert Counter(r.doc_id for r in again.collect()) == Counter(i for i, _ in rows) and again.columns[-1] == "toxicity"


def test_language_replaces_columns_of_its_names(spark):
    docs = clashing(spark, AWKWARD)
    found = langid.with_language(docs, langid.fit(["the cat"], ["en"], PIECES))
    assert found.columns == [c for c in docs.columns if c != "lang_pred"] + ["lang_pred", "lang_score"]
    assert {r.doc_id: r.lang_pred for r in found.collect()} == {i: "und" if i in (1, 2, 3, 9, 10) else "en" for i, _ in AWKWARD}


def plain_ids(rows):
    plain = Tokenizer.from_file(WORD_BPE)
    return Counter((i, tuple([*plain.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in rows)


@pytest.mark.parametrize("make", [table, clashing])
def test_packing_of_any_rows(spark, make):
    """Each sequence is gapless, and every row's ids come out, each in one piece: pieces of a row follow each other."""
    for rows in (AWKWARD, REPEATED, [(None, "a " * n) for n in range(0, 5000, 700)], []):
        found = packing.pack_documents(make(spark, rows), WORD_BPE).collect()
        windows, ids = defaultdict(list), Counter()
        for r in found:
            windows[r.sequence_id].append((r.offset, r.length))
            assert len(r.ids) == r.length and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            for k, x in enumerate(r.ids):
                ids[r.doc_id, r.doc_tokens, r.start + k, x] += 1
        for w in windows.values():
            w.sort()
            assert all(a + b == c for (a, b), (c, _) in zip(w, w[1:], strict=False)) and w[0][0] == 0 and sum(w[-1]) <= 2048
        want = Counter()
        for (i, tokens), n in plain_ids(rows).items():
            for k, x in enumerate(tokens):
                want[i, len(tokens), k, x] += n
        assert ids == want


def test_shards_of_hot_rows_without_ids(spark):
    rows = [(None, "hot text")] * 2000 + [(7, "hot text")] * 500 + [(i, f"text {i}") for i in range(400)]
    for make in (table, clashing):
        found = sharding.shard_documents(make(spark, rows), 4).collect()
        assert Counter((r.doc_id, r.text_crc32) for r in found) == Counter((i, zlib.crc32(t.encode())) for i, t in rows)
        loads, slots = Counter(), defaultdict(list)
        for r in found:
            loads[r.shard] += r["size"]
            slots[r.shard].append(r.slot)
        assert max(loads.values()) < 1.1 * min(loads.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_stages_of_an_empty_table(spark):
    now = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
        assert now.count() == 0


def test_exact_groups_of_many_hot_texts(spark):
    rows = [(i, f"text {i % 5}") for i in range(3000)] + [(i, f"own {i}") for i in range(3000, 4500)]
    found = exact_dedup.exact_groups(table(spark, rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        group = [i for i in range(r.doc_id % 5, 3000, 5)] if r.doc_id < 3000 else [r.doc_id]
        assert (r.keep_id, r.group_size, r.kept) == (max(group), len(group), r.doc_id == max(group))
