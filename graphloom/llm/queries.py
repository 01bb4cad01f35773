"""The thin queries opN_* over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, exact_dedup, langid, licenses, lm, packing, quality, runs, search, sharding, simhash, substring_dedup, toxicity

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _remainder(divisor: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(divisor))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = langid.train(docs, public_tokenizers.path("piece_bpe_32k.model"), _remainder(5) != 0)
    found = langid.with_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (_remainder(5) == 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm.score_documents(_read(spark, sf_dir, "documents"), _remainder(7) != 2, public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_documents(_read(spark, sf_dir, "documents"), shards=16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_read(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_read(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _read(spark, sf_dir, "labels"), _remainder(5) != 0)
    scored = toxicity.with_toxicity(docs, model)
    return scored.select("doc_id", (_remainder(5) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(_read(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_read(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition(_read(spark, sf_dir, "documents"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search(search.build_index(_read(spark, sf_dir, "documents")), _read(spark, sf_dir, "benchmark"), k=20)
    return found.select("item_id", "rank", "doc_id", "score")


def _made_periodic(docs: DataFrame) -> DataFrame:
    """The query's texts: where h = crc32(doc_id) is divisible by 10 the words from a on repeat the p words at a."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    w = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    n = F.size("w").cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    texts = docs.select("doc_id", "text", F.when(h % 10 == 0, w).alias("w"))
    texts = texts.select("doc_id", "text", "w", F.when(n > 0, a).alias("a"), F.when(n > 0, p).alias("p"), n.alias("n"))
    made = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("w", place(i).cast("int"))), " ")
    return texts.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(_made_periodic(_read(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_score": op1_lm_score,
    "op2_sharding": op2_sharding,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_decontaminate": op5_decontaminate,
    "op6_language": op6_language,
    "op7_toxicity": op7_toxicity,
    "op8_simhash": op8_simhash,
    "op9_licenses": op9_licenses,
    "op10_packing": op10_packing,
    "op11_quality": op11_quality,
    "op12_search": op12_search,
    "op13_runs": op13_runs,
}

ALNUM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), '%s', '%s'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')" % (UPPER, LOWER)

SPACED_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL: dict[str, str] = {
    "op3_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {SPACED_WORDS} AS w FROM documents),
        di AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d),
        runs AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS g FROM di),
        first AS (SELECT g, min(doc_id) AS least FROM runs GROUP BY g),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM runs JOIN first USING (g) WHERE doc_id > least),
        words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
        kept AS (SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op5_decontaminate": f"""
        WITH d AS (SELECT doc_id, {ALNUM_WORDS} AS w FROM documents),
        b AS (SELECT item_id, w, least(10, len(w)) AS k FROM (SELECT item_id, {ALNUM_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
        bi AS (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b),
        windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM bi),
        di AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM windows)),
        hits AS (SELECT doc_id, i, k, item_id FROM (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM di) JOIN windows USING (k, g)),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op11_quality": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {SPACED_WORDS} AS w FROM documents),
        words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, length(unnest(w)) AS size FROM d),
        chars AS (SELECT doc_id, sum(size) AS word_chars FROM words GROUP BY doc_id),
        windows AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM (
            SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT unnest(range(5, 11)) AS n))),
        occ AS (SELECT doc_id, n, i, row_number() OVER (PARTITION BY doc_id, n, g ORDER BY i) AS nth, count(*) OVER (PARTITION BY doc_id, n, g) AS many FROM windows),
        cov AS (SELECT doc_id, n, p, max(nth) AS nth FROM (SELECT doc_id, n, nth, unnest(range(i, i + n)) AS p FROM occ WHERE many > 1) GROUP BY doc_id, n, p),
        reps AS (SELECT doc_id, count(*) FILTER (n = 8) AS n_repeat_words, {", ".join(f"sum(size) FILTER (n = {n} AND nth > 1) AS dup{n}_chars" for n in quality.NGRAM_PERCENT)} FROM cov JOIN words USING (doc_id, p) GROUP BY doc_id),
        lines AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS nth FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
        counted AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (nth > 1) AS n_dup_lines, sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) FILTER (nth > 1) AS dup_line_chars FROM lines GROUP BY doc_id),
        f AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
            {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in quality.COUNTS if c not in ("n_words", "n_symbols"))}
            FROM d LEFT JOIN chars USING (doc_id) LEFT JOIN reps USING (doc_id) LEFT JOIN counted USING (doc_id))
        SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.BASE_PERCENT} * n_words AS base_failed,
            NOT (base_failed OR 100 * dup_line_chars > {quality.LINE_CHAR_PERCENT} * word_chars OR {" OR ".join(f"100 * dup{n}_chars > {k} * word_chars" for n, k in quality.NGRAM_PERCENT.items())}) AS kept FROM f
    """,
    "op12_search": f"""
        WITH d AS (SELECT doc_id, unnest({ALNUM_WORDS}) AS term FROM documents),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY doc_id, term),
        n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
        c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM n),
        m AS (SELECT doc_id, 75 + (25 * n * docs) // words AS m FROM n, c),
        q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({ALNUM_WORDS}) AS term FROM benchmark) GROUP BY item_id, term),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), c),
        s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
        QUALIFY rank <= 20
    """,
    # Every two equal words at most a quarter of the text apart; stretches of them at one distance are runs.
    "op13_runs": f"""
        WITH b AS (SELECT doc_id, {SPACED_WORDS} AS w, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
            lambda c: list_transform(range(8), lambda k: (CAST(ascii(c) AS BIGINT) >> k) & 1)))), lambda c, x: xor(c >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295) AS h FROM documents),
        c AS (SELECT *, CAST(len(w) AS BIGINT) AS n, h // 10 AS g FROM b),
        e AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM c), f AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM e),
        d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM f),
        words AS MATERIALIZED (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM d),
        eq AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
        stretches AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM eq) GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
        runs AS MATERIALIZED (SELECT doc_id, s, len, min(q) AS p FROM stretches GROUP BY doc_id, s, len),
        dropped AS (SELECT DISTINCT doc_id, unnest(range(s + p, s + len)) AS i FROM runs),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id),
        best AS (SELECT doc_id, s, len, p FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY len DESC, s, p) = 1),
        listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || p || chr(10), '' ORDER BY s, p) AS list FROM runs GROUP BY doc_id)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, len AS length, p AS period, 1000 * len // p AS exponent_milli, sha256(coalesce(list, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
        FROM d LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
    "op4_exact_dedup": f"""
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents),
        g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
    """,
}
