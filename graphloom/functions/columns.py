"""Column expressions; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The id prefixes of node types. Longer ones are tested first: dbpedia_ also begins with d.
PREFIXES = {"dbpedia_": "entity", "tk_": "topic_keyword", "p_": "publication", "d_": "dataset", "a_": "author", "v_": "venue", "o_": "organization", "k_": "keyword", "t_": "topic"}

HASH_FACTOR, HASH_RANGE, KEY_RANGE = 2654435761, 4294967296, 2147483648


def node_type(node: Column) -> Column:
    """The type of a node by the prefix of its id; null if there is none."""
    kind = F.lit(None).cast("string")
    for prefix, name in sorted(PREFIXES.items(), key=lambda p: len(p[0])):
        kind = F.when(node.startswith(prefix), name).otherwise(kind)
    return kind


def portable_hash(key: Column, salt: int | Column = 0) -> Column:
    """A mix of an integer key that any SQL engine can repeat; use the key as a tie-break. The key is taken modulo
    2**31 first, so that the product stays in 64 bits."""
    return F.pmod(F.pmod(key.cast("long"), F.lit(KEY_RANGE)) * HASH_FACTOR + salt, F.lit(HASH_RANGE))


def normalize_text(text: Column) -> Column:
    """Lower case, white space folded to one blank, all but a-z and blanks removed; null is 'nan'."""
    folded = F.regexp_replace(F.lower(F.coalesce(text, F.lit("nan"))), r"(?U)[\s\x1c-\x1f]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(folded, "[^a-z ]", ""), " +", " "))


def word_count(text: Column) -> Column:
    """Blank-separated words; 0 for an empty text."""
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; null if a vector is zero. Pass norms that were computed once per row."""
    length = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(length > 0, dot(a, b) / length)


def singular(word: Column) -> Column:
    """A rule-based singular of an English word."""
    return (
        F.when(word.rlike("(ss|us|is)$"), word)
        .when(word.rlike("ies$") & (F.length(word) > 4), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike("(ch|sh|x|z|s)es$"), F.regexp_replace(word, "es$", ""))
        .when(word.rlike("s$") & (F.length(word) > 3), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def leaky_relu(x: Column, slope: float = 0.01) -> Column:
    return F.when(x > 0, x).otherwise(slope * x)


def log_sigmoid(x: Column) -> Column:
    """log(sigmoid(x)) without overflow."""
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))
