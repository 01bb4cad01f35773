import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

SF = "/root/testdata/sf0.001"
UPPER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


def fold(text):
    """Lower-cases A-Z only."""
    return (text or "").translate(UPPER)


@pytest.fixture(scope="session")
def documents(spark):
    """A small real table as a list of (doc_id, text)."""
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def table(spark, rows, extra=True):
    """documents of (doc_id, text), with further columns whose names operators use inside."""
    full = [(i, t, "en", "s", len(t or ""), "x", 1.5, None) for i, t in rows]
    names = "doc_id long, text string, lang string, source string, n_chars long, digest string, key double, block int"
    return spark.createDataFrame(full, names)


AWKWARD = [
    (1, None),
    (2, ""),
    (3, "   \n\t"),
    (4, "one"),
    (5, "One two THREE four five. six seven eight nine ten eleven twelve thirteen fourteen fifteen"),
    (6, "one two three four five. six seven eight nine ten eleven twelve thirteen fourteen fifteen"),
    (7, "ÀÉ ñandú straße İK  x y 日本語 ☃☃☃"),
    (8, "word " * 30_000),
    (9, None),
    (10, "%%% *** ..."),
    (10, "%%% *** ..."),
]
