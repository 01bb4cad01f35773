"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []

#: Spark removes the shuffle files of an execution when it ends. A scratch table is written once, and nobody reads those again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _cleaned(spark: SparkSession):
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir, or a local one where it is unset and Spark runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(df: DataFrame) -> DataFrame:
    """Writes the rows as Parquet to the shared folder and reads them back: this cuts the lineage,
    and the table outlives lost executors; what was shuffled for it goes. release() removes all such tables."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    with _cleaned(spark):
        df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int | None = None) -> DataFrame:
    """A scratch table dealt to buckets by the key, for a side that many joins by that key read: none of them shuffles it."""
    spark = df.sparkSession
    name, n = f"scratch_{uuid.uuid4().hex}", buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{scratch_root(spark)}/{name}"
    with _cleaned(spark):
        df.repartition(n, key).write.bucketBy(n, key).option("path", path).format("parquet").saveAsTable(name)
    _made.append(path)
    return spark.table(name)


def made() -> int:
    """How many scratch tables there are; for release."""
    return len(_made)


def release(spark: SparkSession, but_last: int = 0, since: int = 0) -> None:
    """Removes the scratch tables made so far (since: but for so many, the first), but for the last ones; call it when no result
    that reads them is still to be computed."""
    until = max(since, len(_made) - but_last)
    gone, _made[since:] = _made[since:until], _made[until:]
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
