"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatweave.session import remove_path, scratch_path, ship_package

#: White space between words: space, tab, \n, \v, \f, \r.
SPACE = r"[\x20\x09-\x0D]"

#: A table joined to documents is broadcast only if it has at most this many rows.
SMALL_ROWS = 10_000
#: Ids are broadcast up to so many.
FEW_IDS = 500_000


#: Arrow batches of whole texts, if the session leaves Spark's defaults
#: (10,000 rows, 64 MB): they bound what a Python worker and its JVM hold.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16m")}


def bound_batches(spark: SparkSession) -> None:
    for key, (default, ours) in BATCHES.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, ours)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below the shared checkpoint folder and read back:
    cuts lineage, survives lost executors, and is compressed."""
    bound_batches(df.sparkSession)
    path = scratch_path(df.sparkSession, name)
    for group in _groups:
        group.append(path)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the files of ``stored`` tables that no later plan reads."""
    for t in tables:
        remove_path(t.sparkSession, t._stored_at)


#: open groups of ``scratch_group``
_groups: list[list[str]] = []


@contextmanager
def scratch_group() -> Iterator[list[str]]:
    """The folders of all tables that are stored within the block, so that they
    can be removed once nothing reads them."""
    paths: list[str] = []
    _groups.append(paths)
    try:
        yield paths
    finally:
        _groups.remove(paths)


def join_small(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join with a broadcast hint if ``right`` (a stored table) has at most
    ``SMALL_ROWS`` rows, else as Spark sees fit."""
    if right.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        right = F.broadcast(right)
    return left.join(right, on, how)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, as a lambda variable
    (a plain reference inside another lambda would be computed per element)."""
    return F.transform(F.array(value), body).getItem(0)


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null id: null)."""
    return F.crc32(F.col(doc_id).cast("string")) % modulus
