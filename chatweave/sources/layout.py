"""Messages laid out by chat, and files whose order is the order.

``write_by_chat`` range-partitions a batch on ``(chat_slug, chat_key, time,
message_id)``: small chats share files, a large chat spans several, and files
hold about ``FILE_ROWS`` rows whatever the chats are. Files are numbered by
range, so reading them in name order is the order, and rows of a file lie in
order. Beside the data, a file table has each file's number, first and last
key and row count; it is made by a scan of the key columns only.

``read_chat`` asks the file table which files can hold a chat (a range test of
two slugs per file) and reads only these, with the slug pushed to their row
groups. ``ranked`` gives every row its place in the whole order from the file
table and the row's index in its file, without a window or a sort.

Batches are folders (``batch_id=``) of their own; ``compact`` rewrites several
as one, so that a chat does not lie in a file per batch for ever.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatweave import schemas
from chatweave.functions.text import chat_slug
from chatweave.operators.sequence import default_partitions
from chatweave.session import join_bounded, materialize, remove_path

FILE_ROWS = 1_000_000
KEY = ["chat_slug", "chat_key", "time", "message_id"]
_BOUND = T.StructType([T.StructField("chat_slug", T.StringType()), T.StructField("chat_key", T.StringType()), T.StructField("time", T.LongType()), T.StructField("message_id", T.LongType())])
FILES = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("file_no", T.LongType()), T.StructField("rows", T.LongType()), T.StructField("rows_before", T.LongType()),
    T.StructField("first", _BOUND), T.StructField("last", _BOUND), T.StructField("batch_id", T.LongType()),
])


def write_by_chat(messages: DataFrame, path: str, batch_id: int, file_rows: int = FILE_ROWS) -> None:
    """Write ``messages`` (chat_key, message_id, time, ...) as batch ``batch_id``."""
    spark, path = messages.sparkSession, path.rstrip("/")
    rows = materialize(messages.drop("batch_id").withColumn("chat_slug", chat_slug("chat_key")))
    n = max(-(-rows.count() // file_rows), min(default_partitions(rows), 1 + rows.count() // max(1, file_rows // 64)))
    data = f"{path}/data/batch_id={int(batch_id)}"
    rows.repartitionByRange(n, *KEY).sortWithinPartitions(*KEY).write.mode("overwrite").parquet(data)
    read = spark.read.schema(rows.schema).parquet(data).select(F.col("_metadata.file_name").alias("file"), F.struct(*KEY).alias("k"))
    files = read.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.min("k").alias("first"), F.max("k").alias("last"))
    before = Window.orderBy("first", "last", "file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    files = files.select(
        "file", (F.row_number().over(Window.orderBy("first", "last", "file")) - 1).cast("long").alias("file_no"), "rows", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"), "first", "last")
    files.coalesce(1).write.mode("overwrite").parquet(f"{path}/files/batch_id={int(batch_id)}")


def file_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILES).parquet(f"{path.rstrip('/')}/files")


def read_messages(spark: SparkSession, path: str, schema: T.StructType = schemas.SAVED_MESSAGES) -> DataFrame:
    """All batches."""
    full = T.StructType([f for f in schema.fields if f.name != "batch_id"]).add("batch_id", T.LongType())
    return spark.read.schema(full).parquet(f"{path.rstrip('/')}/data")


def chat_files(spark: SparkSession, path: str, slug: str) -> list[str]:
    """The files that can hold a chat, in order."""
    found = file_table(spark, path).where((F.col("first.chat_slug") <= slug) & (F.col("last.chat_slug") >= slug))
    root = path.rstrip("/")
    return [f"{root}/data/batch_id={r.batch_id}/{r.file}" for r in found.select("batch_id", "file_no", "file").orderBy("batch_id", "file_no").collect()]


def read_chat(spark: SparkSession, path: str, slug: str, schema: T.StructType = schemas.SAVED_MESSAGES) -> DataFrame:
    """The messages of the chat(s) with this slug, from the files that can hold them."""
    full = T.StructType([f for f in schema.fields if f.name != "batch_id"]).add("batch_id", T.LongType())
    files = chat_files(spark, path, slug)
    if not files:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", f"{path.rstrip('/')}/data").parquet(*files).where(F.col("chat_slug") == slug)


def ranked(spark: SparkSession, path: str, batch_id: int, schema: T.StructType = schemas.SAVED_MESSAGES) -> DataFrame:
    """Rows of a batch with ``file_no``, ``place`` (0-based in the file) and
    ``rank`` (from 1 in the whole order)."""
    data = f"{path.rstrip('/')}/data/batch_id={int(batch_id)}"
    own = T.StructType([f for f in schema.fields if f.name != "batch_id"])
    rows = spark.read.schema(own).parquet(data).select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("place"))
    files = file_table(spark, path).where(F.col("batch_id") == int(batch_id)).select("file", "file_no", "rows_before")
    out = join_bounded(rows, files, ["file"], "inner")
    return out.withColumn("rank", F.col("rows_before") + F.col("place") + 1).drop("file", "rows_before")


def compact(spark: SparkSession, path: str, batch_ids: list[int], into: int, file_rows: int = FILE_ROWS) -> None:
    """Rewrite some batches as batch ``into`` (an id none of the others has),
    then remove them. The union is stored before anything is removed."""
    if into in batch_ids:
        raise ValueError("the compacted batch needs an id of its own")
    some = read_messages(spark, path).where(F.col("batch_id").isin([int(b) for b in batch_ids]))
    write_by_chat(some.drop("chat_slug"), path, into, file_rows)
    for b in batch_ids:
        remove_path(spark, f"{path.rstrip('/')}/files/batch_id={int(b)}")
        remove_path(spark, f"{path.rstrip('/')}/data/batch_id={int(b)}")
