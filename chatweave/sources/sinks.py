"""Sinks: saved messages (A3, G1), chunk vectors (A5), CSV exchange (A2).

Tables are Parquet, partitioned by ``batch_id``. A batch is written to its
own partition folder in overwrite mode, so re-running a failed or repeated
batch replaces exactly its own rows, also when it has none any more: appends
are idempotent. Own tables are read with explicit schemas, so a table whose
batches are all empty reads as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from chatweave import schemas
from chatweave.functions.text import chat_slug

# Options that make CSV lossless for texts with newlines, quotes, leading
# or trailing spaces and empty strings; used on write and on read.
CSV_OPTIONS = {
    "header": "true",
    "escape": '"',
    "nullValue": "\\N",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def write_batch(df: DataFrame, path: str, batch_id: int, sort_cols: tuple[str, ...] = ()) -> None:
    """Write ``df`` as partition ``batch_id`` of the table at ``path``."""
    out = df.drop("batch_id")
    if sort_cols:
        out = out.sortWithinPartitions(*sort_cols)
    out.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={int(batch_id)}")


def save_messages(messages: DataFrame, path: str, batch_id: int) -> None:
    """Append a batch of messages (with their ``chat_slug``) to the saved
    table; earlier batches stay as they are (a bag union on read)."""
    write_batch(
        messages.withColumn("chat_slug", chat_slug("chat_key")),
        path,
        batch_id,
        sort_cols=("chat_key", "time", "message_id"),
    )


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read a batch-partitioned table; ``schema`` is that of its batches."""
    full = T.StructType([f for f in schema.fields if f.name != "batch_id"]).add("batch_id", T.LongType())
    return spark.read.schema(full).parquet(path)


def read_saved_messages(spark: SparkSession, path: str) -> DataFrame:
    return read_batches(spark, path, schemas.SAVED_MESSAGES)


def write_csv(df: DataFrame, path: str) -> None:
    """Lossless CSV. Texts may hold line breaks, so it is read back with
    ``multiLine``, one task per file (CSV of that kind cannot be split): write
    large tables with enough partitions."""
    df.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def read_csv(spark: SparkSession, path: str, schema=schemas.MESSAGES) -> DataFrame:
    return spark.read.schema(schema).options(**CSV_OPTIONS).option("multiLine", "true").csv(path)
