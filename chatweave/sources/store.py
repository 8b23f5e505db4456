"""Message-store scan (A1) and chat/contact definitions (A4)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatweave import schemas


@dataclass(frozen=True)
class MessageStore:
    """The four tables of a message store, as DataFrames with fixed schemas."""

    handle: DataFrame
    chat: DataFrame
    message: DataFrame
    chat_message_join: DataFrame


def _conform(df: DataFrame, schema) -> DataFrame:
    """Select and cast to the fixed schema (names are matched case-insensitively)."""
    by_lower = {c.lower(): c for c in df.columns}
    cols = []
    for field in schema.fields:
        src = by_lower.get(field.name.lower())
        if src is None:
            raise ValueError(f"column {field.name!r} missing; have {df.columns}")
        cols.append(F.col(src).cast(field.dataType).alias(field.name))
    return df.select(*cols)


def store_from_frames(
    handle: DataFrame, chat: DataFrame, message: DataFrame, chat_message_join: DataFrame
) -> MessageStore:
    return MessageStore(
        handle=_conform(handle, schemas.HANDLE),
        chat=_conform(chat, schemas.CHAT),
        message=_conform(message, schemas.MESSAGE),
        chat_message_join=_conform(chat_message_join, schemas.CHAT_MESSAGE_JOIN),
    )


def read_store(spark: SparkSession, path: str, fmt: str = "parquet") -> MessageStore:
    """Read ``{path}/{handle,chat,message,chat_message_join}`` with explicit
    schemas (never inferred). Column pruning and filters reach the scan."""
    frames = {
        name: spark.read.schema(schema).format(fmt).load(f"{path.rstrip('/')}/{name}")
        for name, schema in schemas.STORE_TABLES.items()
    }
    return MessageStore(**frames)


def jdbc_options(url: str, query: str, properties: dict | None, bounds: tuple[int, int] | None, partitions: int) -> dict:
    """Options of one JDBC read. With ``bounds`` (lowest and highest row id)
    it is split into ``partitions`` ranges of the row id, one task each."""
    options = {"url": url, **(properties or {})}
    if bounds is None:
        return options | {"query": query}
    return options | {
        "dbtable": f"({query}) t", "partitionColumn": "rowid", "lowerBound": str(bounds[0]),
        "upperBound": str(bounds[1]), "numPartitions": str(partitions),
    }


def read_store_jdbc(
    spark: SparkSession, url: str, properties: dict | None = None,
    message_bounds: tuple[int, int] | None = None, partitions: int = 32,
) -> MessageStore:
    """Read the store tables over JDBC (needs the user's driver on the
    classpath; none ships with Spark). ``ROWID`` is selected explicitly.
    ``message_bounds``, the lowest and highest message row id, splits the
    message table and its links into ``partitions`` reads; without it each
    table is one task."""
    queries = {
        "handle": "SELECT ROWID AS rowid, id FROM handle",
        "chat": "SELECT ROWID AS rowid, display_name, chat_identifier FROM chat",
        "message": (
            "SELECT ROWID AS rowid, handle_id, is_from_me, text, date, "
            "associated_message_type FROM message"
        ),
        "chat_message_join": "SELECT chat_id, message_id, message_id AS rowid FROM chat_message_join",
    }
    frames = {
        name: spark.read.format("jdbc").options(**jdbc_options(
            url, q, properties, message_bounds if name in ("message", "chat_message_join") else None, partitions)).load()
        for name, q in queries.items()
    }
    return store_from_frames(**frames)


def contacts_from_rows(rows: DataFrame) -> DataFrame:
    """Contacts ``(chat_key, member_pos, name, addresses)`` from one row per
    address ``(chat_key, member_pos, name, addr_pos, raw_address)``.

    A contact has a handful of addresses, so the per-contact list is small.
    """
    return (
        rows.groupBy("chat_key", "member_pos", "name")
        .agg(F.array_sort(F.collect_list(F.struct("addr_pos", "raw_address"))).alias("_a"))
        .select(
            "chat_key",
            F.col("member_pos").cast("int").alias("member_pos"),
            "name",
            F.transform("_a", lambda x: x["raw_address"]).alias("addresses"),
        )
    )
