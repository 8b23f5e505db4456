"""Loads that miss nothing that comes late.

A high-water mark loses a message that is written later with an earlier date,
and one whose link to a chat comes after the message was read. Here the state
is what was read: per ``(chat_key, chat_id)`` the set of message row ids, as
bitmaps of 32,768 ids (built, merged and counted by Spark's bitmap functions;
runs of a bitmap compress to nothing in Parquet).

``ingest_uncovered`` is the batch form: links of the defined chats are compared
with the bitmaps, pairs that are not covered are loaded, and those whose message
was there become covered, also if a rule drops it. So a message, a link or a
definition may come in any load and each (chat, link) is loaded once; the
result of all loads equals a load of the whole store. Links are three narrow
columns; of the messages, only row ids between the least and the largest
uncovered one are scanned. A pair's key has at most 32,768 rows, so no chat is a
hot key.

``stream_joined`` is the streaming form: a stream of messages and one of links
meet in Spark's stream-stream join on the row id. Row ids grow as rows are
written, so the row id is the event time, and a watermark on it ends the wait:
state holds the rows of the last ``wait`` row ids, however long the stream
is. What comes later than that is left to ``ingest_uncovered``.

Each step overwrites its own batch, and a batch reads only what earlier batches
covered, so a batch that is run again gives the same rows. Defined results:
links without a chat id or message id are never loaded; a link row that
repeats one of an earlier load is not loaded again; empty tables load nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatweave import schemas
from chatweave.operators.chats import chat_ids
from chatweave.operators.load import load_messages
from chatweave.operators.rules import DEFAULT_RULES, Rule, apply_rules
from chatweave.session import materialize
from chatweave.sources import sinks
from chatweave.sources.store import MessageStore
from chatweave.streaming.incremental import _exists, _remove, claim_state

#: row ids per bitmap, a property of Spark's bitmap functions
BITMAP_IDS = 32_768
COVERED = T.StructType([
    T.StructField("chat_key", T.StringType()), T.StructField("chat_id", T.LongType()),
    T.StructField("bucket", T.LongType()), T.StructField("bits", T.BinaryType()),
])
PAIR = ["chat_key", "chat_id", "bucket"]


def bitmaps(pairs: DataFrame) -> DataFrame:
    """``(chat_key, chat_id, bucket, bits)`` of ``(chat_key, chat_id, message_id)``."""
    keyed = pairs.select("chat_key", "chat_id", F.bitmap_bucket_number("message_id").alias("bucket"), F.bitmap_bit_position("message_id").alias("bit"))
    return keyed.groupBy(*PAIR).agg(F.bitmap_construct_agg("bit").alias("bits"))


def covered(spark: SparkSession, state_dir: str, before_batch: int) -> DataFrame | None:
    """The bitmaps of all earlier batches, merged."""
    path = f"{state_dir}/covered"
    if not _exists(spark, path):
        return None
    rows = sinks.read_batches(spark, path, COVERED).where(F.col("batch_id") < before_batch)
    return rows.groupBy(*PAIR).agg(F.bitmap_or_agg("bits").alias("bits"))


def uncovered(pairs: DataFrame, state: DataFrame | None) -> DataFrame:
    """The pairs whose message id is not in its bitmap."""
    if state is None:
        return pairs
    keyed = pairs.withColumns({"bucket": F.bitmap_bucket_number("message_id"), "_bit": F.bitmap_bit_position("message_id")})
    byte = F.conv(F.hex(F.substring("bits", (F.col("_bit") / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    held = F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), F.col("_bit") % 8).cast("int")) > 0, F.lit(False))
    return keyed.join(state, PAIR, "left").where(~held).select("chat_key", "chat_id", "message_id")


def ingest_uncovered(
    store: MessageStore, chats: DataFrame, contacts: DataFrame, state_dir: str, batch_id: int, rules: tuple[Rule, ...] = DEFAULT_RULES
) -> None:
    """Load every (chat, link) not loaded before, clean it and save it as
    ``batch_id`` of ``messages``; then record what was read."""
    spark = chats.sparkSession
    claim_state(spark, state_dir, "batch")
    ids = materialize(chat_ids(chats, contacts, store.chat).select("chat_key", "chat_id"))
    links = store.chat_message_join.where("chat_id IS NOT NULL AND message_id IS NOT NULL").join(ids, "chat_id").select("chat_key", "chat_id", "message_id")
    fresh = materialize(uncovered(links, covered(spark, state_dir, batch_id)))
    low, high = fresh.agg(F.min("message_id"), F.max("message_id")).first()
    message = store.message.where(F.col("rowid").between(low, high)) if low is not None else store.message.limit(0)
    found = materialize(fresh.join(message.select(F.col("rowid").alias("message_id")), "message_id", "left_semi"))
    part = MessageStore(store.handle, store.chat, message, store.chat_message_join)
    loaded = load_messages(part, chats, contacts, pairs=found.select("chat_key", "chat_id", "message_id"))
    sinks.save_messages(apply_rules(loaded, *rules), f"{state_dir}/messages", batch_id)
    sinks.write_batch(bitmaps(found), f"{state_dir}/covered", batch_id)


def compact_covered(spark: SparkSession, state_dir: str, upto_batch: int) -> None:
    """Merge the bitmaps of the batches up to ``upto_batch`` into that one. The
    merged batch replaces its own first, so a break between the steps leaves
    batches that say the same twice, which changes nothing."""
    merged = materialize(covered(spark, state_dir, upto_batch + 1))
    sinks.write_batch(merged, f"{state_dir}/covered", upto_batch)
    old = sinks.read_batches(spark, f"{state_dir}/covered", COVERED).where(F.col("batch_id") < upto_batch)
    for r in old.select("batch_id").distinct().collect():
        _remove(spark, f"{state_dir}/covered/batch_id={r.batch_id}")


def _timed(rows: DataFrame, row_id: str, wait: int) -> DataFrame:
    """Rows with their row id as event time, a second per id. A watermark
    begins at the first second, and what lies there is late: ids start after it."""
    return rows.withColumn("row_time", F.timestamp_seconds(F.col(row_id) + 1)).withWatermark("row_time", f"{int(wait)} seconds")


def stream_joined(
    spark: SparkSession,
    message_dir: str,
    link_dir: str,
    store: MessageStore,
    chats: DataFrame,
    contacts: DataFrame,
    state_dir: str,
    wait: int,
    rules: tuple[Rule, ...] = DEFAULT_RULES,
) -> list[dict]:
    """Process the message and link files not yet seen (``availableNow``). A
    message and its link may come in either order and in different runs, up to
    ``wait`` row ids apart. ``store`` supplies handles and chats. Returns the
    state sizes (rows held by the join) after each micro-batch."""
    claim_state(spark, state_dir, "stream")
    messages = _timed(spark.readStream.schema(schemas.MESSAGE).parquet(message_dir), "rowid", wait)
    links = spark.readStream.schema(schemas.CHAT_MESSAGE_JOIN).parquet(link_dir).where("chat_id IS NOT NULL AND message_id IS NOT NULL")
    links = _timed(links, "message_id", wait).withColumnRenamed("row_time", "link_time")
    joined = messages.join(links, (F.col("rowid") == F.col("message_id")) & (F.col("row_time") == F.col("link_time")))
    columns = [*schemas.MESSAGE.names, "chat_id"]
    staged_schema = T.StructType([*schemas.MESSAGE.fields, T.StructField("chat_id", T.LongType())])

    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        # evaluated once: the plan above it updates the join's state
        staging = f"{state_dir}/staging-{int(epoch_id)}"
        own = batch.sparkSession
        batch.select(*columns).write.mode("overwrite").parquet(staging)
        rows = own.read.schema(staged_schema).parquet(staging)
        part = MessageStore(store.handle, store.chat, rows.drop("chat_id").distinct(), rows.select("chat_id", F.col("rowid").alias("message_id")))
        loaded = load_messages(part, chats, contacts)
        sinks.save_messages(apply_rules(loaded, *rules), f"{state_dir}/messages", int(epoch_id) + 1)
        _remove(own, staging)

    query = (
        joined.writeStream.foreachBatch(per_batch)
        .option("checkpointLocation", f"{state_dir}/_stream_checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return [{"batch": p["batchId"], "rows": p["stateOperators"][0]["numRowsTotal"]} for p in query.recentProgress if p["stateOperators"]]
