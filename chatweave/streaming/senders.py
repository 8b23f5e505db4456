"""Senders and marks as maintained state.

A stateful aggregation over the message stream keeps, per ``(chat_id,
handle_id)``, the first and last ``(time, message_id)`` and the number of
messages: one small row per sender of a chat in Spark's state store, however
many messages there were. Each micro-batch emits the keys it changed
(``update`` mode), written as a batch of their own; the newest row of a key
counts. Nothing in this state depends on chat definitions, so a changed
definition has nothing to take back: who is unknown, and what a chat's mark is,
follows from joining the few state rows with the definitions of the moment.

``unknown_senders_now`` and ``marks_now`` equal the batch forms over all
messages streamed so far. The links are those of ``store`` at each run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatweave import schemas
from chatweave.operators.addresses import sender_map
from chatweave.operators.chats import chat_ids
from chatweave.sources import sinks
from chatweave.sources.store import MessageStore
from chatweave.streaming.incremental import claim_state

#: (time, message_id)
MOMENT = T.StructType([T.StructField("time", T.LongType()), T.StructField("message_id", T.LongType())])
TOTALS = T.StructType([
    T.StructField("chat_id", T.LongType()), T.StructField("handle_id", T.LongType()), T.StructField("signed", T.BooleanType()),
    T.StructField("first", MOMENT), T.StructField("last", MOMENT), T.StructField("n", T.LongType()),
])
KEY = ["chat_id", "handle_id", "signed"]


def stream_totals(spark: SparkSession, message_dir: str, store: MessageStore, state_dir: str) -> list[int]:
    """Add the message files not yet seen to the totals (``availableNow``).
    Returns the number of keys in the state after each micro-batch."""
    claim_state(spark, state_dir, "stream")
    messages = spark.readStream.schema(schemas.MESSAGE).parquet(message_dir)
    whole = messages.where("text IS NOT NULL AND date IS NOT NULL AND associated_message_type IS NOT NULL")
    linked = whole.join(store.chat_message_join, whole["rowid"] == F.col("message_id"))
    moment = F.struct(F.col("date").alias("time"), F.col("rowid").alias("message_id"))
    totals = linked.withColumn("signed", F.col("is_from_me").isNotNull()).groupBy(*KEY).agg(
        F.min(moment).alias("first"), F.max(moment).alias("last"), F.count(F.lit(1)).alias("n"))

    def per_batch(changed: DataFrame, epoch_id: int) -> None:
        sinks.write_batch(changed, f"{state_dir}/totals", int(epoch_id) + 1)

    query = (
        totals.writeStream.outputMode("update").foreachBatch(per_batch)
        .option("checkpointLocation", f"{state_dir}/_totals_checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def totals_now(spark: SparkSession, state_dir: str) -> DataFrame:
    """The newest row of every key."""
    rows = sinks.read_batches(spark, f"{state_dir}/totals", TOTALS)
    newest = rows.groupBy(*KEY).agg(F.max_by(F.struct("first", "last", "n"), "batch_id").alias("_v"))
    return newest.select(*KEY, "_v.first", "_v.last", "_v.n")


def unknown_senders_now(spark: SparkSession, state_dir: str, store: MessageStore, chats: DataFrame, contacts: DataFrame) -> DataFrame:
    """The rows of ``unknown_senders`` under these definitions."""
    groups = chats.where(F.col("kind") == "group")
    ids = chat_ids(groups, contacts, store.chat).select("chat_key", "chat_id")
    heard = totals_now(spark, state_dir).where("handle_id IS NOT NULL").join(ids, "chat_id")
    heard = heard.groupBy("chat_key", "handle_id").agg(F.min("first").alias("_first"), F.sum("n").alias("n_messages"))
    names = sender_map(groups, contacts, store.handle).where("name <> ''")
    strangers = heard.join(names, ["chat_key", "handle_id"], "left_anti")
    handles = store.handle.select(F.col("rowid").alias("handle_id"), F.col("id").alias("_id")).groupBy("handle_id").agg(F.min("_id").alias("_id"))
    return strangers.join(handles, "handle_id", "left").select(
        "chat_key", "handle_id", F.coalesce("_id", F.concat(F.lit("unknown:"), F.col("handle_id").cast("string"))).alias("address"),
        F.col("_first.time").alias("first_time"), F.col("_first.message_id").alias("first_message_id"), "n_messages")


def marks_now(spark: SparkSession, state_dir: str, store: MessageStore, chats: DataFrame, contacts: DataFrame) -> DataFrame:
    """The rows of ``high_water_mark`` over a load under these definitions."""
    heard = totals_now(spark, state_dir).join(chat_ids(chats, contacts, store.chat), "chat_id")
    counted = heard.where(F.when(F.col("kind") == "group", F.col("handle_id").isNotNull()).otherwise(F.col("signed")))
    return counted.groupBy("chat_key").agg(F.max("last").alias("_m")).select(
        "chat_key", F.col("_m.time").alias("mark_time"), F.col("_m.message_id").alias("mark_id"))
