"""Incremental loading and indexing.

State lives in shared storage next to the tables it describes:

* ``messages``: cleaned messages, partition per ``batch_id``;
* ``marks``: per-chat high-water cursor ``(chat_key, mark_time, mark_id)``
  taken over the *scanned* messages of a batch (so a message dropped by a
  rule is not scanned again), partition per ``batch_id``; the current mark
  is the largest over earlier batches;
* ``chunk_vectors``: chunks of each batch's new messages with embeddings.

Each step overwrites its own batch partition, so a batch that is re-run after
a failure replaces its own output, also by nothing. The scanned batch is
written once to a staging folder and read back before the two uses (marks,
cleaning), which cuts the lineage instead of loading the store twice; the
folder is removed once the marks are written. Batch ids are the caller's in
batch loads and ``epoch + 1`` in streams, so a state folder belongs to one of
the two ways of loading, and the other is refused.

``stream_ingest`` is the Structured Streaming form: new message files are
picked up by the file source, each micro-batch runs the same steps in
``foreachBatch``, and the checkpoint records which files are done.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatweave import schemas
from chatweave.functions.text import chat_slug
from chatweave.operators.chunking import chunk_greedy, format_lines
from chatweave.operators.embed import EmbedFn, embed_hashed
from chatweave.operators.load import load_messages
from chatweave.operators.rules import DEFAULT_RULES, Rule, apply_rules
from chatweave.sources import sinks
from chatweave.sources.commits import CommittedTables, committed_or_none
from chatweave.sources.store import MessageStore


def high_water_mark(messages: DataFrame) -> DataFrame:
    """``(chat_key, mark_time, mark_id)``: the last ``(time, message_id)`` per
    chat (partial aggregation before the shuffle)."""
    return (
        messages.groupBy("chat_key")
        .agg(F.max(F.struct("time", "message_id")).alias("_m"))
        .select("chat_key", F.col("_m.time").alias("mark_time"), F.col("_m.message_id").alias("mark_id"))
    )


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hpath)


def _remove(spark: SparkSession, path: str) -> None:
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


class StateOwnerError(RuntimeError):
    """A state folder of batch loads used for a stream, or the reverse."""


def claim_state(spark: SparkSession, state_dir: str, way: str) -> None:
    """Mark ``state_dir`` as belonging to ``way`` ('batch' or 'stream')."""
    other = {"batch": "stream", "stream": "batch"}[way]
    if _exists(spark, f"{state_dir}/owner={other}"):
        raise StateOwnerError(f"{state_dir} holds the state of a {other} load")
    spark.range(1).write.mode("ignore").parquet(f"{state_dir}/owner={way}")


def current_marks(spark: SparkSession, state_dir: str, before_batch: int) -> DataFrame | None:
    path = f"{state_dir}/marks"
    if not _exists(spark, path):
        return None
    marks = sinks.read_batches(spark, path, schemas.MARKS).where(F.col("batch_id") < before_batch)
    return (
        marks.groupBy("chat_key")
        .agg(F.max(F.struct("mark_time", "mark_id")).alias("_m"))
        .select("chat_key", F.col("_m.mark_time").alias("mark_time"), F.col("_m.mark_id").alias("mark_id"))
    )


def ingest_batch(
    store: MessageStore,
    chats: DataFrame,
    contacts: DataFrame,
    state_dir: str,
    batch_id: int,
    rules: tuple[Rule, ...] = DEFAULT_RULES,
    use_marks: bool = True,
) -> None:
    """Load what is new since the marks, clean it, save it as ``batch_id``
    and record the new marks."""
    claim_state(chats.sparkSession, state_dir, "batch")
    _ingest(store, chats, contacts, state_dir, batch_id, rules, use_marks)


def _ingest(store, chats, contacts, state_dir, batch_id, rules, use_marks) -> None:
    spark = chats.sparkSession
    marks = current_marks(spark, state_dir, batch_id) if use_marks else None
    staging = f"{state_dir}/staging-{int(batch_id)}"
    load_messages(store, chats, contacts, marks=marks).write.mode("overwrite").parquet(staging)
    scanned = spark.read.schema(schemas.MESSAGES).parquet(staging)
    sinks.save_messages(apply_rules(scanned, *rules), f"{state_dir}/messages", batch_id)
    sinks.write_batch(high_water_mark(scanned), f"{state_dir}/marks", batch_id)
    _remove(spark, staging)


def load_committed(
    store: MessageStore,
    chats: DataFrame,
    contacts: DataFrame,
    state_dir: str,
    batch_id: int,
    rules: tuple[Rule, ...] = DEFAULT_RULES,
    embed_fn: EmbedFn = embed_hashed,
) -> CommittedTables:
    """Load, clean, index and mark a batch so that readers see its messages,
    chunk vectors and marks together or not at all (see
    :mod:`chatweave.sources.commits`). Running a batch again adds an attempt."""
    spark = chats.sparkSession
    claim_state(spark, state_dir, "batch")
    tables = CommittedTables(spark, state_dir)
    earlier = committed_or_none(tables, "marks", schemas.MARKS, batch_id)
    marks = None if earlier is None else earlier.groupBy("chat_key").agg(F.max(F.struct("mark_time", "mark_id")).alias("_m")).select(
        "chat_key", "_m.mark_time", "_m.mark_id")
    attempt = tables.begin()
    tables.write("scanned", load_messages(store, chats, contacts, marks=marks), batch_id, attempt)
    scanned = spark.read.schema(schemas.MESSAGES).parquet(f"{state_dir}/scanned/batch_id={int(batch_id)}/attempt={attempt}")
    messages = apply_rules(scanned, *rules).withColumn("chat_slug", chat_slug("chat_key"))
    tables.write("messages", messages, batch_id, attempt, ("chat_key", "time", "message_id"))
    tables.write("marks", high_water_mark(scanned), batch_id, attempt)
    written = spark.read.schema(schemas.SAVED_MESSAGES).parquet(f"{state_dir}/messages/batch_id={int(batch_id)}/attempt={attempt}")
    tables.write("chunk_vectors", embed_fn(chunk_greedy(format_lines(written)), "text", "embedding"), batch_id, attempt)
    tables.commit(batch_id, attempt)
    _remove(spark, f"{state_dir}/scanned/batch_id={int(batch_id)}")
    return tables


def index_batch(spark: SparkSession, state_dir: str, batch_id: int, embed_fn: EmbedFn = embed_hashed) -> None:
    """Chunk and embed the messages of one saved batch; write its chunk
    vectors as partition ``batch_id`` (chunks never cross batches).
    ``embed_fn(df, text_col, out_col)`` adds the embedding column."""
    msgs = read_table(spark, state_dir, "messages").where(F.col("batch_id") == batch_id)
    chunks = chunk_greedy(format_lines(msgs))
    vectors = embed_fn(chunks.drop("batch_id"), "text", "embedding")
    sinks.write_batch(vectors, f"{state_dir}/chunk_vectors", batch_id)


TABLES = {"messages": schemas.SAVED_MESSAGES, "marks": schemas.MARKS, "chunk_vectors": schemas.CHUNK_VECTORS}


def read_table(spark: SparkSession, state_dir: str, name: str) -> DataFrame:
    return sinks.read_batches(spark, f"{state_dir}/{name}", TABLES[name])


def stream_ingest(
    spark: SparkSession,
    message_dir: str,
    store: MessageStore,
    chats: DataFrame,
    contacts: DataFrame,
    state_dir: str,
    rules: tuple[Rule, ...] = DEFAULT_RULES,
    index: bool = True,
    embed_fn: EmbedFn = embed_hashed,
) -> None:
    """Process every message file under ``message_dir`` not yet seen, as
    micro-batches (``availableNow``): load, clean, save, and index each one.

    ``store`` supplies the dimension tables (handle, chat, links); the
    stream supplies the messages. Batch ids are ``epoch + 1``.
    """
    claim_state(spark, state_dir, "stream")
    stream = spark.readStream.schema(schemas.MESSAGE).parquet(message_dir)

    def per_batch(batch_df: DataFrame, epoch_id: int) -> None:
        batch_id = int(epoch_id) + 1
        part = MessageStore(store.handle, store.chat, batch_df, store.chat_message_join)
        _ingest(part, chats, contacts, state_dir, batch_id, rules, use_marks=False)
        if index:
            index_batch(batch_df.sparkSession, state_dir, batch_id, embed_fn)

    query = (
        stream.writeStream.foreachBatch(per_batch)
        .option("checkpointLocation", f"{state_dir}/_stream_checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
