"""Registered queries: one per operator of the coverage list, each a
``(spark, sf_dir) -> DataFrame`` over the driver's test tables (bound to the
message-store model by :mod:`chatweave.sources.testdata`). Every query reads
whole tables; the matching DuckDB SQL is in :mod:`chatweave.plans.oracles`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatweave import schemas
from chatweave.functions.text import chat_slug as slug_expr
from chatweave.operators import addresses, chats as chat_ops, load, rules
from chatweave.operators.chunking import chunk_greedy, chunk_grid, format_lines, line_offsets
from chatweave.operators.embed import embed_hashed
from chatweave.operators.pages import join_pages as pages_of
from chatweave.operators.retrieval import build_prompts, generate_context, log_contexts
from chatweave.operators.search import lsh_topk, topk
from chatweave.operators.sequence import with_positions
from chatweave.operators.sessions import chunk_session as session_chunks, sessions as sessions_of
from chatweave.operators.vector_index import search_index, write_index
from chatweave.session import scratch_path, ship_package
from chatweave.sources import layout, sinks, testdata
from chatweave.sources.store import MessageStore
from chatweave.streaming import contact_state, coverage, incremental, senders

# Scenario parameters (fixed): the `since` cut and the time that splits the
# store into a first and a later load for the incremental queries.
SINCE = 5000
SPLIT_TIME = 5000
TOP_K = 10
VECTOR_DIM = 64
RULE_MEMBER = "You"
SILENCE = 30  # message times further apart part two sessions
PAGE_CHARS = 4096
LATE_DROPS = 3  # drops of messages, each followed by its links
LAYOUT_FILE_ROWS = 10_000  # rows per file of the layout by chat

Query = Callable[[SparkSession, str], DataFrame]


def _bind(spark: SparkSession, sf: str):
    ship_package(spark)
    return testdata.bind(spark, sf)


def _loaded(spark, sf) -> DataFrame:
    store, chats, contacts = _bind(spark, sf)
    return load.load_messages(store, chats, contacts)


def _cleaned(spark, sf) -> DataFrame:
    return rules.default_clean(_loaded(spark, sf))


# --- scans, filters, load family ------------------------------------------

def scan_messages(spark, sf):
    store = _bind(spark, sf)[0]
    return store.message.select(
        F.col("rowid").alias("message_id"), "handle_id", "is_from_me", "text",
        F.col("date").alias("time"), F.col("associated_message_type").alias("type"),
    )


def drop_incomplete(spark, sf):
    return scan_messages(spark, sf).dropna(subset=["handle_id", "text", "time", "type"])


def messages_since(spark, sf):
    store, chats, contacts = _bind(spark, sf)
    return load.load_messages(store, chats, contacts, since=SINCE)


def message_index(spark, sf):
    pos = with_positions(_loaded(spark, sf), ["chat_key"], ["time", "message_id"])
    return pos.select("chat_key", "message_id", "time", F.col("_pos").alias("idx"))


def contact_addresses(spark, sf):
    contacts = _bind(spark, sf)[2]
    return addresses.contact_addresses(contacts).select(
        "chat_key", "member_pos", "name", "addr_pos", "raw_address"
    )


def clean_addresses(spark, sf):
    return addresses.contact_addresses(_bind(spark, sf)[2])


def contact_handles(spark, sf):
    store, _chats, contacts = _bind(spark, sf)
    return addresses.contact_handles(contacts, store.handle)


def chat_ids_group(spark, sf):
    store, chats, _ = _bind(spark, sf)
    return chat_ops.chat_ids_group(chats, store.chat)


def chat_ids_individual(spark, sf):
    store, chats, contacts = _bind(spark, sf)
    return chat_ops.chat_ids_individual(chats, contacts, store.chat)


def unresolved_addresses(spark, sf):
    store, _chats, contacts = _bind(spark, sf)
    return addresses.unresolved_addresses(contacts, store.handle)


def unresolved_chats(spark, sf):
    store, chats, contacts = _bind(spark, sf)
    return chat_ops.unresolved_chats(chats, contacts, store.chat)


def load_group(spark, sf):
    store, chats, contacts = _bind(spark, sf)
    return load.load_group(store, chats, contacts)


def load_individual(spark, sf):
    store, chats, contacts = _bind(spark, sf)
    return load.load_individual(store, chats, contacts)


def load_messages(spark, sf):
    return _loaded(spark, sf)


def unknown_senders(spark, sf):
    store, chats, contacts = _bind(spark, sf)
    return load.unknown_senders(store, chats, contacts)


def chat_slug(spark, sf):
    """Folder slugs of every name in the data: chat keys, customer and part
    names, event properties and every line of every document."""
    _bind(spark, sf)
    names = spark.sql(
        "SELECT chat_key AS name FROM chats UNION ALL SELECT c_name FROM customer "
        "UNION ALL SELECT p_name FROM part UNION ALL SELECT props FROM events "
        "UNION ALL SELECT explode(split(text, '\\n')) FROM documents"
    ).distinct()
    return names.select("name", slug_expr("name").alias("chat_slug"))


# --- rules ------------------------------------------------------------------

def rule_standard_only(spark, sf):
    return rules.remove_non_standard_messages(_loaded(spark, sf))


def rule_has_word(spark, sf):
    """Word filter over every space-separated token of every document."""
    docs = testdata.table(spark, sf, "documents")
    toks = docs.select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "text"))
    return rules.remove_non_alphanumeric_messages(toks).select(
        "doc_id", F.col("pos").cast("long").alias("pos"), "text"
    )


def rule_remove_links(spark, sf):
    """Links removed from every page: its url in a sentence, then its html."""
    pages = testdata.table(spark, sf, "pages")
    msgs = pages.select(
        "page_id", F.concat(F.lit("see "), "url", F.lit(" ok\n"), "html").alias("text")
    )
    return rules.remove_links(msgs)


def rule_remove_member(spark, sf):
    return rules.remove_member(_loaded(spark, sf), RULE_MEMBER)


def _with_rank(ordered: DataFrame) -> DataFrame:
    """The place of each row in the order its rule gave it: partitions of a
    global sort are consecutive, so ids that grow along them show the order."""
    marked = ordered.withColumn("_at", F.monotonically_increasing_id())
    return with_positions(marked.withColumn("_all", F.lit(0)), ["_all"], ["_at"]).withColumn("rank", F.col("_pos") + 1).drop("_all", "_at", "_pos")


def rule_reverse_order(spark, sf):
    return _with_rank(rules.reverse_order(_loaded(spark, sf)))


def apply_rules(spark, sf):
    return _with_rank(rules.apply_rules(
        _loaded(spark, sf),
        rules.Rule(rules.remove_member, {"member": RULE_MEMBER}),
        rules.Rule(rules.reverse_order),
    ))


def default_clean(spark, sf):
    return _cleaned(spark, sf)


# --- lines and chunks --------------------------------------------------------

def format_lines_q(spark, sf):
    return format_lines(_cleaned(spark, sf))


def join_texts(spark, sf):
    return line_offsets(format_lines(_cleaned(spark, sf)))


def join_pages(spark, sf):
    return pages_of(format_lines(_cleaned(spark, sf)), PAGE_CHARS)


def sessions(spark, sf):
    return sessions_of(format_lines(_cleaned(spark, sf)), SILENCE)


def chunk_session(spark, sf):
    return session_chunks(format_lines(_cleaned(spark, sf)), SILENCE)


def chunk_grid_q(spark, sf):
    return chunk_grid(format_lines(_cleaned(spark, sf)))


def chunk_greedy_q(spark, sf):
    return chunk_greedy(format_lines(_cleaned(spark, sf)))


# --- vectors and retrieval ---------------------------------------------------

def embed_hashed_q(spark, sf):
    docs = testdata.table(spark, sf, "documents")
    return embed_hashed(docs.select("doc_id", "text"), "text", "embedding").select("doc_id", "embedding")


def _embeddings(spark, sf):
    return testdata.table(spark, sf, "embeddings")


def similarity_topk(spark, sf):
    e = _embeddings(spark, sf)
    return topk(e.withColumnRenamed("vec_id", "query_id"), e, k=TOP_K, group_cols=("label",),
                item_keys=("vec_id",), query_key="query_id")


def similarity_topk_cosine(spark, sf):
    e = _embeddings(spark, sf)
    return topk(e.withColumnRenamed("vec_id", "query_id"), e, k=TOP_K, group_cols=("label",),
                item_keys=("vec_id",), query_key="query_id", metric="cosine")


def similarity_lsh(spark, sf):
    e = _embeddings(spark, sf)
    return lsh_topk(e.withColumnRenamed("vec_id", "query_id"), e, dim=VECTOR_DIM, k=TOP_K, group_cols=("label",),
                    item_keys=("vec_id",), query_key="query_id")


def _stored_search(spark, sf, metric: str) -> DataFrame:
    """The vectors in two batches of one stored index, then every vector asked."""
    e, path = _embeddings(spark, sf), scratch_path(spark, "vector_index")
    for batch in (0, 1):
        index = write_index(e.where(F.pmod("vec_id", F.lit(2)) == batch), path, group_cols=("label",), item_keys=("vec_id",), metric=metric, batch_id=batch)
    return search_index(index, e.withColumnRenamed("vec_id", "query_id"), TOP_K)


def index_search(spark, sf):
    return _stored_search(spark, sf, "l2")


def index_search_cosine(spark, sf):
    return _stored_search(spark, sf, "cosine")


def _chunk_vectors(spark, sf) -> DataFrame:
    chunks = chunk_greedy(format_lines(_cleaned(spark, sf)))
    return embed_hashed(chunks, "text", "embedding")


def index_build(spark, sf):
    """Chunk, embed and write the index; the result is the table read back."""
    path = scratch_path(spark, "chunk_vectors")
    sinks.write_batch(_chunk_vectors(spark, sf).drop("batch_id"), path, 0)
    return sinks.read_batches(spark, path, schemas.CHUNK_VECTORS).select("chat_key", "batch_id", "chunk_no", "text", "embedding")


def _questions(spark, sf) -> DataFrame:
    """Every message the user wrote is asked back to its own chat."""
    return (
        _loaded(spark, sf)
        .where(F.col("sender") == "You")
        .select(F.col("message_id").alias("query_id"), "chat_key", F.col("text").alias("query"))
        .distinct()
    )


def _contexts(spark, sf) -> DataFrame:
    path = scratch_path(spark, "chunk_vectors")
    sinks.write_batch(_chunk_vectors(spark, sf).drop("batch_id"), path, 0)
    chunks = sinks.read_batches(spark, path, schemas.CHUNK_VECTORS)
    index = write_index(chunks, f"{path}-index", item_keys=("batch_id", "chunk_no"))
    return generate_context(_questions(spark, sf), chunks, k=TOP_K, index=index)


def generate_context_q(spark, sf):
    return _contexts(spark, sf)


def build_prompts_q(spark, sf):
    return build_prompts(_contexts(spark, sf))


def retrieval_log(spark, sf):
    path = scratch_path(spark, "contexts_log")
    log_contexts(_contexts(spark, sf), path)
    return spark.read.schema("query_id long, chat_key string, query string, context string").json(path)


# --- saving and incremental loads --------------------------------------------

def high_water_mark(spark, sf):
    return incremental.high_water_mark(_loaded(spark, sf))


def save_messages(spark, sf):
    """Save the messages up to the split, then append the later ones."""
    path = scratch_path(spark, "messages")
    cleaned = _cleaned(spark, sf)
    sinks.save_messages(cleaned.where(F.col("time") <= SPLIT_TIME), path, 1)
    sinks.save_messages(cleaned.where(F.col("time") > SPLIT_TIME), path, 2)
    return sinks.read_saved_messages(spark, path)


def _two_loads(spark, sf) -> str:
    """Run the incremental loader on the store as it was at the split time,
    then on the whole store; returns the state folder."""
    store, chats, contacts = _bind(spark, sf)
    state = scratch_path(spark, "ingest")
    early = MessageStore(store.handle, store.chat, store.message.where(F.col("date") <= SPLIT_TIME),
                         store.chat_message_join)
    incremental.ingest_batch(early, chats, contacts, state, 1)
    incremental.ingest_batch(store, chats, contacts, state, 2)
    return state


def incremental_ingest(spark, sf):
    return incremental.read_table(spark, _two_loads(spark, sf), "messages")


def index_append(spark, sf):
    state = _two_loads(spark, sf)
    incremental.index_batch(spark, state, 1)
    incremental.index_batch(spark, state, 2)
    return incremental.read_table(spark, state, "chunk_vectors").select(
        "chat_key", "batch_id", "chunk_no", "text", "embedding"
    )


def incremental_stream(spark, sf):
    """Structured Streaming: message files arrive in two drops."""
    store, chats, contacts = _bind(spark, sf)
    state = scratch_path(spark, "stream")
    inbox = f"{state}/inbox"
    store.message.where(F.col("date") <= SPLIT_TIME).write.parquet(f"{inbox}/drop=1")
    incremental.stream_ingest(spark, inbox, store, chats, contacts, state)
    store.message.where(F.col("date") > SPLIT_TIME).write.parquet(f"{inbox}/drop=2")
    incremental.stream_ingest(spark, inbox, store, chats, contacts, state)
    return incremental.read_table(spark, state, "messages")


def late_rows(spark, sf):
    """Three loads of a store that grows out of order: a third of the messages
    (of any date) come in the second, a fifth of the links in the third."""
    store, chats, contacts = _bind(spark, sf)
    state = scratch_path(spark, "covered")
    early_messages = store.message.where(F.pmod("rowid", F.lit(3)) > 0)
    early_links = store.chat_message_join.where(F.pmod("message_id", F.lit(5)) > 0)
    for n, (messages, links) in enumerate(((early_messages, early_links), (store.message, early_links), (store.message, store.chat_message_join))):
        coverage.ingest_uncovered(MessageStore(store.handle, store.chat, messages, links), chats, contacts, state, n + 1)
    return incremental.read_table(spark, state, "messages").drop("chat_slug", "batch_id")


def late_links_stream(spark, sf):
    """Structured Streaming: messages arrive in three drops, the links of each
    one drop later."""
    store, chats, contacts = _bind(spark, sf)
    state = scratch_path(spark, "late-links")
    width = (store.message.agg(F.max("rowid")).first()[0] or 0) // LATE_DROPS + 1
    inbox = {"message": (store.message, "rowid"), "link": (store.chat_message_join, "message_id")}
    for name, (rows, _) in inbox.items():  # so that both streams have a schema and a folder from the start
        rows.limit(0).write.parquet(f"{state}/{name}/drop=-1")
    for step in range(LATE_DROPS + 1):
        for (name, (rows, row_id)), drop in zip(inbox.items(), (step, step - 1)):
            rows.where(F.floor(F.col(row_id) / width) == drop).write.parquet(f"{state}/{name}/drop={step}")
        coverage.stream_joined(spark, f"{state}/message", f"{state}/link", store, chats, contacts, state, wait=2 * width)
    return incremental.read_table(spark, state, "messages").drop("chat_slug", "batch_id")


def contact_handles_delta(spark, sf):
    """Contact handles kept up to date over three updates: handles and
    definitions come in parts, and some addresses before their handles."""
    store, _chats, contacts = _bind(spark, sf)
    state = scratch_path(spark, "contacts")
    part = lambda rows, col, n: rows.where(F.pmod(F.xxhash64(col), F.lit(3)) <= n)
    for n in range(3):
        contact_state.update_contact_handles(part(contacts, "chat_key", n), part(store.handle, "rowid", n), state, n + 1)
    return contact_state.maintained_contact_handles(contacts, store.handle, state)


def _streamed_totals(spark, sf):
    store, chats, contacts = _bind(spark, sf)
    state = scratch_path(spark, "senders")
    for n, drop in ((1, F.col("date") <= SPLIT_TIME), (2, F.col("date") > SPLIT_TIME)):
        store.message.where(drop).write.parquet(f"{state}/inbox/drop={n}")
        senders.stream_totals(spark, f"{state}/inbox", store, state)
    return state, store, chats, contacts


def unknown_senders_stream(spark, sf):
    state, *known = _streamed_totals(spark, sf)
    return senders.unknown_senders_now(spark, state, *known)


def high_water_mark_stream(spark, sf):
    state, *known = _streamed_totals(spark, sf)
    return senders.marks_now(spark, state, *known)


def _committed(spark, sf):
    """Two loads, the second one run twice."""
    store, chats, contacts = _bind(spark, sf)
    state = scratch_path(spark, "committed")
    early = MessageStore(store.handle, store.chat, store.message.where(F.col("date") <= SPLIT_TIME), store.chat_message_join)
    incremental.load_committed(early, chats, contacts, state, 1)
    incremental.load_committed(store, chats, contacts, state, 2)
    return incremental.load_committed(store, chats, contacts, state, 2)


def committed_messages(spark, sf):
    return _committed(spark, sf).read("messages", schemas.SAVED_MESSAGES)


def committed_vectors(spark, sf):
    return _committed(spark, sf).read("chunk_vectors", schemas.CHUNK_VECTORS).select("chat_key", "batch_id", "chunk_no", "text", "embedding")


def _laid_out(spark, sf) -> str:
    path = scratch_path(spark, "by-chat")
    layout.write_by_chat(_cleaned(spark, sf), path, 1, file_rows=LAYOUT_FILE_ROWS)
    return path


def ordered_export(spark, sf):
    """Every message with its place in the whole order, taken from the number
    of its file and its place in the file."""
    return layout.ranked(spark, _laid_out(spark, sf), 1).select("rank", "chat_slug", "chat_key", "time", "message_id", "sender", "text", "type")


def read_chat(spark, sf):
    """The chat with most messages, read from the files that can hold it."""
    path = _laid_out(spark, sf)
    largest = layout.read_messages(spark, path).groupBy("chat_slug").count().orderBy(F.desc("count"), "chat_slug").first()
    chat = layout.read_chat(spark, path, largest.chat_slug if largest else "")
    return chat.select("chat_slug", "chat_key", "message_id", "sender", "text", "time", "type")


def stream_index(spark, sf):
    """The chunk vectors that the stream of ``incremental_stream`` indexed."""
    store, chats, contacts = _bind(spark, sf)
    state = scratch_path(spark, "stream")
    inbox = f"{state}/inbox"
    for n, drop in ((1, F.col("date") <= SPLIT_TIME), (2, F.col("date") > SPLIT_TIME)):
        store.message.where(drop).write.parquet(f"{inbox}/drop={n}")
        incremental.stream_ingest(spark, inbox, store, chats, contacts, state)
    return incremental.read_table(spark, state, "chunk_vectors").select("chat_key", "batch_id", "chunk_no", "text", "embedding")


def csv_roundtrip(spark, sf):
    path = scratch_path(spark, "messages_csv")
    sinks.write_csv(_cleaned(spark, sf), path)
    return sinks.read_csv(spark, path)


QUERIES: dict[str, Query] = {
    "scan_messages": scan_messages,
    "drop_incomplete": drop_incomplete,
    "messages_since": messages_since,
    "message_index": message_index,
    "contact_addresses": contact_addresses,
    "clean_addresses": clean_addresses,
    "contact_handles": contact_handles,
    "chat_ids_group": chat_ids_group,
    "chat_ids_individual": chat_ids_individual,
    "unresolved_addresses": unresolved_addresses,
    "unresolved_chats": unresolved_chats,
    "load_group": load_group,
    "load_individual": load_individual,
    "load_messages": load_messages,
    "unknown_senders": unknown_senders,
    "chat_slug": chat_slug,
    "rule_standard_only": rule_standard_only,
    "rule_has_word": rule_has_word,
    "rule_remove_links": rule_remove_links,
    "rule_remove_member": rule_remove_member,
    "rule_reverse_order": rule_reverse_order,
    "apply_rules": apply_rules,
    "default_clean": default_clean,
    "format_lines": format_lines_q,
    "join_texts": join_texts,
    "join_pages": join_pages,
    "sessions": sessions,
    "chunk_session": chunk_session,
    "chunk_grid": chunk_grid_q,
    "chunk_greedy": chunk_greedy_q,
    "embed_hashed": embed_hashed_q,
    "similarity_topk": similarity_topk,
    "similarity_topk_cosine": similarity_topk_cosine,
    "similarity_lsh": similarity_lsh,
    "index_search": index_search,
    "index_search_cosine": index_search_cosine,
    "index_build": index_build,
    "generate_context": generate_context_q,
    "build_prompts": build_prompts_q,
    "retrieval_log": retrieval_log,
    "high_water_mark": high_water_mark,
    "save_messages": save_messages,
    "incremental_ingest": incremental_ingest,
    "index_append": index_append,
    "incremental_stream": incremental_stream,
    "stream_index": stream_index,
    "late_rows": late_rows,
    "late_links_stream": late_links_stream,
    "contact_handles_delta": contact_handles_delta,
    "unknown_senders_stream": unknown_senders_stream,
    "high_water_mark_stream": high_water_mark_stream,
    "committed_messages": committed_messages,
    "committed_vectors": committed_vectors,
    "ordered_export": ordered_export,
    "read_chat": read_chat,
    "csv_roundtrip": csv_roundtrip,
}
