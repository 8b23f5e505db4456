"""Contexts and prompts for tables of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatweave.operators.embed import EmbedFn, embed_hashed
from chatweave.operators.search import topk
from chatweave.operators.vector_index import StoredIndex, search_index
from chatweave.session import join_bounded, materialize

# Documents per context, their separator, and the prompt texts.
NUM_DOCUMENTS = 10
CONTEXT_SEPARATOR = "\n###\n"
SYSTEM_PROMPT = (
    "You are a helpful assistant designed to respond to a question "
    "based on the context provided. "
    "The context will be in the form of multiple series of text messages. "
    "If you don't know the answer based on the context, "
    "say you don't know and make an inference based on your prior knowledge."
)
USER_PROMPT_PREFIX = "Context:\n"
USER_PROMPT_QUESTION = "\n\nQuestion: "
# Hits that go to the chunk texts, rather than the texts to them (60 bytes each).
HITS_SENT = 100_000
# Completion settings, carried with each prompt row for a downstream scorer
# (no model is called here).
COMPLETION_SETTINGS = {"temperature": 0.7, "frequency_penalty": 0.3, "max_tokens": 500}


def retrieve(
    questions: DataFrame,
    chunk_vectors: DataFrame,
    k: int = NUM_DOCUMENTS,
    metric: str = "l2",
    embed_fn: EmbedFn = embed_hashed,
    index: StoredIndex | None = None,
) -> DataFrame:
    """Top-k chunks of the question's chat for every question.

    ``questions``: ``(query_id, chat_key, query)``, embedded here by
    ``embed_fn`` unless an ``embedding`` column is present.
    ``chunk_vectors``: ``(chat_key, batch_id, chunk_no, text, embedding)``; a
    stored ``index`` of them is read in part (its metric counts), without one
    blocks are built for this search.
    Returns ``(query_id, chat_key, batch_id, chunk_no, rank, distance, text)``.
    """
    if "embedding" not in questions.columns:
        questions = embed_fn(questions, "query", "embedding")
    if index is not None:
        hits = search_index(index, questions, k)
    else:
        hits = topk(
            questions, chunk_vectors, k=k, group_cols=("chat_key",), item_keys=("batch_id", "chunk_no"),
            query_key="query_id", metric=metric,
        )
    texts = chunk_vectors.select("chat_key", "batch_id", "chunk_no", "text")
    return join_bounded(texts, materialize(hits), ["chat_key", "batch_id", "chunk_no"], "inner", HITS_SENT).select(
        "query_id", "chat_key", "batch_id", "chunk_no", "rank", "distance", "text"
    )


def generate_context(
    questions: DataFrame, chunk_vectors: DataFrame, k: int = NUM_DOCUMENTS, metric: str = "l2", embed_fn: EmbedFn = embed_hashed,
    index: StoredIndex | None = None,
) -> DataFrame:
    """``(query_id, chat_key, query, context)``: the top-k chunk texts joined
    by the separator in rank order. A group holds at most ``k`` rows; one
    query id may ask several chats."""
    if "embedding" not in questions.columns:
        questions = embed_fn(questions, "query", "embedding")
    # the questions feed the search and the final join: computed once
    questions = materialize(questions.select("query_id", "chat_key", "query", "embedding"))
    hits = retrieve(questions, chunk_vectors, k, metric, index=index)
    ctx = hits.groupBy("query_id", "chat_key").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]),
            CONTEXT_SEPARATOR,
        ).alias("context")
    )
    return (
        questions.select("query_id", "chat_key", "query")
        .join(ctx, ["query_id", "chat_key"], "left")
        .withColumn("context", F.coalesce("context", F.lit("")))
    )


def build_prompts(contexts: DataFrame) -> DataFrame:
    """Chat messages per question, one row per message: ``(query_id, chat_key,
    msg_pos, role, content)`` -- the system instruction, then the context and
    the question -- and the completion settings."""
    user = F.concat(F.lit(USER_PROMPT_PREFIX), F.col("context"), F.lit(USER_PROMPT_QUESTION), F.col("query"))
    msgs = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_PROMPT).alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
    )
    settings = [F.lit(v).alias(name) for name, v in COMPLETION_SETTINGS.items()]
    return contexts.select("query_id", "chat_key", F.posexplode(msgs).alias("msg_pos", "m")).select(
        "query_id", "chat_key", F.col("msg_pos").cast("int").alias("msg_pos"), "m.role", "m.content", *settings
    )


def log_contexts(contexts: DataFrame, path: str) -> None:
    """Append ``(query_id, chat_key, query, context)`` to a JSON-lines log."""
    contexts.select("query_id", "chat_key", "query", "context").write.mode("append").json(path)
