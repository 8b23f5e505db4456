"""Load the messages of many chats at once.

One plan for every definition: chat ids are resolved first (small joins
over the definitions), links are cut to those ids, and the big ``message``
scan is joined once on its row id. Projection and the ``since`` filter reach
the parquet scan. No explicit broadcast hints: adaptive execution turns a
join into a broadcast only when the measured side is small, and splits
skewed partitions (a chat holding a large share of all messages) otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatweave.operators.addresses import contact_addresses, sender_map, unresolved_addresses
from chatweave.operators.chats import chat_ids, unresolved_chats
from chatweave.session import materialize
from chatweave.sources.store import MessageStore

OUTPUT_COLUMNS = ["chat_key", "message_id", "sender", "text", "time", "type"]

# Distinct join keys given to rows that need no sender-map or address
# lookup (handle row ids are never negative, so these match nothing).
JOIN_SALTS = 4096


def _definitions(chats: DataFrame, contacts: DataFrame) -> DataFrame:
    """``(chat_key, kind, user_name, other_name)``; ``other_name`` is the
    contact of a one-to-one chat."""
    people = (
        contacts.join(chats.where(F.col("kind") == "individual").select("chat_key"), "chat_key", "left_semi")
        .groupBy("chat_key")
        .agg(F.min_by("name", "member_pos").alias("other_name"))
    )
    return chats.select("chat_key", "kind", "user_name").join(people, "chat_key", "left")


def labelled_messages(
    store: MessageStore,
    chats: DataFrame,
    contacts: DataFrame,
    since=None,
    marks: DataFrame | None = None,
    kinds: tuple[str, ...] = ("group", "individual"),
    pairs: DataFrame | None = None,
    members: DataFrame | None = None,
) -> DataFrame:
    """Messages with sender resolution detail: output columns plus ``kind``,
    ``handle_id``, ``is_from_me``, ``member_name`` and ``handle_address``
    (the latter only where it is used: group senders without a member name).

    ``since``: keep ``time > since`` (strict). ``marks``: per-chat cursor
    ``(chat_key, mark_time, mark_id)``; keep rows after ``(time, message_id)``.
    The earliest mark is a literal lower bound of the message scan; chats
    without a mark are scanned whole in a branch of their own. ``pairs``:
    ``(chat_key, chat_id, message_id)`` to load in place of all links.
    ``members``: contact handles that are known already.
    """
    chats = chats.where(F.col("kind").isin(list(kinds)))
    # Everything per chat (definition, cursor) rides on the small chat-id
    # table, so the big message side is joined once on its id and never on
    # the chat key (which one large chat would make a hot key).
    per_chat = chat_ids(chats, contacts, store.chat).join(
        _definitions(chats, contacts).drop("kind"), "chat_key", "left"
    )
    if "group" in kinds:
        # read twice (handle 0, the others): computed once, a row per member
        names = materialize(sender_map(chats, contacts, store.handle, members).withColumnRenamed("name", "member_name"))
        # The name of handle 0 (the user, or a member mapped to it) also
        # rides on the chat-id table: the user's own messages need no join.
        per_chat = per_chat.join(
            names.where(F.col("handle_id") == 0).select("chat_key", F.col("member_name").alias("_zero_name")),
            "chat_key", "left",
        )
    else:
        per_chat = per_chat.withColumn("_zero_name", F.lit(None).cast("string"))
    msg = store.message.select(
        F.col("rowid").alias("message_id"),
        "handle_id",
        "is_from_me",
        "text",
        F.col("date").alias("time"),
        F.col("associated_message_type").alias("type"),
    ).where(F.col("text").isNotNull() & F.col("time").isNotNull() & F.col("type").isNotNull())
    if since is not None:
        msg = msg.where(F.col("time") > F.lit(since))

    def linked(messages: DataFrame, definitions: DataFrame, *more: str) -> DataFrame:
        source, on = (store.chat_message_join, ["chat_id"]) if pairs is None else (pairs, ["chat_key", "chat_id"])
        links = source.join(definitions, on).select(
            "chat_key", "kind", "message_id", "user_name", "other_name", "_zero_name", *more
        )
        return messages.join(links, "message_id").where(
            F.when(F.col("kind") == "group", F.col("handle_id").isNotNull()).otherwise(F.col("is_from_me").isNotNull())
        )

    if marks is None:
        joined = linked(msg, per_chat)
    else:
        per_chat = materialize(per_chat.join(marks.select("chat_key", "mark_time", "mark_id"), "chat_key", "left"))
        marked = per_chat.where(F.col("mark_time").isNotNull())
        fresh = per_chat.where(F.col("mark_time").isNull()).drop("mark_time", "mark_id")
        earliest = marked.agg(F.min("mark_time")).first()[0]
        parts = []
        if earliest is not None:
            parts.append(linked(msg.where(F.col("time") >= F.lit(earliest)), marked, "mark_time", "mark_id").where(
                (F.col("time") > F.col("mark_time"))
                | ((F.col("time") == F.col("mark_time")) & (F.col("message_id") > F.col("mark_id")))
            ).drop("mark_time", "mark_id"))
        if earliest is None or fresh.limit(1).count():
            parts.append(linked(msg, fresh))
        joined = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    if "group" in kinds:
        # Rows that need no lookup (the user's own messages -- possibly a
        # large share of all rows under one handle id --, one-to-one chats,
        # and for the address, members) get a spread negative key that
        # matches no handle, so no single key gathers them in one task.
        salt = -1 - F.pmod(F.xxhash64("message_id"), F.lit(JOIN_SALTS))
        group = F.col("kind") == "group"
        by_member = group & (F.col("handle_id") != 0)
        joined = (
            joined.withColumn("_name_key", F.when(by_member, F.col("handle_id")).otherwise(salt))
            .join(
                names.where(F.col("handle_id") != 0).withColumnRenamed("handle_id", "_name_key"),
                ["chat_key", "_name_key"], "left",
            )
            .withColumn(
                "member_name",
                F.when(group & (F.col("handle_id") == 0), F.col("_zero_name")).otherwise(F.col("member_name")),
            )
            .drop("_name_key", "_zero_name")
        )
        # Only group senders without a member name fall back to the address.
        needs_address = group & (F.col("member_name").isNull() | (F.col("member_name") == ""))
        addresses = store.handle.select(F.col("rowid").alias("_addr_key"), F.col("id").alias("handle_address"))
        joined = (
            joined.withColumn("_addr_key", F.when(needs_address, F.col("handle_id")).otherwise(salt))
            .join(addresses, "_addr_key", "left")
            .drop("_addr_key")
        )
    else:
        joined = joined.drop("_zero_name").withColumn("member_name", F.lit(None).cast("string")).withColumn(
            "handle_address", F.lit(None).cast("string")
        )

    group_sender = F.coalesce(
        F.nullif(F.col("member_name"), F.lit("")),
        F.col("handle_address"),
        F.concat(F.lit("unknown:"), F.col("handle_id").cast("string")),
    )
    person_sender = F.when(F.col("is_from_me") == 1, F.col("user_name")).otherwise(F.col("other_name"))
    sender = F.when(F.col("kind") == "individual", person_sender).otherwise(group_sender)
    return joined.select(
        "chat_key", "message_id", sender.alias("sender"), "text", "time", "type",
        "kind", "handle_id", "is_from_me", "member_name", "handle_address",
    )


class UnresolvedDefinitionError(ValueError):
    """A chat definition that cannot be resolved (strict loads only)."""


def definition_problems(store: MessageStore, chats: DataFrame, contacts: DataFrame) -> DataFrame:
    """``(chat_key, kind, detail, reason)``: what the reference raises on.

    Group chats: a name with no chat, a member address that is invalid or
    matches no handle. One-to-one chats: an invalid address, or one that
    matches no chat identifier. Rows, so every problem of every chat is
    reported at once.
    """
    groups = chats.where(F.col("kind") == "group").select("chat_key")
    people = chats.where(F.col("kind") == "individual").select("chat_key")
    bad_member = (
        unresolved_addresses(contacts, store.handle)
        .join(groups, "chat_key", "left_semi")
        .select("chat_key", F.lit("group").alias("kind"), F.col("raw_address").alias("detail"), "reason")
    )
    bad_person = (
        contact_addresses(contacts)
        .where(F.col("status") != "ok")
        .join(people, "chat_key", "left_semi")
        .select("chat_key", F.lit("individual").alias("kind"), F.col("raw_address").alias("detail"),
                F.col("status").alias("reason"))
    )
    no_chat = unresolved_chats(chats, contacts, store.chat).select(
        "chat_key", "kind", "detail", F.lit("no chat").alias("reason")
    )
    return bad_member.unionByName(bad_person).unionByName(no_chat)


def select_chats(chats: DataFrame, keys: list[str]) -> DataFrame:
    """The definitions of ``keys``; an undefined key raises ``KeyError``
    (as asking the reference for an unknown chat does). ``keys`` is a
    user-given list, so the check collects at most ``len(keys)`` rows."""
    wanted = chats.where(F.col("chat_key").isin(list(keys)))
    found = {r.chat_key for r in wanted.select("chat_key").distinct().collect()}
    missing = [k for k in keys if k not in found]
    if missing:
        raise KeyError(f"chats not defined: {missing}")
    return wanted


def require_resolved(store: MessageStore, chats: DataFrame, contacts: DataFrame, show: int = 20) -> None:
    """Raise ``UnresolvedDefinitionError`` if any definition has a problem.
    Only the first ``show`` problems travel to the driver, for the message."""
    sample = definition_problems(store, chats, contacts).limit(show).collect()
    if sample:
        lines = "; ".join(f"{r.chat_key} ({r.kind}): {r.detail!r} {r.reason}" for r in sample)
        raise UnresolvedDefinitionError(f"unresolved chat definitions: {lines}")


def load_messages(
    store: MessageStore,
    chats: DataFrame,
    contacts: DataFrame,
    since=None,
    marks: DataFrame | None = None,
    kinds: tuple[str, ...] = ("group", "individual"),
    ordered: bool = False,
    strict: bool = False,
    dedupe: bool = False,
    pairs: DataFrame | None = None,
    members: DataFrame | None = None,
) -> DataFrame:
    """``(chat_key, message_id, sender, text, time, type)`` of every defined chat.

    ``ordered=True`` sorts by ``(chat_key, time, message_id)``: a range
    partitioned sort, so one large chat is spread over many tasks.
    ``strict=True`` first raises on unresolvable definitions (see
    ``definition_problems``); otherwise they load no messages and are
    reported by ``definition_problems``. ``dedupe=True`` keeps a message
    that is linked to several chat ids of one definition once. ``pairs``,
    ``members``: see ``labelled_messages``.
    """
    if strict:
        require_resolved(store, chats.where(F.col("kind").isin(list(kinds))), contacts)
    df = labelled_messages(store, chats, contacts, since, marks, kinds, pairs, members).select(*OUTPUT_COLUMNS)
    if dedupe:
        df = df.dropDuplicates(["chat_key", "message_id"])
    return df.orderBy("chat_key", "time", "message_id") if ordered else df


def load_group(store, chats, contacts, since=None, ordered=False, strict=False) -> DataFrame:
    return load_messages(store, chats, contacts, since, kinds=("group",), ordered=ordered, strict=strict)


def load_individual(store, chats, contacts, since=None, ordered=False, strict=False) -> DataFrame:
    return load_messages(store, chats, contacts, since, kinds=("individual",), ordered=ordered, strict=strict)


def unknown_senders(store, chats, contacts, since=None) -> DataFrame:
    """Group-chat senders that are not members: ``(chat_key, handle_id,
    address, first_time, first_message_id, n_messages)``. The reference's
    list is in first-seen order, i.e. ordered by ``(first_time,
    first_message_id)``. Partial aggregation runs before the shuffle."""
    df = labelled_messages(store, chats, contacts, since, kinds=("group",))
    unknown = df.where(F.col("member_name").isNull() | (F.col("member_name") == ""))
    return (
        unknown.groupBy("chat_key", "handle_id")
        .agg(
            F.min("sender").alias("address"),  # one value per (chat, handle)
            F.min(F.struct("time", "message_id")).alias("_first"),
            F.count(F.lit(1)).alias("n_messages"),
        )
        .select(
            "chat_key", "handle_id", "address",
            F.col("_first.time").alias("first_time"),
            F.col("_first.message_id").alias("first_message_id"),
            "n_messages",
        )
    )
