"""Chat ids of chat definitions (B10, C3), rejects (C6) and folder slugs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatweave.operators.addresses import valid_addresses
from chatweave.operators.containment import containment_join


# Chats without a display name (every one-to-one chat) are spread over this
# many join keys; a definition with an empty name meets all of them.
UNNAMED_SALTS = 64


def chat_ids_group(chats: DataFrame, chat: DataFrame) -> DataFrame:
    """``(chat_key, chat_id)``: chats whose display name equals the group's
    name (exact, case-sensitive); one name may have several ids."""
    groups = chats.where(F.col("kind") == "group").select("chat_key", "display_name")
    unnamed = F.col("display_name") == ""
    ids = chat.select(
        F.col("rowid").alias("chat_id"), "display_name",
        F.when(unnamed, F.pmod(F.xxhash64("rowid"), F.lit(UNNAMED_SALTS)).cast("int")).otherwise(F.lit(0)).alias("_salt"),
    )
    salts = F.when(unnamed, F.sequence(F.lit(0), F.lit(UNNAMED_SALTS - 1))).otherwise(F.array(F.lit(0)))
    return groups.withColumn("_salt", F.explode(salts)).join(ids, ["display_name", "_salt"]).select("chat_key", "chat_id")


def chat_ids_individual(chats: DataFrame, contacts: DataFrame, chat: DataFrame) -> DataFrame:
    """``(chat_key, addr_pos, address, chat_id)``: chats whose identifier
    contains one of the other person's addresses (case-insensitive, LIKE
    wildcards kept). In list form ordered by ``(addr_pos, chat_id)``."""
    people = chats.where(F.col("kind") == "individual").select("chat_key")
    addrs = valid_addresses(contacts).join(people, "chat_key", "left_semi")
    ids = chat.select(F.col("rowid").alias("chat_id"), F.col("chat_identifier"))
    pairs = containment_join(ids, "chat_identifier", addrs.select("chat_key", "addr_pos", "address"), "address")
    return pairs.select("chat_key", "addr_pos", "address", "chat_id")


def chat_ids(chats: DataFrame, contacts: DataFrame, chat: DataFrame) -> DataFrame:
    """Distinct ``(chat_key, kind, chat_id)`` of every definition."""
    g = chat_ids_group(chats, chat).withColumn("kind", F.lit("group"))
    i = chat_ids_individual(chats, contacts, chat).select("chat_key", "chat_id").withColumn("kind", F.lit("individual"))
    return g.unionByName(i).distinct()


def unresolved_chats(chats: DataFrame, contacts: DataFrame, chat: DataFrame) -> DataFrame:
    """Definitions that resolve to nothing: a group name with no chat, or an
    individual address that matches no chat identifier. ``(chat_key, kind,
    addr_pos, detail)``; ``addr_pos`` is null for groups."""
    groups = chats.where(F.col("kind") == "group")
    no_group = groups.join(chat_ids_group(chats, chat), "chat_key", "left_anti").select(
        "chat_key", F.lit("group").alias("kind"), F.lit(None).cast("int").alias("addr_pos"),
        F.col("display_name").alias("detail"),
    )
    people = chats.where(F.col("kind") == "individual").select("chat_key")
    addrs = valid_addresses(contacts).join(people, "chat_key", "left_semi")
    found = chat_ids_individual(chats, contacts, chat).select("chat_key", "addr_pos").distinct()
    no_person = addrs.join(found, ["chat_key", "addr_pos"], "left_anti").select(
        "chat_key", F.lit("individual").alias("kind"), "addr_pos", F.col("address").alias("detail"),
    )
    return no_group.unionByName(no_person)

