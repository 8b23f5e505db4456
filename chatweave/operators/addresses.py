"""Contact addresses: cleaning (H1-H3), address -> handles (C2, E5), rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatweave.functions.text import address_status, clean_address
from chatweave.operators.containment import containment_join


def contact_addresses(contacts: DataFrame) -> DataFrame:
    """One row per typed address: ``(chat_key, member_pos, name, addr_pos,
    raw_address, address, status)``.

    ``address`` is the cleaned form (e-mails unchanged, phones reduced to
    digits); ``status`` is 'ok', 'too short', 'too long' or 'no address'
    (a contact with an empty address list).
    """
    exploded = contacts.select(
        "chat_key",
        "member_pos",
        "name",
        F.posexplode_outer("addresses").alias("addr_pos", "raw_address"),
    )
    return exploded.select(
        "chat_key",
        "member_pos",
        "name",
        F.col("addr_pos").cast("int").alias("addr_pos"),
        "raw_address",
        clean_address("raw_address").alias("address"),
        F.when(F.col("raw_address").isNull(), F.lit("no address"))
        .otherwise(address_status("raw_address"))
        .alias("status"),
    )


def valid_addresses(contacts: DataFrame) -> DataFrame:
    return contact_addresses(contacts).where(F.col("status") == "ok")


def contact_handles(contacts: DataFrame, handle: DataFrame, literal: bool = False) -> DataFrame:
    """Every handle whose id contains a contact's cleaned address
    (case-insensitive, LIKE wildcards kept): ``(chat_key, member_pos, name,
    addr_pos, address, handle_id)``. In the reference's list form the ids
    are ordered by ``(addr_pos, handle_id)``, duplicates kept. With
    ``literal=True`` a ``%`` or ``_`` in an address stands for itself."""
    addrs = valid_addresses(contacts).select("chat_key", "member_pos", "name", "addr_pos", "address")
    handles = handle.select(F.col("rowid").alias("handle_id"), F.col("id").alias("handle_address"))
    pairs = containment_join(handles, "handle_address", addrs, "address", literal)
    return pairs.select("chat_key", "member_pos", "name", "addr_pos", "address", "handle_id")


def unresolved_addresses(contacts: DataFrame, handle: DataFrame) -> DataFrame:
    """Addresses that cannot be used: invalid ones, and valid ones that
    match no handle (the reference raises on either)."""
    addrs = contact_addresses(contacts)
    found = contact_handles(contacts, handle).select("chat_key", "member_pos", "addr_pos").distinct()
    invalid = addrs.where(F.col("status") != "ok").withColumn("reason", F.col("status"))
    missing = (
        addrs.where(F.col("status") == "ok")
        .join(found, ["chat_key", "member_pos", "addr_pos"], "left_anti")
        .withColumn("reason", F.lit("not found"))
    )
    return invalid.unionByName(missing).select(
        "chat_key", "member_pos", "name", "addr_pos", "raw_address", "address", "reason"
    )


def sender_map(chats: DataFrame, contacts: DataFrame, handle: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """``(chat_key, handle_id, name)`` for group chats; ``found`` are contact
    handles that are known already (e.g. maintained ones).

    Handle 0 is the user; a later member wins over an earlier one and any
    member wins over the user (the reference fills a dict in that order).
    One row per key, so joining it never multiplies messages.
    """
    groups = chats.where(F.col("kind") == "group")
    found = contact_handles(contacts, handle) if found is None else found
    members = found.join(groups.select("chat_key"), "chat_key", "left_semi")
    user = groups.select(
        "chat_key",
        F.lit(0).cast("bigint").alias("handle_id"),
        F.col("user_name").alias("name"),
        F.lit(-1).alias("member_pos"),
    )
    return (
        members.select("chat_key", "handle_id", "name", "member_pos")
        .unionByName(user)
        .groupBy("chat_key", "handle_id")
        .agg(F.max_by("name", "member_pos").alias("name"))
    )
