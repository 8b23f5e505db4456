"""Loads that miss nothing that comes late: batch and stream."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chatweave.operators.load import load_messages
from chatweave.operators.rules import apply_rules
from chatweave.session import scratch_path
from chatweave.sources.store import MessageStore, store_from_frames
from chatweave.streaming import coverage, incremental
from tests.conftest import BOOKS, GARDEN, PEOPLE, definitions

COLUMNS = ["chat_key", "message_id", "sender", "text", "time", "type"]


def saved(spark, state):
    return sorted(map(tuple, incremental.read_table(spark, state, "messages").select(*COLUMNS).collect()))


def full(store, chats, contacts):
    return sorted(map(tuple, load_messages(store, chats, contacts).select(*COLUMNS).collect()))


def part(store, messages="true", links="true"):
    return MessageStore(store.handle, store.chat, store.message.where(messages), store.chat_message_join.where(links))


def test_late_messages_links_and_definitions(spark, store):
    chats, contacts = definitions(spark, [GARDEN, BOOKS], PEOPLE)
    some = chats.where("chat_key <> 'books'")
    state = scratch_path(spark, "state")
    steps = [
        (part(store, "rowid >= 510 OR rowid = 501", "message_id <> 520"), some),  # older rows come later
        (part(store, "rowid <> 498", "message_id <> 520"), some),
        (part(store, links="message_id <> 520"), chats),  # a definition comes later
        (store, chats),
        (store, chats),
    ]
    sizes = []
    for n, (now, known) in enumerate(steps):
        coverage.ingest_uncovered(now, known, contacts, state, n + 1, rules=())
        sizes.append(len(saved(spark, state)))
    assert saved(spark, state) == full(store, chats, contacts)
    assert sizes[0] < sizes[1] < sizes[2] < sizes[3] == sizes[4]
    # a batch that is run again gives the same rows, also after later ones
    coverage.ingest_uncovered(steps[1][0], some, contacts, state, 2, rules=())
    assert saved(spark, state) == full(store, chats, contacts)


def test_a_mark_would_lose_them(spark, store):
    """What a high-water mark loses is what this is for."""
    chats, contacts = definitions(spark, [GARDEN, BOOKS], PEOPLE)
    by_mark, by_set = scratch_path(spark, "mark"), scratch_path(spark, "set")
    late = part(store, "date >= 7000")
    for n, now in enumerate((late, store)):
        incremental.ingest_batch(now, chats, contacts, by_mark, n + 1, rules=())
        coverage.ingest_uncovered(now, chats, contacts, by_set, n + 1, rules=())
    assert saved(spark, by_set) == full(store, chats, contacts)
    assert len(saved(spark, by_mark)) < len(saved(spark, by_set))


def test_bitmaps_across_buckets_and_compaction(spark):
    ids = [1, 2, 8, 9, 32_767, 32_768, 32_769, 65_536, 65_537, 10**12, 10**12 + 7]
    pairs = spark.createDataFrame([("a", 1, i) for i in ids] + [("a", 2, 5), ("b", 1, 1)], "chat_key string, chat_id long, message_id long")
    state = scratch_path(spark, "state")
    for n, cut in enumerate(("message_id % 2 = 0", "message_id % 2 = 1")):
        coverage.sinks.write_batch(coverage.bitmaps(pairs.where(cut)), f"{state}/covered", n + 1)
    asked = pairs.unionByName(spark.createDataFrame([("a", 1, i) for i in (0, 3, 10, 32_770, 10**12 + 1)] + [("b", 2, 1)], pairs.schema))
    want = {("a", 1, i) for i in (0, 3, 10, 32_770, 10**12 + 1)} | {("b", 2, 1)}
    for _ in range(2):
        left = coverage.uncovered(asked, coverage.covered(spark, state, 9))
        assert {tuple(r) for r in left.collect()} == want
        coverage.compact_covered(spark, state, 2)
    rows = coverage.sinks.read_batches(spark, f"{state}/covered", coverage.COVERED)
    assert {r.batch_id for r in rows.collect()} == {2}
    assert coverage.covered(spark, state, 2).count() == 0  # earlier batches see none of it


def test_empty_store_and_null_links(spark, store):
    chats, contacts = definitions(spark, [GARDEN], PEOPLE)
    state = scratch_path(spark, "state")
    coverage.ingest_uncovered(part(store, "false", "false"), chats, contacts, state, 1)
    nulls = store.chat_message_join.unionByName(spark.createDataFrame([(None, 501), (3, None)], "chat_id long, message_id long"))
    coverage.ingest_uncovered(MessageStore(store.handle, store.chat, store.message, nulls), chats, contacts, state, 2, rules=())
    assert saved(spark, state) == full(store, chats, contacts)


@pytest.mark.parametrize("late", ["links", "messages"])
def test_stream_links_one_drop_late_with_bounded_state(spark, late):
    """Ten drops of 30 messages; each message is loaded once, in state only for a while."""
    handle = spark.createDataFrame([(1, "+15550001111")], "rowid long, id string")
    chat = spark.createDataFrame([(5, "club", "chat5"), (6, "club", "chat6")], "rowid long, display_name string, chat_identifier string")
    message = spark.range(0, 300).select(
        F.col("id").alias("rowid"), (F.col("id") % 2).alias("handle_id"), F.lit(0).alias("is_from_me"), F.concat(F.lit("m"), "id").alias("text"),
        (1000 - F.col("id")).alias("date"), F.lit(0).alias("associated_message_type"))
    both = spark.range(0, 300).select(F.lit(5).cast("long").alias("chat_id"), F.col("id").alias("message_id"))
    links = both.unionByName(both.where("message_id % 7 = 0").withColumn("chat_id", F.lit(6).cast("long")))
    chats, contacts = definitions(spark, [("club", "club", [("Ann", ["+15550001111"])])])
    store = store_from_frames(handle, chat, message, links)
    state = scratch_path(spark, "stream")
    held = []
    for step in range(11):
        of = {"links": (step, step - 1), "messages": (step - 1, step)}[late]
        for name, rows, row_id, drop in (("message", message, "rowid", of[0]), ("link", links, "message_id", of[1])):
            rows.where(F.floor(F.col(row_id) / 30) == drop).write.parquet(f"{state}/{name}/drop={step}")
        if step in (0, 3, 6, 8, 10):  # several drops in one run, too
            held += coverage.stream_joined(spark, f"{state}/message", f"{state}/link", store, chats, contacts, state, wait=60, rules=())
    assert saved(spark, state) == full(store, chats, contacts) and len(saved(spark, state)) == 300 + 43
    assert held and max(h["rows"] for h in held) < 450 and held[-1]["rows"] < 300, held  # of 642 rows


def test_rules_apply_to_what_is_loaded(spark, store):
    chats, contacts = definitions(spark, [GARDEN, BOOKS], PEOPLE)
    state = scratch_path(spark, "state")
    for n, cut in enumerate(("rowid % 2 = 0", "true")):
        coverage.ingest_uncovered(part(store, cut), chats, contacts, state, n + 1)
    want = apply_rules(load_messages(store, chats, contacts), *coverage.DEFAULT_RULES).select(*COLUMNS)
    assert saved(spark, state) == sorted(map(tuple, want.collect()))
