"""State kept up to date by deltas: contact handles, senders, committed tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chatweave import schemas
from chatweave.operators.addresses import contact_handles
from chatweave.operators.load import load_messages, unknown_senders
from chatweave.session import scratch_path
from chatweave.sources.commits import CommittedTables
from chatweave.sources.store import MessageStore
from chatweave.streaming import contact_state, incremental, senders
from tests.conftest import BOOKS, GARDEN, PEOPLE, definitions


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def test_contact_handles_after_three_deltas(spark, store):
    _, some = definitions(spark, [GARDEN])
    chats, every = definitions(spark, [GARDEN, BOOKS], PEOPLE)
    state = scratch_path(spark, "contacts")
    changed = store.handle.withColumn("id", F.when(F.col("rowid") == 31, "+4915550003344").otherwise(F.col("id")))
    steps = [(some, store.handle.where("rowid <> 17")), (every, store.handle), (every, changed), (some, changed.where("rowid <> 11"))]
    work = []
    for n, (contacts, handle) in enumerate(steps):
        work.append(contact_state.update_contact_handles(contacts, handle, state, n + 1))
        got = contact_state.maintained_contact_handles(contacts, handle, state)
        assert rows(got) == rows(contact_handles(contacts, handle))
    assert [w["new_texts"] for w in work] == [6, 1, 1, 0]  # only what is new meets the old
    assert [w["new_patterns"] for w in work] == [3, 0, 0, 0] and [w["all_texts"] for w in work] == [6, 0, 0, 0]
    # an update that is run again, and one after a break, change nothing
    contact_state.update_contact_handles(every, changed, state, 3)
    got = contact_state.maintained_contact_handles(every, changed, state)
    assert rows(got) == rows(contact_handles(every, changed))
    members = contact_state.maintained_contact_handles(every, changed, state)
    now = MessageStore(changed, store.chat, store.message, store.chat_message_join)
    assert rows(load_messages(now, chats, every, members=members)) == rows(load_messages(now, chats, every))


def test_pairs_written_before_a_break_count_once(spark):
    texts = spark.createDataFrame([(1, "abcdefghijkl"), (2, "xx"), (3, None), (1, "abcdefghijkl")], contact_state.TEXTS)
    patterns = spark.createDataFrame([("cdef",), ("x",), (None,)], contact_state.PATTERNS)
    state = scratch_path(spark, "pairs")
    contact_state.update_pairs(texts, patterns, state, 1)
    spark.createDataFrame([], contact_state.TEXTS).write.mode("overwrite").parquet(f"{state}/texts/batch_id=1")  # as if it broke off here
    spark.createDataFrame([], contact_state.PATTERNS).write.mode("overwrite").parquet(f"{state}/patterns/batch_id=1")
    contact_state.update_pairs(texts, patterns, state, 2)
    assert rows(contact_state.current_pairs(texts, patterns, state)) == [("cdef", 1, "abcdefghijkl"), ("x", 2, "xx")]


def test_senders_and_marks_after_each_drop(spark, store):
    chats, contacts = definitions(spark, [GARDEN, BOOKS], PEOPLE)
    state = scratch_path(spark, "senders")
    cuts = ["rowid >= 530", "rowid < 510", "rowid BETWEEN 510 AND 529", "false"]  # dates come out of order
    seen = "false"
    for n, cut in enumerate(cuts):
        store.message.where(cut).write.parquet(f"{state}/inbox/drop={n}")
        held = senders.stream_totals(spark, f"{state}/inbox", store, state)
        seen = f"({seen}) OR ({cut})"
        now = MessageStore(store.handle, store.chat, store.message.where(seen), store.chat_message_join)
        assert rows(senders.unknown_senders_now(spark, state, store, chats, contacts)) == rows(unknown_senders(now, chats, contacts))
        assert rows(senders.marks_now(spark, state, store, chats, contacts)) == rows(incremental.high_water_mark(load_messages(now, chats, contacts)))
    assert not held or max(held) <= store.message.select("rowid").count()
    # a definition that changes: a stranger becomes a member, a member leaves
    stranger = ("Zoe", ["+33700900800"])
    for groups in ([("garden", "garden club", [stranger]), BOOKS], [("garden", "garden club", GARDEN[2][:1]), ("books", "book swap", [*BOOKS[2], stranger])]):
        chats, contacts = definitions(spark, groups, PEOPLE[:1])
        assert rows(senders.unknown_senders_now(spark, state, store, chats, contacts)) == rows(unknown_senders(store, chats, contacts))
        assert rows(senders.marks_now(spark, state, store, chats, contacts)) == rows(incremental.high_water_mark(load_messages(store, chats, contacts)))


TABLES = {"messages": schemas.SAVED_MESSAGES, "marks": schemas.MARKS, "chunk_vectors": schemas.CHUNK_VECTORS}


def visible(spark, state):
    tables = CommittedTables(spark, state)
    return {name: rows(tables.read(name, schema)) for name, schema in TABLES.items()}


def test_readers_see_whole_batches_only(spark, store, monkeypatch):
    chats, contacts = definitions(spark, [GARDEN, BOOKS], PEOPLE)
    state = scratch_path(spark, "committed")
    early = MessageStore(store.handle, store.chat, store.message.where("date < 7000"), store.chat_message_join)
    incremental.load_committed(early, chats, contacts, state, 1)
    first, write = visible(spark, state), CommittedTables.write
    for broken in ("scanned", "messages", "marks", "chunk_vectors"):
        def failing(self, name, *args, at=broken, **more):
            if name == at:
                raise RuntimeError("lost")
            write(self, name, *args, **more)

        monkeypatch.setattr(CommittedTables, "write", failing)
        for batch in (1, 2):  # a new batch, and a repeated one that readers see already
            with pytest.raises(RuntimeError):
                incremental.load_committed(store, chats, contacts, state, batch)
            assert visible(spark, state) == first
    monkeypatch.setattr(CommittedTables, "write", write)
    incremental.load_committed(store, chats, contacts, state, 2)
    second = visible(spark, state)
    assert len(second["messages"]) > len(first["messages"]) and {r[0] for r in second["marks"]} == {1, 2}
    # the same tables as from the plain steps
    plain = scratch_path(spark, "plain")
    for n, now in enumerate((early, store)):
        incremental.ingest_batch(now, chats, contacts, plain, n + 1)
        incremental.index_batch(spark, plain, n + 1)
    for name in TABLES:
        assert second[name] == rows(incremental.read_table(spark, plain, name).select(*CommittedTables(spark, state).read(name, TABLES[name]).columns))
    # run again: the old attempt stays until it is asked to go
    incremental.load_committed(store, chats, contacts, state, 2)
    assert visible(spark, state) == second
    gone = CommittedTables(spark, state).vacuum(list(TABLES))
    assert len(gone) >= 8 and visible(spark, state) == second


def test_no_commit_yet(spark):
    tables = CommittedTables(spark, scratch_path(spark, "none"))
    assert tables.visible() == {} and tables.read("messages", schemas.MESSAGES).collect() == [] and tables.vacuum(["messages"]) == []
