"""Loading chats from the small store of ``conftest``."""

from __future__ import annotations

import pytest

from chatweave.operators import addresses, chats as chat_ops, load
from tests.conftest import BOOKS, GARDEN, JON, MAIL_MIRA, MAIL_VISITOR, MIRA, PEOPLE, PHONE_JON, PHONE_STRANGER, definitions


def _labels(df):
    return [(r.sender, r.time, r.type) for r in df.collect()]


def test_group_over_two_chat_ids_in_time_order(spark, store):
    chats, contacts = definitions(spark, groups=[GARDEN])
    rows = load.load_group(store, chats, contacts, ordered=True).collect()
    assert [(r.message_id, r.sender) for r in rows] == [
        (498, "You"), (501, "Jon"), (502, "You"), (507, "Mira"), (503, "Mira"), (520, PHONE_STRANGER)
    ]
    assert rows[3].type == 2003 and rows[1].text == "Frost tonight, cover the beans"


def test_senders_without_a_contact_are_listed_as_first_seen(spark, store):
    chats, contacts = definitions(spark, groups=[BOOKS])
    assert [s for s, *_ in _labels(load.load_group(store, chats, contacts, ordered=True))] == [
        "Mira", PHONE_STRANGER, MAIL_VISITOR, "You", MAIL_VISITOR
    ]
    unknown = load.unknown_senders(store, chats, contacts).orderBy("first_time", "first_message_id")
    assert [(u.address, u.n_messages) for u in unknown.collect()] == [(PHONE_STRANGER, 1), (MAIL_VISITOR, 2)]
    chats, contacts = definitions(spark, groups=[("books", "book swap", [("Mira", MIRA[:1]), ("Jon", JON)])])
    unknown = load.unknown_senders(store, chats, contacts).orderBy("first_time", "first_message_id")
    assert [u.address for u in unknown.collect()] == [MAIL_MIRA, PHONE_STRANGER, MAIL_VISITOR]


@pytest.mark.parametrize("since, times", [(7259, [7260, 7300, 7330, 7400]), (7260, [7300, 7330, 7400]), (9999, [])])
def test_since_is_strict(spark, store, since, times):
    chats, contacts = definitions(spark, groups=[GARDEN])
    assert [t for _, t, _ in _labels(load.load_group(store, chats, contacts, since=since, ordered=True))] == times


def test_one_to_one_chats(spark, store):
    chats, contacts = definitions(spark, people=PEOPLE)
    got = load.load_individual(store, chats, contacts, ordered=True).collect()
    assert [(r.chat_key, r.sender, r.time) for r in got] == [
        ("jon", "You", 9000), ("jon", "Jon", 9005), ("jon", "Jon", 9006),
        ("mira", "You", 7900), ("mira", "Mira", 8000), ("mira", "You", 8010), ("mira", "Mira", 8500),
    ]
    late = load.load_individual(store, chats, contacts, since=8010).where("chat_key = 'mira'")
    assert [r.time for r in late.collect()] == [8500]


def test_many_chats_in_one_plan(spark, store):
    chats, contacts = definitions(spark, groups=[GARDEN, BOOKS], people=PEOPLE)
    counts = load.load_messages(store, chats, contacts).groupBy("chat_key").count().collect()
    assert {r.chat_key: r["count"] for r in counts} == {"garden": 6, "books": 5, "mira": 4, "jon": 3}


def test_chat_ids_and_rejects(spark, store):
    chats, contacts = definitions(spark, groups=[GARDEN, BOOKS, ("none", "Garden Club", []), ("blank", "", [])], people=PEOPLE)
    g = sorted((r.chat_key, r.chat_id) for r in chat_ops.chat_ids_group(chats, store.chat).collect())
    assert g == [("blank", 12), ("blank", 14), ("blank", 15), ("blank", 19), ("blank", 40), ("books", 5), ("garden", 3), ("garden", 8)]
    i = chat_ops.chat_ids_individual(chats, contacts, store.chat).orderBy("chat_key", "addr_pos", "chat_id")
    assert [(r.chat_key, r.chat_id) for r in i.collect()] == [("jon", 15), ("mira", 12), ("mira", 14), ("mira", 19)]
    missing = chat_ops.unresolved_chats(chats, contacts, store.chat).collect()
    assert [(r.chat_key, r.kind) for r in missing] == [("none", "group")]


def test_handles_of_contacts_in_address_order(spark, store):
    _, contacts = definitions(spark, people=[("phone", "Mira", MIRA[:1]), ("both", "Mira", MIRA), ("swapped", "Mira", MIRA[::-1]),
                                              ("local", "Jon", ["(1555) 000-3344"]), ("nobody", "X", ["+1 212 555 0199"])])
    got = {}
    for r in addresses.contact_handles(contacts, store.handle).orderBy("chat_key", "addr_pos", "handle_id").collect():
        got.setdefault(r.chat_key, []).append(r.handle_id)
    assert got == {"phone": [11, 31], "both": [11, 31, 17], "swapped": [17, 11, 31], "local": [23]}
    missing = addresses.unresolved_addresses(contacts, store.handle).collect()
    assert [(r.chat_key, r.reason) for r in missing] == [("nobody", "not found")]


def test_later_member_wins_and_no_fan_out(spark, store):
    chats, contacts = definitions(spark, groups=[("garden", "garden club", [("Mira", MIRA), ("Sister", ["15550001122"]), ("Jon", JON)])])
    senders = [s for s, *_ in _labels(load.load_group(store, chats, contacts, ordered=True))]
    assert senders == ["You", "Jon", "You", "Sister", "Sister", PHONE_STRANGER]


def test_member_on_handle_zero_overrides_the_user(spark, store):
    handle = store.handle.unionByName(spark.createDataFrame([(0, "+61400111222")], "rowid long, id string"))
    s2 = type(store)(handle, store.chat, store.message, store.chat_message_join)
    chats, contacts = definitions(spark, groups=[("garden", "garden club", [("Mira", MIRA), ("Kim", ["61 400 111 222"])]), BOOKS])
    got = load.load_group(s2, chats, contacts, ordered=True).collect()
    assert [(r.sender, r.time) for r in got if r.chat_key == "garden"] == [
        ("Kim", 6000), (PHONE_JON, 7200), ("Kim", 7260), ("Mira", 7300), ("Mira", 7330), (PHONE_STRANGER, 7400)
    ]
    assert [r.sender for r in got if r.chat_key == "books"][3] == "You"


def test_message_under_two_chat_ids(spark, store):
    links = store.chat_message_join.unionByName(spark.createDataFrame([(8, 501)], "chat_id long, message_id long"))
    s2 = type(store)(store.handle, store.chat, store.message, links)
    chats, contacts = definitions(spark, groups=[GARDEN])
    assert [t for _, t, _ in _labels(load.load_group(s2, chats, contacts, ordered=True))] == [6000, 7200, 7200, 7260, 7300, 7330, 7400]
    once = load.load_messages(s2, chats, contacts, ordered=True, dedupe=True)
    assert [t for _, t, _ in _labels(once)] == [6000, 7200, 7260, 7300, 7330, 7400]


def test_strict_load_raises(spark, store):
    good_chats, good_contacts = definitions(spark, groups=[GARDEN], people=PEOPLE[:1])
    assert load.load_messages(store, good_chats, good_contacts, strict=True).count() == 10
    cases = [
        definitions(spark, groups=[("garden", "garden club", [("Ann", ["+1 212 555 0199"])])]),  # no handle
        definitions(spark, groups=[("x", "chess club", [("Jon", JON)])]),  # no chat of that name
        definitions(spark, people=[("ann", "Ann", ["+1 212 555 0199"])]),  # no chat identifier
        definitions(spark, people=[("short", "Short", ["555-0199"])]),  # too short
    ]
    for chats, contacts in cases:
        with pytest.raises(load.UnresolvedDefinitionError):
            load.load_messages(store, chats, contacts, strict=True)
        assert load.definition_problems(store, chats, contacts).count() == 1
        load.load_messages(store, chats, contacts).count()  # lenient: no error
    with pytest.raises(KeyError):
        load.select_chats(good_chats, ["garden", "chess"])
    assert load.select_chats(good_chats, ["mira"]).count() == 1


def _plan(df) -> str:
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_marks_reach_the_scan(spark, store, tmp_path):
    path = str(tmp_path / "message")
    store.message.write.parquet(path)
    s2 = type(store)(store.handle, store.chat, spark.read.schema(store.message.schema).parquet(path), store.chat_message_join)
    chats, contacts = definitions(spark, groups=[GARDEN, BOOKS])
    marks = spark.createDataFrame([("garden", 7260, 502), ("books", 6550, 511)], "chat_key string, mark_time long, mark_id long")
    new = load.load_messages(s2, chats, contacts, marks=marks)
    assert "GreaterThanOrEqual(date,6550)" in _plan(new)
    assert sorted(r.message_id for r in new.collect()) == [503, 507, 513, 514, 520]
    # a tie on the time is decided by the id, and a chat without a mark loads whole
    tie = spark.createDataFrame([("garden", 7300, 506)], "chat_key string, mark_time long, mark_id long")
    new = load.load_messages(s2, chats, contacts, marks=tie)
    assert "GreaterThanOrEqual(date,7300)" in _plan(new)
    assert sorted(r.message_id for r in new.collect()) == [503, 507, 510, 511, 512, 513, 514, 520]
    assert load.load_messages(s2, chats, contacts, marks=marks.limit(0)).count() == 11


def test_literal_addresses_have_no_wildcards(spark, store):
    _, contacts = definitions(spark, people=[("wild", "W", ["m_ra@post.example"])])
    assert [r.handle_id for r in addresses.contact_handles(contacts, store.handle).collect()] == [17]
    assert addresses.contact_handles(contacts, store.handle, literal=True).count() == 0


def test_results_do_not_depend_on_the_join_strategy(spark, store):
    chats, contacts = definitions(spark, groups=[GARDEN, BOOKS], people=PEOPLE)
    want = sorted(map(tuple, load.load_messages(store, chats, contacts).collect()), key=repr)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(tuple, load.load_messages(store, chats, contacts).collect()), key=repr) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
