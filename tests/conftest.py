"""Shared fixtures: one local Spark session and a small message store.

The store has a person with two handles for one phone and one for a mail
address, a group name and a person with several chat ids, senders that belong
to nobody, reactions, a message without text and dates out of row order."""

from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from chatweave.session import get_session  # noqa: E402
from chatweave.sources.store import store_from_frames  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    scratch = tempfile.mkdtemp(prefix="chatweave-tests-")
    s = get_session(
        "local[4]",
        app_name="chatweave-tests",
        shuffle_partitions=4,
        extra_conf={"spark.checkpoint.dir": scratch, "spark.sql.warehouse.dir": os.path.join(scratch, "wh")},
    )
    yield s
    s.stop()


PHONE_MIRA, PHONE_JON, MAIL_MIRA = "+4915550001122", "+4915550003344", "mira@post.example"
PHONE_STRANGER, MAIL_VISITOR = "+33700900800", "visitor@post.example"
HANDLES = [
    (11, PHONE_MIRA), (17, MAIL_MIRA), (23, PHONE_JON), (31, PHONE_MIRA),
    (44, "27272"), (61, PHONE_STRANGER), (62, MAIL_VISITOR),
]
CHATS_TABLE = [
    (3, "garden club", "chat700310"), (5, "book swap", "chat700311"), (8, "garden club", "chat700319"),
    (12, "", PHONE_MIRA), (14, "", PHONE_MIRA), (15, "", PHONE_JON), (19, "", MAIL_MIRA), (40, "", PHONE_STRANGER),
]
# (rowid, handle_id, is_from_me, text, date, type, chat_id)
MESSAGES = [
    (498, 0, 1, "Meeting moved to Friday", 6000, 0, 8),
    (501, 23, 0, "Frost tonight, cover the beans", 7200, 0, 3),
    (502, 0, 1, "Will do after work", 7260, 0, 3),
    (503, 11, 0, "I have spare fleece", 7330, 0, 8),
    (507, 31, 0, "Laughed at “Will do after work”", 7300, 2003, 3),
    (510, 17, 0, "Anyone read the heron novel?", 6500, 0, 5),
    (511, 62, 0, "good morning everybody", 6550, 0, 5),
    (512, 61, 0, "is this the chess group", 6540, 0, 5),
    (513, 0, 1, "No, books only", 6600, 0, 5),
    (514, 62, 0, "ok bye", 6700, 0, 5),
    (520, 61, 0, "Wrong number, sorry", 7400, 0, 8),
    (530, 11, 0, "Lift tomorrow?", 8000, 0, 12),
    (531, 11, 1, "Half past seven", 8010, 0, 12),
    (540, 31, 0, "Running late", 8500, 0, 14),
    (545, 17, 1, "Photos attached", 7900, 0, 19),
    (550, 23, 1, "Thanks for the ladder", 9000, 0, 15),
    (551, 23, 0, "Any time", 9005, 0, 15),
    (552, 23, 0, "Emphasised “Any time”", 9006, 2004, 15),
    (560, 61, 0, "not in any defined chat", 9999, 0, 40),
    (561, 11, 0, None, 9100, 0, 12),
]

MIRA = ["+49 (1555) 000-1122", MAIL_MIRA]
JON = ["49 1555 000 3344"]
GARDEN = ("garden", "garden club", [("Mira", MIRA), ("Jon", JON)])
BOOKS = ("books", "book swap", [("Mira", MIRA), ("Jon", JON)])
PEOPLE = [("mira", "Mira", MIRA), ("jon", "Jon", JON)]


@pytest.fixture(scope="session")
def store(spark):
    handle = spark.createDataFrame(HANDLES, "rowid long, id string")
    chat = spark.createDataFrame(CHATS_TABLE, "rowid long, display_name string, chat_identifier string")
    message = spark.createDataFrame(
        [m[:6] for m in MESSAGES],
        "rowid long, handle_id long, is_from_me int, text string, date long, associated_message_type int",
    )
    links = spark.createDataFrame([(m[6], m[0]) for m in MESSAGES], "chat_id long, message_id long")
    return store_from_frames(handle, chat, message, links)


def definitions(spark, groups=(), people=()):
    """Chat and contact tables from ``groups=[(key, name, [(member, addrs)])]``
    and ``people=[(key, person, addrs)]``; the user is 'You'."""
    chats, contacts = [], []
    for key, name, members in groups:
        chats.append((key, "group", name, "You"))
        for pos, (member, addrs) in enumerate(members):
            contacts.append((key, pos, member, list(addrs)))
    for key, person, addrs in people:
        chats.append((key, "individual", None, "You"))
        contacts.append((key, 0, person, list(addrs)))
    c = spark.createDataFrame(chats, "chat_key string, kind string, display_name string, user_name string")
    k = spark.createDataFrame(contacts, "chat_key string, member_pos int, name string, addresses array<string>")
    return c, k
