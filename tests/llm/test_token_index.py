from __future__ import annotations

import os
import random
import struct
import zlib

import numpy as np
import pandas as pd
import pytest

from chatweave.llm import token_index as T
from chatweave.llm import word_tokens
from chatweave.llm.queries import op11_token_index
from tests.conftest import SF_CHECK


@pytest.fixture(scope="module")
def plain():
    """ids by the tokenizers library alone."""
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda text: whole.encode(text or "", add_special_tokens=False).ids


ODD = [
    None, "", " ", "\n\t", "Don't can't WE'LL 'super !'s it's''t", "naïve Ünïcode İstanbul ŉ ĲSSEL ẞ", "é e ́ ́x", "ΑΣ ΣΑΣ. ὈΔΥΣΣΕΎΣ",
    "<|endoftext|> a <|startoftext|>b", "<|endof text|>", "東京 тест १२३ ½ ² Ⅷ", "a b c\x85d\x1ce\x00f", "12,345.67 8f3a#*$% &&& a_b-c", "😀😀 x😀", "x" * 5000, "ﬁ ﬀ K Å", "don’t ‘s “q”",
]


def test_encoder_equals_the_library(plain):
    enc = word_tokens.Encoder()
    docs = pd.read_parquet(f"{SF_CHECK}/documents.parquet").text.tolist()
    rng = random.Random(5)
    letters = "aZéÉßİıſ'stmdre ll\t\n1٣.,!_́ΣσςǅK½😀- "
    for text in ODD + docs + ["".join(rng.choices(letters, k=40)) for _ in range(3000)]:
        assert np.frombuffer(enc.ids(text), enc.dtype).tolist() == plain(text), text


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 3000])
def test_perfect_hash(n):
    keys, nth = [f"={i // 2}" for i in range(n)], [i % 2 for i in range(n)]
    pilots, slot = T.perfect_hash(*T.key_hashes(keys, nth))
    assert sorted(slot.tolist()) == list(range(n))
    content = T.index_bytes(keys, nth, np.arange(n) % 7, np.arange(n) * 3, np.arange(n) + 1)
    if n:
        records, known = T.find_in(content, keys, nth)
        assert known.all() and records["offset"].tolist() == [3 * i for i in range(n)] and records["length"].tolist() == [i + 1 for i in range(n)]
        assert T.find_in(content, [f"!{i}" for i in range(2000)], [0] * 2000)[1].sum() == 0
    assert len(content) == T.INDEX_START + 8 * len(pilots) + T.SLOT.itemsize * n


def test_equal_second_hashes_take_another_seed():
    same = np.full(2, 5, dtype=np.uint64)
    assert T.perfect_hash(same, same) is None


def brute(rows, plain):
    """Documents in the order of the shards, and where each starts."""
    coded = [(k, np.array(plain(t) + [1], dtype="<u2")) for k, t in rows]
    out, at = [], 0
    for k, ids in sorted(coded, key=lambda r: (r[0] is not None, r[0] or 0)):
        out.append((k, at, ids))
        at += len(ids)
    return out


def test_files_hold_all_ids_in_order(spark, plain):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(500 - i, f"text number {i} " * (i % 9)) for i in range(60)] + [(7, "again"), (7, "again"), (None, "no key"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS n", "3 AS shard", "'f' AS file", "4 AS `a.b`").repartition(5)
    made = T.write(docs, shard_ids=40, file_keys=10)
    assert made.files >= 7 and made.shards.count() > 5 and made.indexes.agg({"keys": "sum"}).first()[0] == len(rows)
    got = sorted(made.read(T.row_keys(docs, "doc_id"), "doc_id").collect(), key=lambda r: r.start)
    want = brute(rows, plain)
    assert [r.doc_id for r in got] == [k for k, _, _ in want]
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    key = lambda k, ids: (k is not None, k or 0, ids.tolist())  # noqa: E731  rows of one key come in any order
    assert sorted(key(r.doc_id, np.frombuffer(r.ids, "<u4")) for r in got) == sorted(key(k, ids) for k, _, ids in want)
    # the raw payloads, file after file, are all ids in that order
    payload = b""
    for s in made.shards.orderBy("shard").collect():
        raw = open(f"{made.folder}/shards/{s.file}", "rb").read()
        assert struct.unpack_from(T.SHARD_HEAD, raw) == (T.SHARD_MAGIC, 2, 0) and s.base * 2 == len(payload)
        payload += raw[T.SHARD_START :]
    assert payload == b"".join(np.frombuffer(r.ids, "<u4").astype("<u2").tobytes() for r in got)
    # single keys
    assert made.get(500).tolist() == plain("") + [1] and made.get(4).tolist() == plain(ODD[4]) + [1]
    assert sorted(made.get(7, n).tolist() for n in range(3)) == sorted([plain("again") + [1]] * 2 + [plain(ODD[7]) + [1]])
    assert made.get(12345) is None and made.get(7, 3) is None and sorted(map(len, (made.get(None), made.get(None, 1)))) == [1, len(plain("no key")) + 1]
    # keys that were never written are not found
    asked = spark.createDataFrame([(4, 0), (4, 1), (-1, 0)], "doc_id long, occurrence long")
    assert [(r.doc_id, r.occurrence) for r in made.read(asked, "doc_id").collect()] == [(4, 0)]


def test_one_key_holds_a_third_and_text_keys(spark, plain):
    rows = [("hot" if i % 3 == 0 else f"k{i}", f"w{i % 5}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    made = T.write(docs, shard_ids=50)
    got = made.read(T.row_keys(docs, "doc_id"), "doc_id").collect()
    assert sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got) == sorted((k, plain(t) + [1]) for k, t in rows)
    assert sorted(r.occurrence for r in got if r.doc_id == "hot") == list(range(100))


def test_a_file_of_a_lost_task_is_not_read(spark):
    docs = spark.createDataFrame([(i, "a b c") for i in range(5)], "doc_id long, text string")
    made = T.write(docs)
    open(f"{made.folder}/shards/0-0-lost.ids", "wb").write(b"junk")
    assert made.read(T.row_keys(docs, "doc_id"), "doc_id").count() == 5
    assert len(os.listdir(f"{made.folder}/shards")) > made.shards.count()


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    made = T.write(docs)
    assert made.read(T.row_keys(docs, "doc_id"), "doc_id").collect() == [] and made.get(1) is None


def test_query(spark, plain):
    d = pd.read_parquet(f"{SF_CHECK}/documents.parquet")
    want = [(k, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for k, at, ids in brute(zip(d.doc_id.tolist(), d.text.tolist()), plain)]
    got = op11_token_index(spark, SF_CHECK)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
