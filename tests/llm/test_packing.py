from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from chatweave.llm import packing as P
from chatweave.llm.queries import op4_packing
from chatweave.llm.tokens import NAME, encoder
from tests.conftest import SF_CHECK

WHOLE = Tokenizer.from_file(public_tokenizers.path(f"{NAME}.json"))


def ids_of(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", [
    "", " ", "  ", "a", " a", "a ", "a  ", "a  b", "a   b", "a\n b", "a \n b", "a\t \t c", "don't we'll I'm", "x\n\ny  \n z", "日本 語 é", "  a   b",
    "1 2 33", "a <|endoftext|> b", "tab\t tab", "end \n", "end\n ", " \n x", "a\r\n b", "\x1c a \x85 b", "😀 😀",
])
def test_ids_equal_those_of_tokenizers(text):
    e = encoder()
    assert np.frombuffer(e.ids(text), dtype=e.dtype).tolist() == ids_of(text)


def test_ids_of_random_spacing():
    rng, e = np.random.default_rng(3), encoder()
    parts = ["a", "the", "x1", " ", " ", "\n", "\t", ".", "'s", "é", " ", "##"]
    for _ in range(2000):
        text = "".join(rng.choice(parts, rng.integers(1, 14)))
        assert np.frombuffer(e.ids(text), dtype=e.dtype).tolist() == ids_of(text), repr(text)


@pytest.mark.parametrize("seed", range(40))
def test_deal_equals_slot_by_slot_dealing(seed):
    rng = np.random.default_rng(seed)
    n, window, quantum = int(rng.integers(1, 9)), int(rng.choice([16, 64])), int(rng.choice([1, 4, 16]))
    docs = [rng.integers(1, int(rng.choice([3, 30, 200])), int(rng.integers(0, 12))).tolist() for _ in range(n)]
    tokens = np.array([sum(d) for d in docs])
    deal = P.Deal(tokens, tokens if seed % 2 else rng.integers(0, 5, n), window, quantum)
    taken, order = [0] * n, []
    for _ in range(deal.full):
        s = min((x for x in range(n) if taken[x] < deal.quanta[x]), key=lambda x: ((2 * taken[x] + 1) / deal.weights[x], x))
        taken[s] += 1
        order.append(s)
    windows = np.arange(deal.full // deal.slots + 2)
    for w, got in zip(windows, deal.dealt(windows)):
        assert got.tolist() == np.bincount(order[: w * deal.slots], minlength=n).tolist()
    queue = np.repeat(np.arange(n), [len(d) for d in docs])
    length = np.array([x for d in docs for x in d], dtype=np.int64)
    start = np.concatenate([np.cumsum(d) - d for d in map(np.array, docs) if len(d)] or [np.zeros(0, int)]).astype(np.int64)
    if len(queue):
        seen, per = np.zeros(deal.total, dtype=int), np.zeros(len(queue), dtype=int)
        for doc, _, size, w, at in zip(*deal.pieces(queue, start, length)):
            assert size > 0 and at + size <= window
            seen[w * window + at : w * window + at + size] += 1
            per[doc] += size
        assert (seen == 1).all() and (per == length).all()


def check(got, texts):
    """texts: (doc_id, text) of every row, ids unique."""
    assert got.doc_id.nunique() == len(texts)
    got = got.sort_values(["doc_id", "start"])
    truth = dict(texts)
    for i, pieces in got.groupby("doc_id"):
        ids, at = np.array([*ids_of(truth[i]), 1], dtype="<u4"), 0
        for r in pieces.itertuples():
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    seq = got.sort_values(["sequence_id", "offset"])
    assert (seq.groupby("sequence_id").length.cumsum() - seq.length == seq.offset).all()
    size = seq.groupby("sequence_id").length.sum()
    assert (size <= P.WINDOW).all() and (size < P.WINDOW).sum() <= 1


def test_query_packs_every_id_once_in_the_corpus_mixture(spark):
    docs = pd.read_parquet(f"{SF_CHECK}/documents.parquet")
    got = op4_packing(spark, SF_CHECK).toPandas()
    check(got, list(zip(docs.doc_id, docs.text)))
    got = got.merge(docs[["doc_id", "source"]])
    share = got.groupby("source").length.sum() / got.length.sum()
    full = got[got.sequence_id < got.sequence_id.max() - 1]
    per = full.pivot_table(index="sequence_id", columns="source", values="length", aggfunc="sum", fill_value=0)
    assert (abs(per - P.WINDOW * share[per.columns]) <= 2 * P.QUANTUM).all().all()  # every window
    assert (abs(per.cumsum() - P.WINDOW * np.outer(np.arange(1, len(per) + 1), share[per.columns])) <= 2 * P.QUANTUM).all().all()  # deficits carry


def test_edges(spark):
    rows = [(1, None, None), (2, "", "a"), (3, "hello world " * 3000, "a"), (4, "x", "b"), (5, "y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS queue", "2 AS ids", "3 AS part").repartition(3)
    got = P.pack(docs).toPandas()
    check(got, [(r[0], r[1]) for r in rows])
    assert P.pack(docs.limit(0)).collect() == []
    twice = P.pack(docs.unionByName(docs)).toPandas()
    assert twice.length.sum() == 2 * got.length.sum()


def test_given_weights_and_many_sources(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "word " * 200, f"s{i % 2}") for i in range(100)], "doc_id long, text string, source string")
    got = P.pack(docs, weights={"s0": 3, "s1": 1}).toPandas()
    first = got[got.sequence_id == 0].merge(pd.DataFrame({"doc_id": range(100), "source": [f"s{i % 2}" for i in range(100)]}))
    assert first.groupby("source").length.sum().to_dict() == {"s0": 1536, "s1": 512}
    monkeypatch.setattr(P, "MOST_QUEUES", 3)
    many = spark.createDataFrame([(i, "word " * 20, f"s{i}") for i in range(50)], "doc_id long, text string, source string")
    check(P.pack(many).toPandas(), [(i, "word " * 20) for i in range(50)])


@pytest.mark.parametrize("weights", [None, {"hot": 3, "s1": 1}])
def test_large_and_weighted_sources_keep_their_queues_among_many(spark, monkeypatch, weights):
    monkeypatch.setattr(P, "MOST_QUEUES", 8)
    names = ["hot"] * 300 + ["#0", None] * 60 + ["s1"] * 30 + [f"s{i % 60}" for i in range(2, 150)]  # "#0" is no tail queue
    rows = [(i, "word " * 200, s) for i, s in enumerate(names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").orderBy("source").coalesce(3)
    got = P.pack(docs, weights).toPandas()
    check(got, [r[:2] for r in rows])
    got["source"] = [names[i] or "null" for i in got.doc_id]
    if weights:
        assert got[got.sequence_id == 0].groupby("source").length.sum().to_dict() == {"hot": 1536, "s1": 512}
        return
    got["source"] = got.source.where(got.source.isin(["hot", "#0", "null"]), "others")
    share = got.groupby("source").length.sum() / got.length.sum()
    per = got[got.sequence_id < got.sequence_id.max() - 1].pivot_table(index="sequence_id", columns="source", values="length", aggfunc="sum", fill_value=0)
    for source in ("hot", "#0", "null"):
        assert (abs(per[source] - P.WINDOW * share[source]) <= 2 * P.QUANTUM).all()
    assert (abs(per["others"] - P.WINDOW * share["others"]) <= 2 * P.MOST_QUEUES * P.QUANTUM).all() and (per["others"] > 0).all()
