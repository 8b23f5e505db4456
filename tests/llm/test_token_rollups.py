from __future__ import annotations

import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from chatweave.llm.queries import op5_token_rollups
from chatweave.llm.token_rollups import CHANGES, TokenRollups, token_counts
from chatweave.llm.tokens import NAME
from tests.conftest import SF_CHECK

WHOLE = Tokenizer.from_file(public_tokenizers.path(f"{NAME}.json"))


@pytest.fixture
def store(spark, tmp_path):
    return TokenRollups(spark, str(tmp_path / "store"))


def changes(spark, *rows):
    return spark.createDataFrame([(*r, None)[:7] for r in rows], CHANGES)


def live(store):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in store.totals().collect()}


def test_inserts_deletes_revisions(spark, store):
    assert live(store) == {}
    first = changes(spark, ("insert", 1, "v1", "a", "en", 10), ("insert", 2, "v1", "a", "en", 5), ("insert", 3, "v1", "b", None, 7), ("insert", 1, "v2", "a", "en", 12))
    assert store.commit("one", first)
    assert live(store) == {("a", "en", "v1"): (2, 15), ("b", None, "v1"): (1, 7), ("a", "en", "v2"): (1, 12)}
    assert not store.commit("one", first)  # idempotent
    assert live(store)[("a", "en", "v1")] == (2, 15)
    assert store.commit("two", changes(spark, ("delete", 2, "v1", None, None, None), ("revise", 1, "v1", None, None, 11), ("revise", 3, "v1", "c", "de", 8), ("delete", 99, "v1", None, None, 1)))
    assert live(store) == {("a", "en", "v1"): (1, 11), ("c", "de", "v1"): (1, 8), ("a", "en", "v2"): (1, 12)}
    store.commit("three", changes(spark, ("insert", 1, "v1", "a", "en", 20), ("revise", 50, "v1", "a", "en", 1)))  # upserts
    assert live(store)[("a", "en", "v1")] == (2, 21)


def test_attempt_that_broke_off_counts_only_once(spark, store):
    batch = changes(spark, ("insert", 1, "v", "a", "en", 10))
    signed = store._signed(batch.select("op", "doc_id", "tokenizer", "source", "lang", "n_tokens", "seq"))
    signed.write.parquet(f"{store.path}/ledger/batch_id=b")
    signed.groupBy("source", "lang", "tokenizer").sum("n_docs", "n_tokens").toDF("source", "lang", "tokenizer", "n_docs", "n_tokens").write.parquet(f"{store.path}/totals/batch_id=b")
    assert live(store) == {} and not store.is_committed("b")
    assert store.commit("b", batch) and live(store) == {("a", "en", "v"): (1, 10)}


def test_edges(spark, store):
    store.commit("none-yet", changes(spark).limit(0))
    assert live(store) == {}
    store.commit("x", changes(
        spark, ("insert", None, "v", None, None, 3), ("insert", None, "v", None, None, 3), ("delete", None, "v", None, None, 3),
        ("insert", 1, "v", "a", "en", 5), ("insert", 1, "v", "a", "en", 5), ("insert", 2, "v", "a", "en", None), ("bad", 4, "v", "a", "en", 5), (None, 5, "v", "a", "en", 5)))
    assert live(store) == {(None, None, "v"): (2, 6), ("a", "en", "v"): (2, 5)}
    store.commit("y", spark.createDataFrame([("insert", 1, "v", "a", "en", 9, 1), ("delete", 1, "v", "a", "en", 0, 2), ("revise", 2, "v", "a", "en", 4, 1), ("revise", 2, "v", "a", "en", 6, 0)], CHANGES))
    assert live(store)[("a", "en", "v")] == (1, 4)
    with pytest.raises(ValueError):
        store.commit("../x", changes(spark))


def test_counts(spark):
    texts = [None, "", "hello world", "a  b", "x " * 9000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "5 AS n")
    got = {r.doc_id: r.n_tokens for r in token_counts(docs, ["doc_id"]).collect()}
    assert got == {i: len(WHOLE.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_query_against_recount(spark):
    docs = pd.read_parquet(f"{SF_CHECK}/documents.parquet").sort_values("doc_id").drop_duplicates("text")
    docs["n"] = [len(WHOLE.encode(t, add_special_tokens=False).ids) + 1 for t in docs.text]
    want = {(*k, NAME): (len(g), int(g.n.sum())) for k, g in docs.groupby(["source", "lang"])}
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in op5_token_rollups(spark, SF_CHECK).collect()}
    assert got == want
