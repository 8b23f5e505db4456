from __future__ import annotations

import zlib

import numpy as np
import pandas as pd

from chatweave.llm import language_id as L
from chatweave.llm.queries import op3_language_id
from tests.conftest import SF_CHECK


def test_windows_do_not_depend_on_slices(monkeypatch):
    text = "Ça va? 12 ab-c Straße 日本語 " * 30
    whole = L.bucket_counts(text)
    for size in (1, 2, 3, 7, 64):
        monkeypatch.setattr(L, "SLICE", size)
        assert (L.bucket_counts(text) == whole).all()


def test_windows_by_hand():
    # "ab" bounded: 1: a b; 2: _a ab b_; 3: _ab ab_; 4: _ab_
    assert L.bucket_counts("Ab").sum() == 8
    assert (L.bucket_counts("ab 12 ab") == 2 * L.bucket_counts("AB")).all()
    assert L.bucket_counts("12 .,!").sum() == 0 and L.bucket_counts("").sum() == 0 and L.bucket_counts(None).sum() == 0


def test_training_recognises_and_rejects():
    rng = np.random.default_rng(0)
    words = {"xx": ["bala", "bolo", "labo", "obal"], "yy": ["shtrk", "krsht", "trsk", "shk"]}
    rows = []
    for i in range(200):
        lang = "xx" if i % 2 else "yy"
        n = L.bucket_counts(" ".join(rng.choice(words[lang], 20)))
        b = np.flatnonzero(n)
        rows.append((lang, b, n[b].astype(float)))
    m = L.train(rows)
    assert m.predict("bala labo obal") [0] == "xx" and m.predict("shtrk KRSHT")[0] == "yy"
    assert m.predict("1234") == ("und", 0.0) and m.predict(None) == ("und", 0.0)
    assert 0 <= m.predict("qqq")[1] <= 1 and 0 < m.threshold <= L.MOST


def test_edge_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 ...", "en"), (None, "abc", "en"), (3, "123 ...", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' AS _key", "0 AS doc")
    got = L.language_id(docs).collect()
    assert [(r.lang_pred, r.score, r.accepted) for r in got] == [("und", 0.0, False)] * 5  # nothing to learn from
    assert L.language_id(docs.limit(0)).collect() == []


def test_query_held_out_accuracy(spark):
    truth = pd.read_parquet(f"{SF_CHECK}/documents.parquet").set_index("doc_id").lang
    got = op3_language_id(spark, SF_CHECK).toPandas()
    assert len(got) == len(truth) and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.lang_pred.values == truth[held.doc_id].values).mean() > 0.97
    assert (~got.accepted).mean() < 0.02


def test_predictions_use_no_label(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").limit(300)
    model = L.fit_model(docs)
    a = L.identify(docs, model, ["doc_id"]).toPandas()
    b = L.identify(docs.selectExpr("doc_id + 7 AS doc_id", "text", "'zz' AS lang"), model, ["doc_id"]).toPandas()
    assert (a.lang_pred == b.lang_pred).all() and (a.score == b.score).all()


def test_letters_of_all_planes_count():
    assert all(L.letter_table()[ord(c)] == ord(c) for c in "\U00020000\U00030000\U00031350")
    assert L.bucket_counts("\U00030000\U00031350").sum() > 0
