from __future__ import annotations

import itertools
import zlib

import numpy as np
import pandas as pd
import pytest

from chatweave.llm import line_crf as C
from chatweave.llm.queries import op9_line_crf
from tests.conftest import SF_CHECK


def test_chains_against_enumeration():
    rng = np.random.default_rng(1)
    lengths = np.array([3, 1, 5, 2])
    score, trans = rng.normal(size=lengths.sum()), rng.normal(size=(2, 2))
    marginal, z, pairs = C.chains(score, lengths, trans)
    want_pairs, at = np.zeros((2, 2)), 0
    for k, n in enumerate(lengths):
        weights = {}
        for labels in itertools.product((0, 1), repeat=int(n)):
            s = sum(score[at + i] * y for i, y in enumerate(labels)) + sum(trans[a, b] for a, b in zip(labels, labels[1:]))
            weights[labels] = np.exp(s)
        total = sum(weights.values())
        assert z[k] == pytest.approx(np.log(total))
        for i in range(n):
            assert marginal[at + i] == pytest.approx(sum(w for y, w in weights.items() if y[i]) / total)
        for y, w in weights.items():
            for a, b in zip(y, y[1:]):
                want_pairs[a, b] += w / total
        at += n
    assert pairs == pytest.approx(want_pairs)


def test_features_of_neighbours():
    x, lengths = C.text_features("good line here\n\n  \nb | c | d\nlast")
    w = C.WIDTH
    assert x.shape == (3, C.FEATURES) and lengths.tolist() == [14, 9, 4]
    assert (x[1, w : 2 * w] == x[0, :w]).all() and (x[1, 2 * w : 3 * w] == x[2, :w]).all() and not x[0, w : 2 * w].any()
    assert C.text_features(None)[0].shape == C.text_features(" \n")[0].shape == (1, C.FEATURES)


def test_scores_do_not_depend_on_batches(monkeypatch):
    good, bad = "This is a line of words.\nAnd one more of them.", "x | y | z\n### ### ###"
    model = C.train([(i % 2, (good if i % 2 else bad) + f"\nline {i}") for i in range(100)])
    texts = [good, bad, None, "", "word " * 20_000, "a\n" * 3000] * 3
    one = list(model.score(texts))
    monkeypatch.setattr(C, "LINES", 1)
    assert list(model.score(texts)) == pytest.approx(one, abs=1e-9)
    assert one[0] > 0.9 and one[1] < 0.1 and all(0 <= s <= 1 for s in one)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a"), (2, "")], "doc_id long, text string").selectExpr("*", "1 AS score0", "2 AS _y")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    model = C.fit_model(docs, labels)
    assert [r.score for r in C.score_documents(docs, model, ["doc_id"]).collect()] == [C.PRIOR] * 4
    assert C.score_documents(docs.limit(0), model, ["doc_id"]).collect() == []


def test_query_held_out_accuracy(spark):
    labels = pd.read_parquet(f"{SF_CHECK}/labels.parquet").set_index("doc_id").quality
    got = op9_line_crf(spark, SF_CHECK).toPandas()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    held = got[got.held_out & got.doc_id.isin(labels.index)]
    assert (held.predicted.values == labels[held.doc_id].values).mean() > 0.95


def test_sample_is_bounded_in_rows_and_bytes(spark):
    rows = [(i, "good line of text " * (i % 7 + 1)) for i in range(300)] + [(5, f"another text of row {k}") for k in range(200)] + [(9, "x" * 50_000), (None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS _t", "2 AS _size").repartition(4)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    every = C.sample_rows(docs, labels)
    learned = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(every) == len(learned) and sum(y for y, _ in every) == sum(i % 2 for i in learned)
    few = C.sample_rows(docs, labels, most_bytes=5_000)
    assert 0 < len(few) < len(every) and sum(len(t) for _, t in few) <= 5_000
    assert C.sample_rows(docs, labels.limit(0)) == []
