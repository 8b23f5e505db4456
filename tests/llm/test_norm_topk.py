from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest

from chatweave.llm import norm_topk as T
from chatweave.llm.queries import op10_norm_topk
from tests.conftest import SF_CHECK


def scaled(v):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(1024 * float(x)) for x in v]


def plain(rows, query_ids, k=10):
    live = [(i, v) for i, v in ((i, scaled(v)) for i, v in rows) if v is not None and i is not None]
    out = {}
    for q, v in live:
        if q in query_ids:
            scores = [(-sum(a * b for a, b in zip(v, w)), i) for i, w in live if i != q and len(w) == len(v)]
            out[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])]
    return out


def result(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(x) for q, x in out.items()}


@pytest.mark.parametrize("block", [T.BLOCK, 16])
def test_against_all_products(spark, block):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=6) * rng.choice([0.01, 1, 30])).tolist()) for i in range(400)]
    rows += [(1000 + i, [0.5] * 6) for i in range(60)] + [(2000, [0.0] * 6), (2001, None), (2002, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2003, [float("nan")] * 6), (2004, [float("inf")] * 6)]
    rows += [(3000 + i, [float(i), 1.0]) for i in range(5)] + [(4000, []), (4001, []), (None, [9.0] * 6)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS d", "3 AS norm")
    asked = {0, 100, 200, 300, 1000, 2000, 2001, 3000, 4000}
    queries = vectors.where(f"vec_id IN ({','.join(map(str, asked))})")
    want = {q: x for q, x in plain(rows, asked).items() if x}
    assert result(T.top_k(vectors, queries, block=block)) == want


def test_repeated_rows_and_empty(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert result(T.top_k(vectors, vectors.where("vec_id = 0"))) == {0: [(1, 1, 512 * 1024), (2, 1, 512 * 1024)]}
    assert T.top_k(vectors.limit(0), vectors.limit(0)).collect() == []
    assert T.top_k(vectors.where("vec_id = 0"), vectors.where("vec_id = 0")).collect() == []


def test_pruning_leaves_most_vectors_out():
    rng = np.random.default_rng(3)
    rows = np.floor(1024 * rng.normal(size=(4000, 32)) * rng.exponential(size=(4000, 1))).astype(np.int64)
    turn = T.rotation(rows.tolist(), 32)
    assert np.allclose(turn.T @ turn, np.eye(32))
    block = T.Block(np.arange(4000), rows, turn)
    q = rows[7]
    best = np.sort(np.delete(rows @ q, 7))[::-1][:10]
    ids, score = block.best(q, 7, q.astype(float) @ turn, float(best[9]), 10)
    assert score.tolist() == best.tolist()


def test_query(spark):
    e = pd.read_parquet(f"{SF_CHECK}/embeddings.parquet")
    want = plain(list(zip(e.vec_id, e.embedding.map(list))), {i for i in e.vec_id if i % 100 == 0})
    assert result(op10_norm_topk(spark, SF_CHECK)) == want
