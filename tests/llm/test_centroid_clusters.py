from __future__ import annotations

import hashlib
import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from chatweave.llm import centroid_clusters as C
from chatweave.llm.oracles import ORACLES
from chatweave.llm.queries import op13_centroid_clusters
from tests.conftest import SF_CHECK


def brute(rows, k=8, rounds=10, width=64, seed="3"):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in order[:k]]
    if not centroids:
        return []

    def assign():
        out = []
        for _, v in kept:
            out.append(min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)))
        return out

    for _ in range(rounds):
        placed = assign()
        for j in range(len(centroids)):
            mine = [v for (_, v), (_, at) in zip(kept, placed) if at == j]
            if mine:
                centroids[j] = [sum(col) // len(mine) for col in zip(*mine)]
    placed = assign()
    per = {}
    for d, j in placed:
        per[j] = per.get(j, 0) + d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    fits = lambda n: n if n < 1 << 63 else None
    return sorted([(i, j, fits(d), fits(per[j]), fits(sum(per.values())), names[j]) for (i, _), (d, j) in zip(kept, placed)], key=repr)


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


def clouds(seed, n, width, spread):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(5, width))
    return [(i, (middles[i % 5] + spread * rng.normal(size=width)).tolist()) for i in range(n)]


@pytest.mark.parametrize("few", [C.FEW_ROWS, 3])
def test_against_all_distances(spark, few, monkeypatch):
    monkeypatch.setattr(C, "FEW_ROWS", few)
    rows = clouds(1, 500, 6, 0.4)
    rows += [(1000 + i, [0.25] * 6) for i in range(120)] + [(7, [0.5] * 6), (7, [0.5] * 6), (None, [0.1] * 6), (2001, None), (2002, [1.0] * 5), (2003, [float("nan")] * 6), (2004, [1.0, None] * 3), (2005, [float("-inf")] * 6), (2006, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS row", "2 AS id", "3 AS v", "4 AS cluster", "5 AS `a.b`").repartition(5)
    report = []
    got = C.cluster(vectors, width=6, report=report)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert result(got) == brute(rows, width=6)
    assert report[0] == 500 + 120 + 3 and sum(report[1:]) < 0.6 * report[0] * len(report[1:])


@pytest.mark.parametrize("k,rounds", [(1, 3), (2, 0), (3, 1), (5, 25)])
def test_other_numbers_of_clusters_and_rounds(spark, k, rounds):
    rows = clouds(2, 90, 3, 0.2)
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    floats = [(i, np.array(v, dtype=np.float32).tolist()) for i, v in rows]
    assert result(C.cluster(vectors, k=k, rounds=rounds, width=3)) == brute(floats, k, rounds, 3)


def test_ties_fewer_vectors_than_clusters_and_empty(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.0]), (4, [0.5, 0.0]), (2, [1.0, 0.0])]
    schema = "vec_id long, embedding array<double>"
    assert result(C.cluster(spark.createDataFrame(rows, schema), width=2)) == brute(rows, width=2)
    assert result(C.cluster(spark.createDataFrame(rows, schema), width=2, k=2)) == brute(rows, width=2, k=2)
    assert C.cluster(spark.createDataFrame([], schema)).collect() == []
    assert C.cluster(spark.createDataFrame([(None, [1.0] * 64), (1, None)], schema)).collect() == []


def test_large_components(spark):
    rows = [(i, [(-1) ** i * 10.0 ** (i % 13), float(i)]) for i in range(40)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert result(C.cluster(vectors, k=4, width=2)) == brute(rows, 4, width=2)


def test_bounds_are_safe():
    """No vector outside the popped range could change its cluster."""
    rng = np.random.default_rng(4)
    x = rng.integers(-50, 50, (400, 4)).astype(float)
    old = rng.integers(-50, 50, (6, 4)).tolist()
    offsets = [0.0, 3.0, 0.5, 100.0, 7.0, 0.0]
    own, key = C.nearest(C.squared(x, old), offsets)
    for reach in (1, 3, 20):
        new = [[a + int(rng.integers(-reach, reach + 1)) for a in c] if j != 2 else c for j, c in enumerate(old)]
        now = C.advanced(offsets, old, new)
        after = C.squared(x, new).argmin(axis=1)
        assert (key > np.array(offsets)[own]).all()
        stays = key > np.array(now)[own]
        assert (after[stays] == own[stays]).all()


def test_tables_are_dropped(spark):
    before = {t.name for t in spark.catalog.listTables() if t.name.startswith("vectors_")}
    C.cluster(spark.createDataFrame(clouds(5, 20, 2, 0.3), "vec_id long, embedding array<double>"), width=2, rounds=2).collect()
    assert {t.name for t in spark.catalog.listTables() if t.name.startswith("vectors_")} == before


def test_query(spark):
    e = pd.read_parquet(f"{SF_CHECK}/embeddings.parquet")
    got = result(op13_centroid_clusters(spark, SF_CHECK))
    assert got == brute(list(zip(e.vec_id.tolist(), e.embedding.map(list)))) and len(got) > 100
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF_CHECK}/embeddings.parquet'")
    assert sorted(con.execute(ORACLES["op13_centroid_clusters"]).fetchall(), key=repr) == got
