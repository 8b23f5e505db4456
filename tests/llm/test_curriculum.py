from __future__ import annotations

import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from chatweave.llm import curriculum as C
from chatweave.llm.queries import op7_curriculum_mix
from tests.conftest import SF_CHECK


def plain_targets(sizes):
    """sizes: source -> size."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-8")))
    weight = {s: C.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        w = sum(weight[s] for s in free)
        goal = {s: (total - sum(fixed.values())) * weight[s] / w for s in free} if free else {}
        over = [s for s in free if goal[s] > 3 * sizes[s]]
        if not over:
            return fixed | goal
        fixed |= {s: 3 * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 10, "c": 10}, {"a": 1000, "b": 10, "c": 1, None: 5}, {"z": 5}, {"b": 0, "a": 100, "é": 3, "Z": 7, None: 0}, {"a": 0, "b": 0},
    {f"s{i}": i * i for i in range(20)},
])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in C.targets(df).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_positions_invert_the_integrated_curves(spark):
    rows = [(w, k / 50) for w in C.CURVES for k in range(51)]
    got = spark.createDataFrame(rows, "w int, u double").select("w", "u", C.position(F.col("u"), F.col("w")).alias("t")).collect()
    for w, u, t in got:
        area = full = 0.0
        for (t0, a), (t1, b) in zip(C.CURVES[w], C.CURVES[w][1:]):
            full += (t1 - t0) * (a + b) / 2
            x = min(max(t - t0, 0.0), t1 - t0)
            area += a * x + (b - a) / (t1 - t0) * x * x / 2
        assert area / full == pytest.approx(u, abs=1e-9)


def test_query(spark):
    docs = pd.read_parquet(f"{SF_CHECK}/documents.parquet")
    got = op7_curriculum_mix(spark, SF_CHECK).toPandas()
    assert len(got) == len(docs)
    got = got.merge(docs[["doc_id", "source", "text"]], on="doc_id")
    assert (got["size"] == got.text.map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t)))).all()
    by = got.groupby("source").agg(total=("size", "sum"), said=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    assert (by.total == by.said).all() and (got.taken <= 3 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    assert by.target.to_dict() == pytest.approx(plain_targets(by.total.to_dict()))
    assert (abs(by.target - by.taken) <= by.most / 2 + 1).all()
    again = op7_curriculum_mix(spark, SF_CHECK).toPandas()
    assert again.set_index("doc_id").taken.to_dict() == got.set_index("doc_id").taken.to_dict()


def test_query_reads_the_mix_in_training_order(spark, tmp_path, monkeypatch):
    """the query's figures come from the copies, range-sorted and written."""
    rows = [(i, "word " * (i % 40), ["a", "b", None][i % 7 % 3]) for i in range(900)] + [(None, "x y", "a"), (None, None, None), (7, "word " * 7, "b"), (7, "word " * 7, "b")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    made, in_order = [], C.in_order
    monkeypatch.setattr(C, "in_order", lambda assigned: made.append(in_order(assigned)) or made[-1])
    got = op7_curriculum_mix(spark, str(tmp_path))
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken", "first_position"] and len(made) == 1
    assert "rangepartitioning(position" in made[0]._jdf.queryExecution().toString()
    copies = [r.asDict() for r in made[0].select("_doc.doc_id", "size", "position").collect()]
    assert [c["position"] for c in copies] == sorted(c["position"] for c in copies)
    by, first = {}, {}
    for c in copies:
        by[c["doc_id"]] = by.get(c["doc_id"], 0) + c["size"]
        first[c["doc_id"]] = min(first.get(c["doc_id"], 1.0), c["position"])
    got = got.collect()
    assert sorted((r.doc_id or -1, r["size"]) for r in got) == sorted((i or -1, len((t or "").split())) for i, t, _ in rows)
    for i in {r.doc_id for r in got}:
        mine = [r for r in got if r.doc_id == i]
        assert sum(r.taken for r in mine) == by.get(i, 0)
        assert min((r.first_position for r in mine if r.taken), default=None) == first.get(i)
    assert any(r.taken == 0 and r.first_position is None and r["size"] > 0 for r in got) and any(r.taken > r["size"] for r in got)


def test_mix_is_ordered_and_whole(spark):
    rows = [(i, "word " * (i % 40), ["a", "b", None][i % 3]) for i in range(600)] + [(None, "x y", "a"), (None, None, None), (7, "word " * 7, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "'q' AS position0", "2 AS _rank").repartition(7)
    assigned = C.assign(docs, ["doc_id", "source"]).toPandas()
    assert len(assigned) == len(rows) and assigned.copies.between(0, 3).all()
    mixed = C.mix(docs, ["doc_id", "text", "source"])
    got = mixed.collect()
    assert len(got) == assigned.copies.sum() and [r.position for r in got] == sorted(r.position for r in got)
    assert 0 <= got[0].position and got[-1].position < 1
    early = pd.DataFrame([r.asDict() for r in got])
    middle = early.groupby(early.source.fillna("-")).position.mean()
    assert middle["a"] < middle["b"] < middle["-"]  # weights 1, 2, 3: early, flat, late


def test_running_sums_over_ranges(spark, monkeypatch):
    rows = [(i, "w " * (i % 7), "hot" if i % 3 else f"s{i % 5}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    monkeypatch.setattr(C, "LEAST_RANGES", 1)
    one = C.assign(docs, ["doc_id"]).select("_doc.doc_id", "taken", "positions").toPandas().set_index("doc_id").sort_index()
    monkeypatch.setattr(C, "RANGE_ROWS", 30)
    many = C.assign(docs, ["doc_id"]).select("_doc.doc_id", "taken", "positions").toPandas().set_index("doc_id").sort_index()
    assert (one.taken == many.taken).all() and all((a == b).all() for a, b in zip(one.positions.map(pd.Series), many.positions.map(pd.Series)))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert C.assign(docs, ["doc_id"]).collect() == [] and C.mix(docs, ["doc_id"]).collect() == []
