"""The stored vector index: exact against all pairs, and read in part."""

from __future__ import annotations

import glob

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chatweave.operators import vector_index as V
from chatweave.operators.retrieval import generate_context
from chatweave.operators.search import topk
from chatweave.session import scratch_path

SCHEMA = "chat_key string, item_id long, embedding array<double>"


def clustered(seed, n, chat="c", dim=8, middles=12, start=0):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(middles, dim)) * 4
    return [(chat, start + i, (m[i % middles] + 0.2 * rng.normal(size=dim)).tolist()) for i in range(n)]


def rows_of(df):
    return sorted(map(tuple, df.select("query_id", "chat_key", "item_id", "rank", "distance").collect()))


def items(spark):
    """One chat holds a third; equal vectors, zero vectors, other lengths, nulls."""
    rows = clustered(1, 700) + [r for k in range(20) for r in clustered(k, 5 * k, f"s{k}", start=10_000 * k)]
    rows += [("same", i, [1.0, 2.0, 3.0]) for i in range(150)] + [("c", 900 + i, [0.0] * 8) for i in range(3)]
    rows += [("c", 950, None), (None, 951, [1.0] * 8), ("c", 952, [1.0, 2.0]), ("c", 953, [])]
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS _n", "2 AS rank", "3 AS distance").repartition(4)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("block, k", [(16, 10), (4096, 3), (16, 1000)])
def test_equals_the_search_without_an_index(spark, metric, block, k, monkeypatch):
    monkeypatch.setattr(V, "BUCKET_BLOCKS", 7)
    monkeypatch.setattr(V, "BUCKET_QUERIES", 30)
    monkeypatch.setattr(V, "SHELF_BYTES", 8192)
    monkeypatch.setattr(V, "SALT_ITEMS", 100)
    df = items(spark)
    asked = df.where("item_id % 9 = 0 OR item_id >= 950").select(F.col("item_id").alias("query_id"), "chat_key", "embedding")
    path = scratch_path(spark, "index")
    index = V.write_index(df.where("item_id % 3 > 0"), path, metric=metric, batch_id=1, block_items=block)
    index = V.write_index(df.where("item_id % 3 = 0"), path, metric=metric, batch_id=2, block_items=block)
    report = {}
    got = rows_of(V.search_index(index, asked, k, report=report))
    assert got == rows_of(topk(asked, df, k=k, metric=metric)) and got
    sizes = [r._n for r in index.table(spark).collect()]
    assert sum(sizes) == df.where("embedding IS NOT NULL AND chat_key IS NOT NULL").count() and max(sizes) < 4 * block
    assert report["pairs_read"] <= report["pairs"]


def test_few_blocks_are_read(spark, monkeypatch):
    monkeypatch.setattr(V, "SHELF_BYTES", 1 << 13)
    df = spark.createDataFrame(clustered(3, 4000, middles=40), SCHEMA).repartition(4)
    path = scratch_path(spark, "index")
    index = V.write_index(df, path, block_items=50)
    asked = df.where("item_id < 5").select(F.col("item_id").alias("query_id"), "chat_key", "embedding")
    report = {}
    got = V.search_index(index, asked, 10, report=report)
    assert rows_of(got) == rows_of(topk(asked, df, k=10))
    assert report["blocks"] >= 80 and report["blocks_read"] <= 0.25 * report["blocks"] and report["pairs_read"] <= 0.1 * report["pairs"]
    # and of the files, those of their shelves
    shelves = len(glob.glob(f"{path}/blocks/_batch=0/_shelf=*"))
    table = index.table(spark)
    routes = table.limit(3).select("chat_key", "_dim", "_cell", "_part", "_batch").withColumn("query_id", F.lit(0).cast("long"))
    q = V._prepared(asked, "embedding", "l2", "query_id", "chat_key")
    read = V._read(index, routes, q, 10, "query_id")
    assert shelves > 20
    scan = [line for line in read._jdf.queryExecution().toString().split("\n") if "PartitionFilters" in line and "_shelf" in line]
    assert scan and "_shelf" in scan[-1].split("PartitionFilters")[1]


def test_a_batch_run_again_replaces_itself(spark):
    df, path = spark.createDataFrame(clustered(4, 300), SCHEMA), scratch_path(spark, "index")
    V.write_index(df, path, batch_id=1, block_items=20)
    index = V.write_index(df.where("item_id < 100"), path, batch_id=1, block_items=20)
    assert index.table(spark).agg(F.sum("_n")).first()[0] == 100
    assert index.blocks(spark).agg(F.sum("_n")).first()[0] == 100


def test_empty_index_and_no_queries(spark):
    none = spark.createDataFrame([], SCHEMA)
    df, path = spark.createDataFrame(clustered(5, 30), SCHEMA), scratch_path(spark, "index")
    empty = V.write_index(none, path)
    asked = df.select(F.col("item_id").alias("query_id"), "chat_key", "embedding")
    assert V.search_index(empty, asked, 3).collect() == []
    full = V.write_index(df, path, batch_id=1)
    assert V.search_index(full, asked.limit(0), 3).collect() == []
    assert V.search_index(full, asked, 1).where("query_id = item_id AND distance = 0").count() == 30


def test_contexts_from_a_stored_index(spark):
    chunks = spark.createDataFrame([(c, b, n, f"{c}{b}{n} text", [float(n), float(b)]) for c in "xy" for b in (0, 1) for n in range(6)],
                                   "chat_key string, batch_id long, chunk_no long, text string, embedding array<float>")
    questions = spark.createDataFrame([(1, "x", "q", [0.1, 1.0]), (2, "y", "q", [4.0, 0.0]), (3, "z", "q", [4.0, 0.0])], "query_id long, chat_key string, query string, embedding array<float>")
    index = V.write_index(chunks, scratch_path(spark, "index"), item_keys=("batch_id", "chunk_no"), block_items=3)
    got = generate_context(questions, chunks, 4, index=index)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, generate_context(questions, chunks, 4).collect()))


def test_many_small_groups_are_routed_in_one_call():
    """a lot has the blocks and queries of many chats; each keeps to its own."""
    rng = np.random.default_rng(4)
    at, place = ["chat_key", "_dim", "_chunk", "_bucket"], ["chat_key", "_dim", "_cell", "_part", "_batch"]
    out = ["query_id", *place, "_least", "_middle", "_edge", "_n"]
    keys = [(f"c{i % 40}", 2 + i % 40 % 2, 0, 0) for i in range(120)]
    blocks = pd.DataFrame(keys, columns=at).assign(_cell=range(120), _part=0, _batch=0, _n=rng.integers(1, 5, 120), _radius=rng.random(120))
    blocks["_centre"] = [rng.random(d) for d in blocks["_dim"]]
    queries = pd.DataFrame(keys[:90] + [("none", 2, 0, 0)], columns=at).assign(query_id=range(91))
    queries["_v"] = [rng.random(d) for d in queries["_dim"]]
    routes = V._routes("l2", 3, "query_id", at, place, out)
    alone = [routes(b, queries[(queries[at] == b[at].iloc[0]).all(axis=1)]) for _, b in blocks.groupby(at)]
    got, want = (x.sort_values(["query_id", "_cell"]).reset_index(drop=True) for x in (routes(blocks, queries), pd.concat([a for a in alone if len(a)])))
    assert got.columns.tolist() == out and len(got) >= 90 and set(got.query_id) == set(range(90))
    pd.testing.assert_frame_equal(got, want, check_dtype=False)
    assert (got.chat_key == got.query_id.map(queries.chat_key)).all()
