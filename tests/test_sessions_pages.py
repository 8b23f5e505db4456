"""Sessions by gaps, chunks within them, and pages of the joined text."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chatweave.operators import chunking, pages, sessions


def invented(seed=3):
    rnd, rows = random.Random(seed), []
    for chat, (n, silence) in enumerate([(900, 0.02), (1, 0), (200, 0.5), (0, 0), (300, 0.0), (40, 1.0)]):
        t = 0
        for i in range(n):
            t += rnd.choice([0, 1, 5]) + (rnd.randint(11, 400) if rnd.random() < silence else 0)
            rows.append((f"c:{chat}", rnd.randint(0, 1) if chat == 2 else 0, t, i * 3 % 1000, "x" * rnd.choice([0, 3, 40, 300, 1500])))
    return rows


def parted(rows, gap):
    groups = defaultdict(list)
    for r in sorted(rows):
        groups[r[0], r[1]].append(r)
    out = defaultdict(list)
    for (chat, batch), lines in groups.items():
        no = 0
        for i, r in enumerate(lines):
            no += i > 0 and r[2] - lines[i - 1][2] > gap
            out[chat, batch, no].append(r)
    return out


@pytest.mark.parametrize("parts", [1, 4, 17])
@pytest.mark.parametrize("gap", [10, 0, -1, 10**9])
def test_sessions_equal_a_walk_over_each_chat(spark, parts, gap):
    rows = invented()
    lines = spark.createDataFrame(rows, chunking.LINES_SCHEMA).repartition(3)
    want = {k: (min(r[2] for r in v), max(r[2] for r in v), len(v)) for k, v in parted(rows, gap).items()}
    got = {(r.chat_key, r.batch_id, r.session_no): (r.first_time, r.last_time, r.n_lines) for r in sessions.sessions(lines, gap, parts).collect()}
    assert got == want


@pytest.mark.parametrize("parts", [1, 13])
def test_session_chunks(spark, parts):
    rows = invented(5)
    lines = spark.createDataFrame(rows, chunking.LINES_SCHEMA).repartition(5)
    want = [(k, c) for k, v in parted(rows, 10).items() for c in chunking.greedy_fold([r[4] for r in v])]
    got = sorted(sessions.chunk_session(lines, 10, num_partitions=parts).collect(), key=lambda r: (r.chat_key, r.batch_id, r.session_no, r.chunk_no))
    assert [((r.chat_key, r.batch_id, r.session_no), r.text) for r in got] == sorted(want, key=lambda x: x[0])


def test_one_session_of_many_lines_and_empty(spark):
    lines = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 500)).alias("chat_key"), F.lit(0).cast("long").alias("batch_id"),
        F.col("id").alias("time"), F.col("id").alias("message_id"), F.lit("some words").alias("line"))
    got = sessions.sessions(lines, 100, 16)
    hot = got.where("chat_key = 'hot'").collect()
    assert len(hot) == 1 and hot[0].n_lines == 10_000 and hot[0].session_no == 0
    assert got.where("chat_key <> 'hot'").agg(F.max("n_lines")).first()[0] == 1
    none = lines.limit(0)
    assert sessions.chunk_session(none).collect() == [] and pages.join_pages(none).collect() == []


@pytest.mark.parametrize("page", [1, 7, 100, 5000])
def test_pages_concatenate_to_the_joined_text(spark, page):
    rows = [r for r in invented(8) if r[2] < 300] + [("one", 0, 1, 1, ""), ("uni", 0, 1, 1, "é😀ñ" * 9)]
    lines = spark.createDataFrame(rows, chunking.LINES_SCHEMA).repartition(4)
    texts = defaultdict(list)
    for r in sorted(rows):
        texts[r[0], r[1]].append(r[4])
    got = defaultdict(list)
    for r in sorted(pages.join_pages(lines, page, 6).collect(), key=lambda r: (r.chat_key, r.batch_id, r.page_no)):
        assert r.page_no == len(got[r.chat_key, r.batch_id])
        got[r.chat_key, r.batch_id].append(r.text)
    assert {k: "".join(v) for k, v in got.items()} == {k: t for k, v in texts.items() if (t := "\n".join(v))}
    assert all(len(p) == page for v in got.values() for p in v[:-1])


def test_pages_of_a_large_chat_are_many_groups(spark):
    lines = spark.range(20_000).select(F.lit("hot").alias("chat_key"), F.lit(0).cast("long").alias("batch_id"), F.col("id").alias("time"), F.col("id").alias("message_id"), F.lit("").alias("line"))
    out = pages.join_pages(lines, 1000, 8)
    assert out.count() == 20 and out.agg(F.sum(F.length("text"))).first()[0] == 19_999
    assert out.withColumn("n", F.row_number().over(Window.partitionBy("chat_key").orderBy("page_no"))).where("n <> page_no + 1").count() == 0
