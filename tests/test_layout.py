"""Messages laid out by chat: few files per chat, and files in order."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chatweave.functions.text import chat_slug
from chatweave.session import scratch_path
from chatweave.sources import layout


@pytest.fixture(scope="module")
def table(spark):
    """10,000 small chats and one with a third of all messages."""
    small = spark.range(40_000).select(F.concat(F.lit("chat "), (F.col("id") % 10_000).cast("string")).alias("chat_key"), F.col("id").alias("message_id"))
    hot = spark.range(20_000).select(F.lit("the hot chat").alias("chat_key"), (F.col("id") + 100_000).alias("message_id"))
    rows = small.unionByName(hot).select(
        "chat_key", "message_id", F.lit("You").alias("sender"), F.concat(F.lit("text "), "message_id").alias("text"), (F.col("message_id") * 7919 % 10_007).alias("time"), F.lit(0).alias("type"))
    path = scratch_path(spark, "layout")
    layout.write_by_chat(rows, path, 1, file_rows=2_000)
    return rows, path


def test_a_chat_is_read_from_few_files(spark, table):
    rows, path = table
    files = layout.file_table(spark, path)
    total = files.count()
    assert total >= 30 and files.agg(F.max("rows")).first()[0] < 6_000  # no file holds the hot chat alone
    for key, most in (("chat 77", 2), ("chat 9999", 2), ("the hot chat", 0.5 * total)):
        slug = spark.range(1).select(chat_slug(F.lit(key))).first()[0]
        chosen = layout.chat_files(spark, path, slug)
        got = layout.read_chat(spark, path, slug)
        assert len(chosen) <= most and len(got.inputFiles()) == len(chosen)
        want = rows.where(F.col("chat_key") == key)
        assert sorted(r.message_id for r in got.collect()) == sorted(r.message_id for r in want.collect())
        assert "chat_slug" in got._jdf.queryExecution().toString().split("PushedFilters")[1]
    assert len(layout.chat_files(spark, path, spark.range(1).select(chat_slug(F.lit("the hot chat"))).first()[0])) > 5
    assert layout.read_chat(spark, path, "zzz-no-such-chat").collect() == []


def test_files_in_name_order_are_the_order(spark, table):
    rows, path = table
    got = layout.ranked(spark, path, 1)
    order = Window.orderBy(*layout.KEY)
    want = rows.withColumn("chat_slug", chat_slug("chat_key")).withColumn("rank", F.row_number().over(order)).select("message_id", F.col("rank").cast("long"))
    assert got.select("message_id", "rank").exceptAll(want).count() == 0 and got.count() == 60_000
    places = got.groupBy("file_no").agg(F.min("place"), F.max("place"), F.count("*"))
    assert all(r[1] == 0 and r[2] == r[3] - 1 for r in places.collect())


def test_batches_compaction_and_empty(spark, table):
    rows, _ = table
    path, few = scratch_path(spark, "layout"), rows.where("message_id % 100 = 0")
    layout.write_by_chat(few.where("time < 3000"), path, 1)
    layout.write_by_chat(few.where("time >= 3000"), path, 2)
    layout.write_by_chat(few.limit(0), path, 3)
    columns = few.columns
    same = lambda: layout.read_messages(spark, path).select(columns).exceptAll(few).count() == 0 and layout.read_messages(spark, path).count() == few.count()
    assert same()
    layout.write_by_chat(few.where("time < 3000"), path, 1)  # a batch run again replaces itself
    assert same()
    slug = spark.range(1).select(chat_slug(F.lit("chat 0"))).first()[0]
    before = layout.read_chat(spark, path, slug).select(columns).collect()
    layout.compact(spark, path, [1, 2, 3], into=4)
    assert same() and {r.batch_id for r in layout.file_table(spark, path).collect()} == {4}
    assert sorted(layout.read_chat(spark, path, slug).select(columns).collect()) == sorted(before) and before
    with pytest.raises(ValueError):
        layout.compact(spark, path, [4], into=4)
