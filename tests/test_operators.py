"""Distributed operators against brute force on small fixtures: greedy
chunking, positions, containment join, exact top-k, incremental loads."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

import pytest

from chatweave import schemas
from chatweave.operators import chunking, containment, retrieval, search, sequence
from chatweave.operators.embed import embed_hashed, embed_with_model
from chatweave.session import scratch_path
from chatweave.sources import sinks
from chatweave.sources.store import jdbc_options
from chatweave.streaming import incremental
from tests.conftest import BOOKS, GARDEN, PEOPLE, SF_CHECK, definitions


def _random_lines(seed=7):
    rnd = random.Random(seed)
    rows = []
    for chat, n in enumerate([3, 300, 40, 1, 700, 90]):
        for i in range(n):
            if chat == 4:
                length = 1  # equal short lines: greedy trajectories never merge
            elif rnd.random() < 0.03:
                length = rnd.randint(1001, 2600)
            else:
                length = rnd.randint(0, 400)
            words, total = [], 0
            while total < length:
                w = "x" * rnd.randint(1, 1500 if length > 1000 else 12)
                words.append(w)
                total += len(w) + 1
            rows.append((f"c{chat}", 0 if chat != 1 else i // 120, i * 10 + (i * 3) % 7, i, " ".join(words)[:length]))
    return rows


def _expected(rows):
    groups = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3])):
        groups[(r[0], r[1])].append(r[4])
    return [(k[0], k[1], c) for k, lines in groups.items() for c in chunking.greedy_fold(lines)]


def test_greedy_chunks_equal_sequential_fold_at_any_partitioning(spark):
    rows = _random_lines()
    df = spark.createDataFrame(rows, chunking.LINES_SCHEMA)
    expected = _expected(rows)
    for parts in (1, 5, 23):
        got = chunking.chunk_greedy(df, num_partitions=parts).collect()
        ordered = sorted(got, key=lambda r: (r.chat_key, r.batch_id, r.chunk_no))
        assert [(r.chat_key, r.batch_id, r.text) for r in ordered] == expected
        assert all(len(r.text) <= chunking.CHUNK_SIZE for r in got)


def test_greedy_on_real_conversations(spark):
    conv = spark.read.parquet(f"{SF_CHECK}/conversations.parquet")
    lines = conv.select(
        F.concat(F.lit("chat"), (F.col("conv_id") % 7).cast("string")).alias("chat_key"),
        F.lit(0).cast("long").alias("batch_id"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("time"),
        F.col("turn").alias("message_id"),
        F.concat(F.col("role"), F.lit(": "), F.regexp_replace("text", "\n", " ")).alias("line"),
    )
    rows = [tuple(r) for r in lines.collect()]
    got = chunking.chunk_greedy(lines, num_partitions=11).collect()
    ordered = sorted(got, key=lambda r: (r.chat_key, r.batch_id, r.chunk_no))
    assert [(r.chat_key, r.batch_id, r.text) for r in ordered] == _expected(rows)


def test_split_long_line():
    line = "a" * 2500 + " bb " + "c" * 10
    assert chunking.split_long_line(line) == ["a" * 1000, "a" * 1000, "a" * 500 + " bb " + "c" * 10]


def test_positions_match_window_functions(spark):
    rows = _random_lines(3)
    df = spark.createDataFrame(rows, chunking.LINES_SCHEMA).withColumn("_len", F.length("line"))
    pos = sequence.with_positions(df, ["chat_key", "batch_id"], ["time", "message_id"], "_len", 9)
    w = Window.partitionBy("chat_key", "batch_id").orderBy("time", "message_id")
    chk = pos.withColumn("rp", F.row_number().over(w) - 1).withColumn(
        "ro", F.coalesce(F.sum(F.col("_len") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    assert chk.where((F.col("rp") != F.col("_pos")) | (F.col("ro") != F.col("_offset"))).count() == 0
    assert chk.count() == len(rows)


@pytest.fixture(scope="module")
def many_lines(spark):
    """200,000 lines; one chat holds 60 % of them."""
    rnd = F.pmod(F.xxhash64("id"), F.lit(1000))
    df = spark.range(200_000).select(
        F.when(rnd < 600, F.lit("hot")).otherwise(F.concat(F.lit("c"), (F.col("id") % 37).cast("string"))).alias("chat_key"),
        F.lit(0).cast("long").alias("batch_id"),
        F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(50_000)).alias("time"),
        F.col("id").alias("message_id"),
        F.concat(F.lit("m"), F.repeat(F.lit("x"), F.when(rnd == 999, F.lit(1500)).otherwise(rnd % 180).cast("int"))).alias("line"),
    )
    path = scratch_path(spark, "many-lines")
    df.write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("reuse, adaptive", [("true", "true"), ("false", "true"), ("true", "false"), ("false", "false")])
def test_partition_ids_are_stable_on_many_lines(spark, many_lines, reuse, adaptive):
    conf = {"spark.sql.exchange.reuse": reuse, "spark.sql.adaptive.enabled": adaptive}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        pos = sequence.with_positions(many_lines.withColumn("_len", F.length("line")), ["chat_key", "batch_id"], ["time", "message_id"], "_len", 16)
        w = Window.partitionBy("chat_key", "batch_id").orderBy("time", "message_id")
        wrong = pos.withColumn("rp", F.row_number().over(w) - 1).withColumn(
            "ro", F.coalesce(F.sum(F.col("_len") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ).where((F.col("rp") != F.col("_pos")) | (F.col("ro") != F.col("_offset")))
        assert (pos.count(), wrong.count()) == (200_000, 0)
        got = chunking.chunk_greedy(many_lines, num_partitions=16).toPandas().sort_values(["chat_key", "batch_id", "chunk_no"])
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    rows = list(many_lines.toPandas().itertuples(index=False, name=None))
    assert list(zip(got.chat_key, got.batch_id, got.text)) == _expected(rows)


@pytest.mark.parametrize("fan, carries", [(2, 1_000), (3, 0), (256, 0)])
def test_stitch_in_levels_and_without_broadcast(spark, monkeypatch, fan, carries):
    monkeypatch.setattr(chunking, "FAN", fan)
    monkeypatch.setattr(chunking, "BROADCAST_CARRIES", carries)
    rows = _random_lines(9)
    got = chunking.chunk_greedy(spark.createDataFrame(rows, chunking.LINES_SCHEMA), num_partitions=29).collect()
    ordered = sorted(got, key=lambda r: (r.chat_key, r.batch_id, r.chunk_no))
    assert [(r.chat_key, r.batch_id, r.text) for r in ordered] == _expected(rows)


def test_offsets_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(sequence, "BROADCAST_ROWS", 0)
    test_positions_match_window_functions(spark)


def test_folds_compose_for_every_entry_state():
    def plain(lengths, size, state):
        starts = 0
        for n in lengths:
            if n > size:
                state, starts = -1, starts + 2
            elif state == -1 or state + 1 + n > size:
                state, starts = n, starts + 1
            else:
                state += 1 + n
        return state, starts

    def fold(lengths, size):
        f = chunking.Fold(size)
        for n in lengths:
            f.add(n, 2)
        return f.pieces()

    rnd = random.Random(1)
    for _ in range(400):
        size = rnd.choice([5, 10, 40])
        a, b = ([rnd.choice([0, 1, 1, 2, 5, rnd.randint(0, size), size + rnd.randint(0, 1)]) for _ in range(rnd.randint(1, 30))] for _ in "ab")
        both = chunking.compose_pieces(fold(a, size), fold(b, size), size)
        for e in range(-1, size + 1):
            assert chunking.apply_pieces(fold(a, size), e) == plain(a, size, e)
            assert chunking.apply_pieces(both, e) == plain(a + b, size, e)


def test_summaries_of_equal_lines_stay_short():
    f = chunking.Fold(1000)
    for _ in range(500):
        f.add(99)
    assert len(f.length) <= 11 and len(f.pieces()) <= 1001


def test_containment_join_equals_brute_force(spark):
    rnd = random.Random(11)
    alphabet = "ab1%_\\"
    texts = ["".join(rnd.choice("ab1\\%_") for _ in range(rnd.randint(0, 8))) for _ in range(150)]
    pats = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 4))) for _ in range(60)]
    pats += ["%", "_", "", "A", "B1", "491555000", "+49_555%01"]
    texts += ["+4915550001122", "+4915550003344", "x" * 40 + "4915550001122" + "y" * 40]
    pats += ["4915550001122", "15550001122", "5550003344", "%1555000%", "1555_001"]
    tdf = spark.createDataFrame(list(enumerate(texts)), "tid long, t string")
    pdf = spark.createDataFrame(list(enumerate(pats)), "pid long, p string")
    got = sorted((r.tid, r.pid) for r in containment.containment_join(tdf, "t", pdf, "p").collect())
    # brute force with Spark's own ILIKE on every pair
    escaped = F.regexp_replace(F.col("p"), r"\\", r"\\\\")
    pairs = tdf.crossJoin(pdf)  # brute force on a 153 x 72 fixture only
    want_df = pairs.where(F.like(F.lower("t"), F.concat(F.lit("%"), F.lower(escaped), F.lit("%"))))
    want = sorted((r.tid, r.pid) for r in want_df.collect())
    assert got == want
    literal = sorted((r.tid, r.pid) for r in containment.containment_join(tdf, "t", pdf, "p", literal=True).collect())
    assert literal == sorted((t, p) for t, text in enumerate(texts) for p, pat in enumerate(pats) if pat.lower() in text.lower())


def test_texts_emit_only_grams_that_a_pattern_looks_for(spark):
    texts = spark.createDataFrame([(i, f"+49155500{i:05d}") for i in range(300)], "tid long, t string")
    pats = spark.createDataFrame([(0, "4915550000007"), (1, "15550000299")], "pid long, p string")
    windows = containment.pattern_windows(pats, "p", False)
    assert {r._width for r in windows.collect()} == {10}
    grams = containment.text_grams(texts, "t", [10])
    assert grams.count() == 300 * 5  # five 10-grams per number instead of 1-, 2- and 3-grams
    got = sorted((r.tid, r.pid) for r in containment.containment_join(texts, "t", pats, "p").collect())
    assert got == [(7, 0), (299, 1)]


@pytest.mark.parametrize("block, bucket", [(search.BLOCK_ITEMS, search.BUCKET_QUERIES), (17, 5)])
def test_exact_topk_equals_brute_force(spark, block, bucket):
    rnd = np.random.default_rng(5)
    vecs = rnd.normal(size=(300, 8)).astype(np.float32)
    groups = rnd.integers(0, 3, size=300)
    items = spark.createDataFrame(
        [(int(i), int(groups[i]), [float(x) for x in vecs[i]]) for i in range(300)],
        "item_id long, chat_key int, embedding array<float>",
    )
    queries = items.withColumnRenamed("item_id", "query_id")
    for metric in ("l2", "cosine"):
        got = search.topk(queries, items, k=5, group_cols=("chat_key",), metric=metric, block_items=block, bucket_queries=bucket)
        got = {(r.query_id, r.rank): r.item_id for r in got.collect()}
        v = vecs.astype(np.float64)
        if metric == "cosine":
            v = (vecs / np.linalg.norm(vecs, axis=1, keepdims=True)).astype(np.float32).astype(np.float64)
        for q in range(300):
            same = [i for i in range(300) if groups[i] == groups[q]]
            far = (lambda a, b: 1 - float(a @ b)) if metric == "cosine" else (lambda a, b: float(np.sqrt(((a - b) ** 2).sum())))
            d = sorted((far(v[q], v[i]), i) for i in same)[:5]
            for rank, (_, i) in enumerate(d, start=1):
                assert got[(q, rank)] == i


def test_blocks_return_k_rows_per_query_not_a_row_per_item(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, 0 if i % 3 else 1, [float(x) for x in rnd.normal(size=4)]) for i in range(900)]
    items = spark.createDataFrame(rows, "item_id long, chat_key int, embedding array<float>")
    index = search.build_index(items, block_items=100)
    assert index.groups.agg(F.max("_blocks")).first()[0] == 6
    assert index.items.groupBy("chat_key", "_block").count().agg(F.max("count")).first()[0] < 200
    found = search.search(index, items.withColumnRenamed("item_id", "query_id"), k=3, bucket_queries=64)
    assert found.count() == 900 * 3


def test_zero_vectors_have_cosine_similarity_zero(spark):
    items = spark.createDataFrame([(1, "c", [0.0, 0.0]), (2, "c", [0.3, 0.954]), (3, "c", [-1.0, 0.0])], "item_id long, chat_key string, embedding array<float>")
    asked = spark.createDataFrame([(9, "c", [1.0, 0.0]), (8, "c", [0.0, 0.0])], "query_id long, chat_key string, embedding array<float>")
    got = {(r.query_id, r.rank): (r.item_id, round(r.similarity, 2)) for r in search.topk(asked, items, k=3, metric="cosine").collect()}
    assert [got[9, r] for r in (1, 2, 3)] == [(2, 0.3), (1, 0.0), (3, -1.0)]
    assert [got[8, r] for r in (1, 2, 3)] == [(1, 0.0), (2, 0.0), (3, 0.0)]


def test_one_query_id_in_two_chats(spark):
    vectors = embed_hashed(spark.createDataFrame(
        [("a", 0, 0, "apples and pears"), ("a", 0, 1, "beans"), ("b", 0, 0, "trains and buses"), ("b", 0, 1, "bikes")],
        "chat_key string, batch_id long, chunk_no long, text string"))
    asked = spark.createDataFrame([(7, "a", "beans"), (7, "b", "bikes")], "query_id long, chat_key string, query string")
    got = {r.chat_key: r.context for r in retrieval.generate_context(asked, vectors, k=1).collect()}
    assert got == {"a": "beans", "b": "bikes"}
    prompts = retrieval.build_prompts(retrieval.generate_context(asked, vectors, k=1)).collect()
    assert {(r.query_id, r.chat_key, r.msg_pos) for r in prompts} == {(7, c, i) for c in "ab" for i in (0, 1)}
    assert {(r.temperature, r.frequency_penalty, r.max_tokens) for r in prompts} == {(0.7, 0.3, 500)}


def _toy_model():
    """Counts of a few letters."""
    return lambda texts: np.array([[t.lower().count(c) for c in "aeiou"] for t in texts], dtype=np.float32)


def _toy_embedding(df, text_col, out_col):
    return embed_with_model(df, _toy_model, text_col, out_col)


def test_user_model_through_index_and_context(spark, store):
    chats, contacts = definitions(spark, groups=[GARDEN])
    state = scratch_path(spark, "model-test")
    incremental.ingest_batch(store, chats, contacts, state, 1)
    incremental.index_batch(spark, state, 1, embed_fn=_toy_embedding)
    vectors = incremental.read_table(spark, state, "chunk_vectors")
    for r in vectors.collect():
        assert list(r.embedding) == _toy_model()([r.text])[0].tolist()
    asked = spark.createDataFrame([(1, "garden", "beans")], "query_id long, chat_key string, query string")
    got = retrieval.generate_context(asked, vectors, embed_fn=_toy_embedding).collect()
    assert "cover the beans" in got[0].context


def test_lsh_recall(spark):
    e = spark.read.parquet(f"{SF_CHECK}/embeddings.parquet")
    q = e.withColumnRenamed("vec_id", "query_id")
    exact = search.topk(q, e, k=10, group_cols=("label",), item_keys=("vec_id",))
    approx = search.lsh_topk(q, e, dim=64, k=10, group_cols=("label",), item_keys=("vec_id",))
    assert exact.join(approx, ["query_id", "vec_id"]).count() >= 0.9 * exact.count()


def test_hashed_embedding_is_unit_length(spark):
    df = spark.createDataFrame([(1, "Hello hello world"), (2, ""), (3, "!!")], "id long, text string")
    rows = {r.id: r.embedding for r in embed_hashed(df).collect()}
    assert abs(sum(x * x for x in rows[1]) - 1.0) < 1e-5
    assert sum(abs(x) for x in rows[2]) == 0.0 and sum(abs(x) for x in rows[3]) == 0.0


def _before(store, date):
    return type(store)(store.handle, store.chat, store.message.where(F.col("date") <= date), store.chat_message_join)


def _saved(spark, state):
    return [(r.message_id, r.batch_id) for r in incremental.read_table(spark, state, "messages").orderBy("time", "message_id").collect()]


def test_incremental_ingest_is_idempotent_and_uses_marks(spark, store):
    chats, contacts = definitions(spark, groups=[GARDEN])
    state = scratch_path(spark, "ingest-test")
    incremental.ingest_batch(_before(store, 7260), chats, contacts, state, 1)
    incremental.ingest_batch(store, chats, contacts, state, 2)
    incremental.ingest_batch(store, chats, contacts, state, 2)  # re-run of batch 2
    assert _saved(spark, state) == [(498, 1), (501, 1), (502, 1), (503, 2), (520, 2)]
    marks = incremental.read_table(spark, state, "marks").orderBy("batch_id").collect()
    assert [(r.mark_time, r.mark_id, r.batch_id) for r in marks] == [(7260, 502, 1), (7400, 520, 2)]
    assert not incremental._exists(spark, f"{state}/staging-1") and not incremental._exists(spark, f"{state}/staging-2")
    incremental.index_batch(spark, state, 1)
    incremental.index_batch(spark, state, 2)
    vecs = incremental.read_table(spark, state, "chunk_vectors").collect()
    assert sorted(r.batch_id for r in vecs) == [1, 2]


def test_incremental_ingest_individual_chat(spark, store):
    chats, contacts = definitions(spark, people=PEOPLE[:1])
    state = scratch_path(spark, "ingest-individual")
    incremental.ingest_batch(_before(store, 8000), chats, contacts, state, 1, rules=())
    incremental.ingest_batch(store, chats, contacts, state, 2, rules=())
    assert _saved(spark, state) == [(545, 1), (530, 1), (531, 2), (540, 2)]


def test_loads_and_indexes_of_nothing(spark, store):
    chats, contacts = definitions(spark, groups=[GARDEN])
    state = scratch_path(spark, "ingest-nothing")
    incremental.ingest_batch(_before(store, 0), chats, contacts, state, 1)  # first load: no message
    assert _saved(spark, state) == []
    incremental.index_batch(spark, state, 1)
    none_left = incremental.Rule(lambda df: df.where("false"))
    incremental.ingest_batch(store, chats, contacts, state, 2, rules=(none_left,))  # no row survives
    incremental.index_batch(spark, state, 2)
    assert incremental.read_table(spark, state, "chunk_vectors").collect() == []
    assert incremental.read_table(spark, state, "marks").count() == 1


def test_rerun_that_yields_nothing_clears_its_batch(spark, store):
    chats, contacts = definitions(spark, groups=[GARDEN])
    state = scratch_path(spark, "ingest-clear")
    incremental.ingest_batch(store, chats, contacts, state, 1, rules=())
    assert len(_saved(spark, state)) == 6
    incremental.ingest_batch(store, chats, contacts, state, 1, rules=(incremental.Rule(lambda df: df.where("false")),))
    assert _saved(spark, state) == []


def test_batches_and_streams_do_not_share_a_state(spark, store):
    chats, contacts = definitions(spark, groups=[GARDEN])
    state = scratch_path(spark, "ingest-owner")
    incremental.ingest_batch(_before(store, 7260), chats, contacts, state, 1, rules=())
    inbox = f"{state}/inbox"
    store.message.write.parquet(f"{inbox}/drop=1")
    with pytest.raises(incremental.StateOwnerError):
        incremental.stream_ingest(spark, inbox, store, chats, contacts, state)
    assert _saved(spark, state) == [(498, 1), (501, 1), (502, 1)]


def test_jdbc_reads_are_split_by_row_id():
    assert jdbc_options("jdbc:x", "SELECT 1", {"user": "u"}, None, 8) == {"url": "jdbc:x", "user": "u", "query": "SELECT 1"}
    split = jdbc_options("jdbc:x", "SELECT 1", None, (1, 900), 8)
    assert (split["partitionColumn"], split["lowerBound"], split["upperBound"], split["numPartitions"]) == ("rowid", "1", "900", "8")


def test_csv_round_trip_is_lossless(spark):
    rows = [("c", 1, "s", 'a "quoted"\nline', 1, 0), ("c", 2, "s", "  padded  ", 2, 0),
            ("c", 3, "s", "", 3, 0), ("c", 4, None, "\\N-like NA", 4, 0)]
    df = spark.createDataFrame(rows, "chat_key string, message_id long, sender string, text string, time long, type int")
    path = scratch_path(spark, "csv-test")
    sinks.write_csv(df, path)
    back = sorted(tuple(r) for r in sinks.read_csv(spark, path).collect())
    assert back == sorted(rows)


def test_range_partitions_grow_with_the_input(spark):
    from chatweave.session import materialize

    small = materialize(spark.range(100).repartition(2))
    big = materialize(spark.range(100).repartition(37))
    configured = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sequence.default_partitions(small) == max(configured, 2)
    assert sequence.default_partitions(big) == 37
    r = sequence.range_sorted(big.withColumn("g", F.col("id") % 3), ["g"], ["id"])
    assert r.rdd.getNumPartitions() == 37


def test_exact_topk_hot_group_and_ties(spark):
    rnd = np.random.default_rng(11)
    n = 900
    vecs = rnd.normal(size=(n, 6)).round(1).astype(np.float32)
    vecs[100:160] = vecs[0:60]  # exact duplicates: ties broken by item key
    groups = np.where(rnd.random(n) < 0.8, 0, rnd.integers(1, 4, size=n))  # group 0 holds ~80%
    items = spark.createDataFrame(
        [(int(i), int(groups[i]), [float(x) for x in vecs[i]]) for i in range(n)],
        "item_id long, chat_key int, embedding array<float>",
    )
    queries = items.where(F.col("item_id") % 7 == 0).withColumnRenamed("item_id", "query_id")
    got = search.topk(queries, items, k=10, group_cols=("chat_key",), block_items=64)
    got = {(r.query_id, r.rank): r.item_id for r in got.collect()}
    v = vecs.astype(np.float64)
    for q in range(0, n, 7):
        same = [i for i in range(n) if groups[i] == groups[q]]
        want = sorted((float(np.sqrt(((v[q] - v[i]) ** 2).sum())), i) for i in same)[:10]
        assert [got[(q, r)] for r in range(1, len(want) + 1)] == [i for _, i in want]


def test_stream_ingest_processes_each_drop_once(spark, store):
    chats, contacts = definitions(spark, groups=[GARDEN, BOOKS])
    state = scratch_path(spark, "stream-test")
    inbox = f"{state}/inbox"
    store.message.where(F.col("date") <= 7000).write.parquet(f"{inbox}/drop=1")
    incremental.stream_ingest(spark, inbox, store, chats, contacts, state, rules=(), index=False)
    store.message.where(F.col("date") > 7000).write.parquet(f"{inbox}/drop=2")
    incremental.stream_ingest(spark, inbox, store, chats, contacts, state, rules=(), index=True)
    incremental.stream_ingest(spark, inbox, store, chats, contacts, state, rules=(), index=True)  # nothing new
    assert _saved(spark, state) == [
        (498, 1), (510, 1), (512, 1), (511, 1), (513, 1), (514, 1), (501, 2), (502, 2), (507, 2), (503, 2), (520, 2)
    ]
    vecs = incremental.read_table(spark, state, "chunk_vectors").collect()
    assert sorted({r.batch_id for r in vecs}) == [2]


def test_empty_index_gives_empty_context(spark):
    items = spark.createDataFrame([], "chat_key string, batch_id long, chunk_no long, text string, embedding array<float>")
    assert set(schemas.CHUNK_VECTORS.fieldNames()) < set(items.columns)
    qs = spark.createDataFrame([(1, "c", "hello")], "query_id long, chat_key string, query string")
    ctx = retrieval.generate_context(qs, items).collect()
    assert [(r.query_id, r.context) for r in ctx] == [(1, "")]
    assert retrieval.build_prompts(retrieval.generate_context(qs, items)).count() == 2
