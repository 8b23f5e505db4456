from __future__ import annotations

import os
import re


import corpus_pipeline as P
from chatweave.llm.common import stored
from tests.conftest import SF_SMALL
from tests.llm.test_ngram_join import corpus, plain_components, plain_components_of
from tests.llm.test_packing import check
from tests.llm.test_quality_rules import plain


def test_each_stage_on_its_own_input(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, seen = docs.columns, [docs.toPandas()]
    for name, stage in P.STAGES:
        docs = stored(stage(spark, docs, SF_SMALL), "test")
        seen.append(docs.toPandas())
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
    start, rules, langs, groups, mixed, packed = seen
    base = [i for i, t in zip(start.doc_id, start.text) if plain(t)[0] >= 50 and 100 * plain(t)[4] <= 50 * plain(t)[0]]
    assert set(rules.doc_id) == set(base)  # too few labels here to certify a cutoff
    assert len(langs) >= 0.98 * len(rules) and set(langs.doc_id) <= set(rules.doc_id)
    want = plain_components(list(zip(langs.doc_id, langs.text)))
    assert sorted(groups.doc_id) == sorted({c for _, _, c in want})
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    assert set(mixed.doc_id) <= set(groups.doc_id) and mixed.doc_id.value_counts().max() <= 3
    assert abs(mixed.text.map(words).sum() / groups.text.map(words).sum() - 1) < 0.2
    mixed["doc_id"] = range(len(mixed))  # copies of a document are packed one by one
    assert packed.length.sum() == sum(n for n in packed.groupby(["doc_id", "start"]).length.sum())
    check(P.pack_sequences(spark, spark.createDataFrame(mixed), SF_SMALL).toPandas(), list(zip(mixed.doc_id, mixed.text)))


def test_empty_and_null_rows(spark):
    schema = spark.read.parquet(f"{SF_SMALL}/documents.parquet").schema
    text = " ".join(f"word{i} the quick brown fox" for i in range(30))
    rows = [(None, None, None, None, None), (None, text, None, None, 1), (1, "", "en", "a", 0), (2, text, "en", None, 9), (3, text, "en", "a", 9), (3, text, "en", "a", 9)]
    for rows_in in ([], rows):
        docs = spark.createDataFrame(rows_in, schema)
        for _, stage in P.STAGES:
            docs = stored(stage(spark, docs, SF_SMALL), "test")
        docs.toPandas()


def test_run(spark):
    assert set(P.run(spark, SF_SMALL).columns) >= {"doc_id", "start", "length", "sequence_id", "offset"}


def test_near_copies_of_the_stage_are_five_words_at_80_percent(spark):
    words = [f"w{i}" for i in range(1000)]
    text = " ".join(words)
    cut, more = " ".join(words[:830]), text + " " + " ".join(f"m{i}" for i in range(220))  # 5-word Jaccard 0.829, 0.819
    singly = " ".join(f"x{i}" if i % 48 == 24 else w for i, w in enumerate(words))  # 21 of 1,000 words: 0.809
    rows = [(i, t) for i, t in corpus() if t] + [(10_001, text), (10_002, cut), (10_003, singly), (10_004, more)]
    other = [f"o{w}" for w in words]
    rows += [(20_001, " ".join(other)), (20_002, " ".join(other[:790]))]
    schema = spark.read.parquet(f"{SF_SMALL}/documents.parquet").schema
    docs = spark.createDataFrame([tuple({"doc_id": i, "text": t}.get(c) for c in schema.names) for i, t in rows], schema)
    got = sorted(r["doc_id"] for r in P.keep_one_of_copies(spark, docs, SF_SMALL).collect())
    assert got == sorted({c for _, _, c in plain_components_of(rows, 5, 80)})
    assert 10_001 in got and not {10_002, 10_003, 10_004} & set(got) and {20_001, 20_002} <= set(got)


def test_rows_that_share_an_id_or_have_none(spark):
    """Rows are compared by their texts whatever their ids are; none is lost for its id."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near = a.replace("a30 ", "zz ")
    rows = [(5, a), (5, b), (5, near), (None, c), (None, c), (None, "short one"), (7, b), (8, ""), (8, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS `a.b`", "2 AS _row", "3 AS n", "4 AS `x``y`", "5 AS position", "6 AS source", "'en' AS lang")
    for of in (docs, stored(docs.repartition(3), "test")):  # without files of its own, and read from files
        got = P.keep_one_of_copies(spark, of, SF_SMALL)
        assert got.columns == docs.columns
        texts = sorted((r["text"] or "", r["text"] is None) for r in got.collect())
        assert texts == sorted([(near, False)] * (near in [t for t, _ in texts]) + [(a, False)] * (a in [t for t, _ in texts]) + [(b, False), (c, False), ("short one", False), ("", False), ("", False), ("", True)])
        assert len(texts) == 7
    for stage in (P.keep_quality, P.keep_recognised, P.mix_sources):
        assert stage(spark, docs, SF_SMALL).columns == docs.columns


def test_scratch_of_a_stage_goes_when_the_next_one_begins(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    held = lambda: [p for paths in P._scratch.values() for p in paths]
    first = stored(P.keep_one_of_copies(spark, docs, SF_SMALL), "test")
    paths = held()
    assert paths and any(os.path.exists(p) for p in paths)
    second = P.mix_sources(spark, first, SF_SMALL)
    assert not any(os.path.exists(p) for p in paths) and second.count() > 0
