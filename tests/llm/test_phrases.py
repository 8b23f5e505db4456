from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from chatweave.llm import phrases as P
from chatweave.llm.oracles import ORACLES
from chatweave.llm.queries import op12_phrases
from tests.conftest import SF_CHECK

UPPER = {i: i + 32 for i in range(65, 91)}


def pieces_of(text):
    for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(UPPER)):
        yield [w for w in re.split("[ \t]+", piece) if w]


def counts_of(rows, longest=5):
    f, n = {}, Counter()
    for lang, text in rows:
        of = f.setdefault(lang or "und", Counter())
        for words in pieces_of(text):
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                of.update(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))
    return f, n


def brute(rows, threshold=100, longest=5, top=2000):
    out = []
    f, n = counts_of(rows, longest)
    for lang, of in f.items():
        many = {p: c for p, c in of.items() if c >= threshold and " " in p}
        scored = []
        for p, a in many.items():
            words = p.split(" ")
            if any(c >= a and len(q.split(" ")) > len(words) and f" {p} " in f" {q} " for q, c in many.items()):
                continue
            cuts = []
            for k in range(1, len(words)):
                left, right = of[" ".join(words[:k])], of[" ".join(words[k:])]
                cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            scored.append((-score, -a, p.encode(), left, right))
        for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_words_runs_and_spelling():
    text = "One two\tTHREE  four.five six,,\x0bé ñ x;a"
    w = P.Words(text.encode().translate(P.LOWER), len(text.encode()))
    runs = Counter(w.spell(i, k) for k, g, whole in w.runs(1, P.ROLLS[0]) for i in np.flatnonzero(whole))
    assert runs == counts_of([("x", text)])[0]["x"]
    assert w.n == 10


def test_equal_words_have_equal_hashes_at_any_place(monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 16)
    P._powers.cache_clear()
    words = ["ab", "abc", "b" * 40, "é", "ab", "b" * 40, "abc", "a" * 16, "a" * 15]
    data = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
    w = P.Words(data.tobytes(), len(data))
    h = P.word_hashes(w.data, w.starts, w.ends, P.ROLLS[0]).tolist()
    P._powers.cache_clear()
    assert {a: b for a, b in zip(words, h)} == {a: b for a, b in zip(reversed(words), reversed(h))} and len(set(h)) == len(set(words))


@pytest.mark.parametrize("size", [1, 7, 30, 200])
def test_long_texts_are_cut_with_context(size):
    rng = random.Random(size)
    text = "".join(rng.choices("ab c\t.", k=400)) + "x" * 50 + " end of it"
    got, n = Counter(), 0
    for part, limit in P.cut(text.encode(), size):
        w = P.Words(part, limit)
        n += w.n
        got.update(w.spell(i, k) for k, g, whole in w.runs(0, P.ROLLS[0]) for i in np.flatnonzero(whole))
    want, total = counts_of([("x", text)])
    assert got == want["x"] and n == total["x"]


def test_misra_gries_keeps_every_frequent_key():
    rng = np.random.default_rng(1)
    for threshold in (5, 20, 100):
        stream = np.concatenate([rng.integers(0, 1 << 32, 20000, dtype=np.uint32), np.repeat(np.arange(50, dtype=np.uint32), rng.integers(1, 3 * threshold, 50))])
        rng.shuffle(stream)
        capacity = len(stream) // threshold + 1
        one, other = P.Summary(capacity), P.Summary(capacity)
        for i, part in enumerate(np.array_split(stream, 37)):
            (one if i % 3 else other).add(*P.counted(part))
            (one if i % 3 else other).settle()
        one.merge(other)
        keys, counts = P.counted(stream)
        assert set(keys[counts >= threshold].tolist()) <= set(one.frequent(threshold).tolist())
        assert one.error < threshold and len(one.keys) <= capacity and one.error > 0


def test_packed_lists():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 32, 1000, dtype=np.uint32))
    counts = rng.integers(1, 1 << 31, len(keys))
    k, c = P.unpacked(P.packed(keys, counts))
    assert k.tolist() == keys.tolist() and c.tolist() == counts.tolist()


def invented(seed, docs=300):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["Über", "ñu", "a'b", "NEW", "york"]
    rows = []
    for i in range(docs):
        words = rng.choices(vocabulary, weights=range(1, 18), k=rng.randrange(60))
        rows.append((rng.choice(["en", "de", None, "und"]), " ".join(w + rng.choice(["", "", "", ",", ".", "\t", "\n", "  "]) for w in words)))
    rows += [("en", "new york city hall steps")] * 40 + [("en", "Hall steps")] * 7 + [("fr", None), (None, ""), (None, None), ("de", " .,\t"), ("de", "z " * 300)]
    return rows


@pytest.mark.parametrize("batch", [P.BATCH, 500])
def test_against_brute_force(spark, batch):
    rows = invented(3)
    docs = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS n", "2 AS f", "3 AS phrase", "4 AS rank", "5 AS `a.b`").repartition(3)
    got = P.collocations(docs, threshold=12, top=50, batch=batch)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(rows, 12, top=50)
    assert len(want) > 60 and rows_of(got) == want


def test_hash_partitions_lose_nothing(spark):
    rows = invented(4, 800)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(6)
    runs, totals = P.frequent_runs(docs, threshold=30)
    f, n = counts_of(rows)
    want = {(lang, p): c for lang, of in f.items() for p, c in of.items() if c >= 30}
    assert {(r.lang, r.phrase): r.f for r in runs.collect()} == want
    assert {r.lang: r.n for r in totals.collect() if r.n} == {k: v for k, v in n.items() if v}


def test_large_counts_are_exact(spark, monkeypatch):
    big = 3_000_000_000_000_000
    runs = spark.createDataFrame([("x", "a b", 2, big), ("x", "a", 1, big + 1), ("x", "b", 1, big + 7)], "lang string, phrase string, words int, f long")
    totals = spark.createDataFrame([("x", 9 * big)], "lang string, n long")
    monkeypatch.setattr(P, "frequent_runs", lambda *a, **b: (runs, totals))
    (row,) = P.collocations(runs).collect()
    assert row.score == 1000 * big * 9 * big // ((big + 1) * (big + 7))


def test_empty(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert P.collocations(docs).collect() == []
    assert P.collocations(spark.createDataFrame([("en", None), (None, "")], "lang string, text string")).collect() == []


def test_query(spark):
    d = pd.read_parquet(f"{SF_CHECK}/documents.parquet")
    want = brute([(a if isinstance(a, str) else None, b) for a, b in zip(d.lang, d.text)])
    assert rows_of(op12_phrases(spark, SF_CHECK)) == want and len(want) > 20
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_CHECK}/documents.parquet'")
    assert sorted(con.execute(ORACLES["op12_phrases"]).fetchall()) == want
