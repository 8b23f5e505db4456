from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from chatweave.llm import quality_rules as Q
from chatweave.llm.queries import op2_quality_rules
from tests.conftest import SF_CHECK

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    grams = list(zip(w, w[1:], w[2:]))
    count, cover = Counter(grams), set()
    for k, g in enumerate(grams):
        if count[g] > 1:
            cover |= {k, k + 1, k + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover)


TEXTS = [
    None, "", " \t\n ", "one", "a b", "a b c", "a b c a b c", "a a a a", "x\nx\n \n \nx y", "a\x0bb\x0cc\rd e é 日本",
    "### *** $%&|<>", "a b c d a b c x b c d", "w " * 5000, "\n".join(["same line here"] * 40),
]


def test_statistics(spark):
    rows = spark.createDataFrame([(i, t, "en", 9, True) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, n_words int, kept boolean")
    got = {r.doc_id: r for r in Q.with_statistics(rows).collect()}
    for i, t in enumerate(TEXTS):
        assert tuple(got[i][c] for c in Q.STATISTICS) == plain(t), t
        n, *_, repeat = plain(t)
        assert got[i].base_failed == (n < 50 or 100 * repeat > 50 * n)


@pytest.mark.parametrize("n, p", [(10, 0.3), (400, 0.005), (20_000, 0.005), (300_000, 0.02)])
def test_binomial_cdf(spark, n, p):
    ks = sorted({k for k in (0, 1, 2, int(n * p * 0.7), int(n * p) - 1) if 0 <= k < n * p})
    got = spark.createDataFrame([(k,) for k in ks], "k long").select(Q.binomial_cdf(F.col("k"), F.lit(n).cast("long"), p)).collect()
    for k, (value,) in zip(ks, got):
        terms = [math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p) for j in range(k + 1)]
        want = sum(math.exp(t) for t in terms)
        assert value == pytest.approx(want, rel=1e-6, abs=1e-300)


def holdout(spark, n_good, noisy_good):
    """Languages en (enough labels) and xx (too few); bad documents are symbol-laden."""
    clean = " ".join(f"word{i}" for i in range(60))
    noisy = " ".join(f"w{i}$$$" for i in range(60))
    rows = [(i, clean, "en", 1) for i in range(n_good)] + [(10**6 + i, noisy, "en", 1) for i in range(noisy_good)]
    rows += [(2 * 10**6 + i, noisy, "en", 0) for i in range(300)] + [(3 * 10**6 + i, noisy, "xx", 0) for i in range(30)] + [(4 * 10**6 + i, clean, "xx", 1) for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    return d.select("doc_id", "text", "lang"), d.select("doc_id", "quality")


def test_cutoffs_are_certified_per_stratum(spark):
    docs, labels = holdout(spark, 4000, 0)
    out = Q.quality_rules(docs, labels, ["doc_id", "lang"]).groupBy("lang").agg(F.count_if("kept").alias("kept"), F.count("*").alias("n"))
    got = {r.lang: (r.kept, r.n) for r in out.collect()}
    assert got == {"en": (4000, 4300), "xx": (60, 60)}  # xx has too few labels to certify anything


def test_cutoffs_that_reject_good_documents_are_not_certified(spark):
    docs, labels = holdout(spark, 4000, 100)
    got = Q.quality_rules(docs, labels, ["doc_id"]).where("NOT kept").count()
    assert got == 0


def test_contradicting_and_null_labels_are_not_used(spark):
    docs, labels = holdout(spark, 4000, 0)
    labels = labels.unionByName(labels.withColumn("quality", 1 - F.col("quality"))).unionByName(labels.withColumn("quality", F.lit(None).cast("int")))
    assert Q.quality_rules(docs, labels, ["doc_id"]).where("NOT kept").count() == 0


def test_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, None, None), (1, "a b", None), (1, "a b", None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = Q.quality_rules(docs, labels, ["doc_id"]).collect()
    assert [(r.kept, r.base_failed) for r in got] == [(False, True)] * 3
    assert Q.quality_rules(docs.limit(0), labels, ["doc_id"]).collect() == []


def test_query_against_plain_reading(spark):
    docs = pd.read_parquet(f"{SF_CHECK}/documents.parquet")
    got = op2_quality_rules(spark, SF_CHECK).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    for i, t in zip(docs.doc_id, docs.text):
        assert tuple(got.loc[i, Q.STATISTICS]) == plain(t)
