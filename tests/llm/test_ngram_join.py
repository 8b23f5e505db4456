from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from chatweave.llm import ngram_join as J
from chatweave.llm.queries import op8_ngram_join
from tests.conftest import SF_CHECK


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return set() if not words else {tuple(words)} if len(words) < 4 else set(zip(words, words[1:], words[2:], words[3:]))


def plain_components(rows):
    """rows: (id, text). Every pair that shares a shingle is compared."""
    sets, inverted, both = [(i, plain_set(t)) for i, t in rows], defaultdict(list), Counter()
    for k, (_, s) in enumerate(sets):
        for x in s:
            inverted[x].append(k)
    for ks in inverted.values():
        both.update((a, b) for n, a in enumerate(ks) for b in ks[n + 1 :])
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), k in both.items():
        if 100 * k >= 85 * (len(sets[a][1]) + len(sets[b][1]) - k):
            x, y = find(sets[a][0]), find(sets[b][0])
            parent[max(x, y)] = min(x, y)
    return [(i, len(s), find(i)) for i, s in sets]


def test_hamming_is_the_largest_difference_of_linked_sets():
    for a in range(1, 80):
        for b in range(a, 80):
            most = max((a + b - 2 * k for k in range(a + 1) if J.linked(k, a, b)), default=None)
            if most is not None:
                assert most <= J.hamming(a + b)


def test_bounds_used_for_prefixes_of_differences():
    for t in range(2, 5000):
        assert (J.hamming(t) - t) % 2 == 0 and abs(J.hamming(t + 1) - J.hamming(t)) == 1
        assert max(J.hamming(s) for s in range(max(1, t - 12), t + 1)) <= J.hamming(t) + 1


def test_bands_meet_all_partners():
    starts = J.band_starts()
    for n in [*range(1, 3000), 10**6]:
        band = np.searchsorted(starts, n, "right") - 1
        assert 100 * n // 85 < starts[band + 2]


@pytest.mark.parametrize("seed", range(6))
def test_linked_sets_share_a_key(seed):
    rng = np.random.default_rng(seed)
    pool = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2))
    hot = np.sort(rng.choice(pool, 400, replace=False)) if seed % 2 else np.zeros(0, np.uint64)
    for _ in range(400):
        n = int(rng.integers(1, 15)) if rng.random() < 0.5 else int(rng.integers(15, 400))
        base = rng.choice(hot if len(hot) and rng.random() < 0.3 and n < 300 else pool, n, replace=False)
        drop, add = int(rng.integers(0, max(1, n // 6) + 1)), int(rng.integers(0, max(1, n // 6) + 1))
        other = np.unique(np.concatenate([rng.permutation(base)[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64)]))
        a, b = np.unique(base), other
        if J.linked(len(np.intersect1d(a, b)), len(a), len(b)):
            (ka, sa), (kb, sb) = J.signatures(a, hot), J.signatures(b, hot)
            both = np.intersect1d(ka, kb)
            # one more key in common, in some band, than either may leave out
            assert any((both & 1 == bit).sum() > max(sa[bit], sb[bit]) for bit in (0, 1))


def near_copies(rng, words, n):
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(0, len(w)))] = f"new{rng.integers(0, 10**6)}"
        out.append(" ".join(w))
    return out


def corpus():
    rng, texts = np.random.default_rng(5), []
    vocabulary = [f"w{i}" for i in range(300)]
    for size in (4, 7, 12, 30, 60, 90, 150):
        texts += near_copies(rng, rng.choice(vocabulary, size), 25)
    passage = " ".join(rng.choice(vocabulary, 60))
    texts += [passage + " " + " ".join(rng.choice(vocabulary, int(rng.integers(5, 80)))) for _ in range(60)]  # a shared passage
    chain = rng.choice(vocabulary, 80).tolist()
    for _ in range(40):  # each links to the next, first and last do not
        chain[int(rng.integers(0, 80))] = f"c{rng.integers(0, 10**6)}"
        texts.append(" ".join(chain))
    texts += ["Same TEXT here now ok"] * 30 + ["same text HERE now ok", "a b", "A B", "a", "", " \n", None, None, "É b c d", "é b c d"]
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("few", [J.FEW, 0, 10**9])
def test_against_all_pairs(spark, few, monkeypatch):
    monkeypatch.setattr(J, "FEW", few)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS rep", "2 AS n", "3 AS key").repartition(5)
    got = sorted(tuple(r) for r in J.ngram_join(docs).collect())
    assert got == sorted(plain_components(rows))


def test_shared_ids_nulls_and_empty(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(5, a), (3, a), (5, b), (9, b), (None, a), (7, "lone text of words"), (7, "lone text of words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id) for r in J.ngram_join(docs).collect())
    assert got == Counter({(5, 3): 2, (3, 3): 1, (9, 3): 1, (None, None): 1, (7, 7): 2})
    assert J.ngram_join(docs.limit(0)).collect() == []


def test_query_against_all_pairs(spark):
    docs = pd.read_parquet(f"{SF_CHECK}/documents.parquet")
    got = sorted(tuple(r) for r in op8_ngram_join(spark, SF_CHECK).collect())
    assert got == sorted(plain_components(list(zip(docs.doc_id, docs.text))))


def plain_components_of(rows, size, percent):
    """As ``plain_components`` for shingles of any size and any threshold."""
    sets, parent = [], {i: i for i, _ in rows}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append((i, {tuple(w)} if 0 < len(w) < size else set(zip(*(w[k:] for k in range(size))))))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[n + 1 :]:
            if a & b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), find(i)) for i, s in sets]


OTHERS = [(5, 80), (3, 60), (1, 100)]


@pytest.mark.parametrize("percent", [80, 60, 50, 100])
def test_bounds_at_other_thresholds(percent):
    starts, most = J.band_starts(percent), 0
    for n in [*range(1, 3000), 10**6]:
        band = np.searchsorted(starts, n, "right") - 1
        assert 100 * n // percent < starts[band + 2]
    highs = {2 * int(x) - 2: k for k, x in enumerate(starts[1:])}
    for t in range(2, 5000):
        most = max(most, J.hamming(t, percent))
        assert most <= J.hamming(t, percent) + 1
        if t in highs:  # the segments of a band allow for its largest difference
            m, wide, e = J.plan(highs[t], percent)
            assert m + wide >= most + 1 + e


@pytest.mark.parametrize("seed", range(4))
def test_linked_sets_share_a_key_at_80_percent(seed):
    rng = np.random.default_rng(seed)
    hot = np.zeros(0, np.uint64)
    for _ in range(400):
        n = int(rng.integers(1, 15)) if rng.random() < 0.5 else int(rng.integers(15, 400))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        drop, add = int(rng.integers(0, n // 5 + 1)), int(rng.integers(0, n // 4 + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64)]))
        if J.linked(len(np.intersect1d(a, b)), len(a), len(b), 80):
            (ka, sa), (kb, sb) = J.signatures(a, hot, 80), J.signatures(b, hot, 80)
            both = np.intersect1d(ka, kb)
            assert any((both & 1 == bit).sum() > max(sa[bit], sb[bit]) for bit in (0, 1))


@pytest.mark.parametrize("few", [J.FEW, 0])
@pytest.mark.parametrize("words, percent", OTHERS)
def test_other_shingles_and_thresholds_against_all_pairs(spark, words, percent, few, monkeypatch):
    monkeypatch.setattr(J, "FEW", few)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(tuple(r) for r in J.ngram_join(docs, words=words, percent=percent).collect())
    assert got == sorted(plain_components_of(rows, words, percent))


def family_tree(seed, words, families, members, apart, own):
    """Families of near copies around one text: members of a family differ by
    few words, families by so many that they only meet through the text."""
    rng = np.random.default_rng(seed)
    base = [f"b{i}" for i in range(words)]
    texts = [" ".join(base)]

    def changed(w, n):
        w = list(w)
        for at in rng.choice(len(w), n, replace=False):
            w[at] = f"n{rng.integers(0, 10**9)}"
        return w

    for _ in range(families):
        head = changed(base, int(rng.integers(1, apart + 1)))
        head = head[: int(len(head) * rng.uniform(0.85, 1))] + [f"t{rng.integers(0, 10**9)}" for _ in range(int(rng.integers(0, words // 8)))]
        texts += [" ".join(changed(head, int(rng.integers(0, own + 1)))) for _ in range(members)]
    return texts


@pytest.mark.parametrize("size, percent, seed", [(4, 85, 1), (4, 85, 2), (5, 80, 3), (5, 80, 4), (2, 70, 5), (3, 50, 6)])
def test_families_that_meet_in_one_text(spark, size, percent, seed, monkeypatch):
    monkeypatch.setattr(J, "FEW", 2)
    rng = np.random.default_rng(seed)
    texts = family_tree(seed, 120, 14, 9, 9, 3) + family_tree(seed + 50, 40, 8, 8, 4, 2) + family_tree(seed + 90, 300, 5, 12, 20, 6)
    rows = [(int(i), texts[k]) for k, i in enumerate(rng.permutation(len(texts)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(tuple(r) for r in J.ngram_join(docs, words=size, percent=percent).collect())
    assert got == sorted(plain_components_of(rows, size, percent))


@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80)])
def test_pairs_grow_with_the_group_not_its_square(spark, size, percent):
    """Near copies of a text with eight own changes each: none links to another."""
    rng, base, per_row = np.random.default_rng(9), [f"b{i}" for i in range(300)], []
    for n in (500, 1000, 2000):
        rows = []
        for i in range(n):
            w = list(base)
            for at in rng.choice(300, 8, replace=False):
                w[at] = f"n{i}-{at}"
            rows.append((i, " ".join(w)))
        report = {}
        out = J.ngram_join(spark.createDataFrame([(n, " ".join(base)), *rows], "doc_id long, text string").repartition(4), words=size, percent=percent, report=report)
        assert out.where("component_id = doc_id").count() > 0.9 * n
        per_row.append(((report["star"]) / n, report["rest"] / n))
    assert all(star < 80 and rest < 10 for star, rest in per_row), per_row
    assert per_row[2][1] < 2 * per_row[0][1] + 2, per_row
