"""Operator 9: document quality from a linear-chain conditional random field.

Every line of a text is labelled good or bad. A line's features are its own
(symbols, repeated words, word length, ...) and those of the lines before and
after it; transition weights tie neighbouring labels. Training lines take the
label of their document; the log likelihood of whole label sequences is
maximised by stochastic gradient descent in numpy on at most ``SAMPLE``
documents, half of them good and half bad as far as there are enough. A
document's quality is the mean of its lines' forward-backward marginals,
weighted by line length (characters), rescaled by a logistic fit on a fifth of
the sample that was set aside.

Scoring is a map over all documents. Lines are read one at a time; messages
run over whole texts, ``LINES`` lines of several documents at once.

Defined results: a null or empty text is one empty line, and is scored as
such; lines without a word count with length one; rows without id, and rows
whose labels are null or contradict each other, are not learned from; without
labels of both kinds every score is ``PRIOR``; repeated rows get equal scores;
an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatweave.llm.common import remainder, stored

SAMPLE, EPOCHS, BATCH, RATE, SHRINK = 4000, 30, 64, 0.3, 1e-4
SAMPLE_BYTES = 64 << 20  #: of text that the sample has at most
LINES, PRIOR, SEED = 4096, 0.5, 9
MODULUS, HELD_OUT = 4, 2
SYMBOLS = re.compile(r"[#*$%&|<>{}\[\]\\^~_=+@]")
SHARES = (0.02, 0.1, 0.3, 0.8)


def line_features(line: str, earlier: set[int]) -> list[float]:
    """Features of one line; ``earlier`` has the hashes of the lines before."""
    words = line.split()
    n = len(words)
    if not n:
        return [1.0] + [0.0] * (WIDTH - 1)
    chars, distinct = len(line), len(set(words))
    symbols = len(SYMBOLS.findall(line)) / n
    repeated = 1 - distinct / n
    upper = sum(map(str.isupper, words)) / n
    digits = sum(map(str.isdigit, words)) / n
    length = sum(map(len, words)) / n
    h = hash(line)
    seen = float(h in earlier)
    earlier.add(h)
    bins = [float(x > s) for x in (symbols, repeated) for s in SHARES]
    sizes = [float(n >= k) for k in (2, 4, 8, 16, 32, 64, 128)]
    return [
        0.0, 1.0, math.log1p(n) / 4, min(symbols, 4.0), repeated, upper, digits, min(length, 40.0) / 10, float(length > 9), float(length > 14),
        seen, line.count("!") / n, line.count("?") / n, float(line.rstrip()[-1:] in ".!?\"”»"), min(chars, 2000) / 1000, float("http" in line or "@" in line), *bins, *sizes,
    ]


WIDTH = 16 + 2 * len(SHARES) + 7
FEATURES = 3 * WIDTH + 2


def text_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features with both neighbours' (lines x FEATURES), and line lengths.
    The last two mark the first and the last line."""
    earlier: set[int] = set()
    lines = [x for x in (text or "").split("\n") if x and not x.isspace()] or [""]
    own = np.array([line_features(x, earlier) for x in lines], dtype=np.float32)
    out = np.zeros((len(lines), FEATURES), dtype=np.float32)
    out[:, :WIDTH] = own
    out[1:, WIDTH : 2 * WIDTH] = own[:-1]
    out[:-1, 2 * WIDTH : 3 * WIDTH] = own[1:]
    out[0, -2] = out[-1, -1] = 1.0
    return out, np.array([max(1, len(x)) for x in lines], dtype=np.float64)


def chains(score: np.ndarray, lengths: np.ndarray, trans: np.ndarray):
    """Forward-backward over several documents. score: log-odds of good per
    line, all documents one after the other. Returns the marginals of good,
    the log partition per document and the expected transitions (2 x 2)."""
    order = np.argsort(-lengths, kind="stable")
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])[order]
    size = lengths[order]
    emit = np.stack([np.zeros_like(score), score], axis=1)
    fwd, bwd = np.empty_like(emit), np.zeros_like(emit)
    steps = int(size[0])
    active = np.searchsorted(-size, -np.arange(1, steps + 1), side="right")  # documents with a line t
    fwd[start] = emit[start]
    for t in range(1, steps):
        now = start[: active[t]] + t
        a = fwd[now - 1]
        fwd[now] = emit[now] + np.logaddexp(a[:, :1] + trans[0], a[:, 1:] + trans[1])
    for t in range(steps - 1, 0, -1):
        now = start[: active[t]] + t
        b = emit[now] + bwd[now]
        bwd[now - 1] = np.logaddexp(trans[:, 0] + b[:, :1], trans[:, 1] + b[:, 1:])
    last = start + size - 1
    z = np.logaddexp(fwd[last, 0], fwd[last, 1])
    doc = np.repeat(np.arange(len(lengths)), lengths)
    zs = np.empty(len(lengths))
    zs[order] = z
    both = fwd + bwd - zs[doc][:, None]
    marginal = np.exp(both[:, 1] - np.logaddexp(both[:, 0], both[:, 1]))
    follow = np.flatnonzero(doc[1:] == doc[:-1])
    pair = fwd[follow][:, :, None] + trans[None] + (emit + bwd)[follow + 1][:, None, :] - zs[doc[follow]][:, None, None]
    return marginal, zs, np.exp(pair).sum(axis=0)


@dataclass
class Model:
    weights: np.ndarray | None
    trans: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)

    def raw(self, texts) -> Iterator[float]:
        """Length-weighted mean marginals."""
        held, count = [], 0

        def flush():
            sizes = np.array([len(h[0]) for h in held])
            marginal, _, _ = chains(np.concatenate([h[0] for h in held]), sizes, self.trans)
            weight = np.concatenate([h[1] for h in held])
            at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            yield from (np.add.reduceat(marginal * weight, at) / np.add.reduceat(weight, at)).tolist()

        for text in texts:
            x, lengths = text_features(text)
            held.append(((x @ self.weights).astype(np.float64), lengths))
            count += len(x)
            if count >= LINES:
                yield from flush()
                held, count = [], 0
        if held:
            yield from flush()

    def score(self, texts) -> Iterator[float]:
        if self.weights is None:
            yield from (PRIOR for _ in texts)
            return
        a, b = self.scale
        for p in self.raw(texts):
            yield 1 / (1 + math.exp(-max(-40.0, min(40.0, a * _logit(p) + b))))


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def train(rows: list[tuple[int, str]]) -> Model:
    """rows: (label, text) in a fixed order."""
    if len({r[0] for r in rows}) < 2:
        return Model(None, np.zeros((2, 2)))
    rng = np.random.default_rng(SEED)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    cut = max(1, len(rows) // 5)
    fit, aside = rows[cut:], rows[:cut]
    docs = [text_features(t)[0] for _, t in fit]
    y = np.array([r[0] for r in fit])
    w, trans, step_w, step_t = np.zeros(FEATURES), np.zeros((2, 2)), np.full(FEATURES, 1e-8), np.full((2, 2), 1e-8)
    for _ in range(EPOCHS):
        order = rng.permutation(len(fit))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            x = np.concatenate([docs[i] for i in part])
            sizes = np.array([len(docs[i]) for i in part])
            marginal, _, pairs = chains((x @ w).astype(np.float64), sizes, trans)
            share = np.repeat(1 / sizes, sizes)  # each document weighs the same
            gold = np.repeat(y[part], sizes)
            grad = x.T @ ((gold - marginal) * share) / len(part) - SHRINK * w
            seen = np.zeros((2, 2))
            for label in (0, 1):
                seen[label, label] = (sizes[y[part] == label] - 1).sum()
            grad_t = (seen - pairs) / max(1, sizes.sum()) - SHRINK * trans
            step_w += grad**2
            step_t += grad_t**2
            w += RATE * grad / np.sqrt(step_w)
            trans += RATE * grad_t / np.sqrt(step_t)
    model = Model(w.astype(np.float32), trans)
    z = np.array([_logit(p) for p in model.raw(t for _, t in aside)])
    t = np.array([r[0] for r in aside], dtype=float)
    a, b = 1.0, 0.0
    for _ in range(500):  # logistic fit, kept increasing
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        a = max(0.05, a - 0.05 * float(((p - t) * z).mean()))
        b -= 0.2 * float((p - t).mean())
    model.scale = (a, b)
    return model


def sample_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> list[tuple[int, str]]:
    """At most ``sample`` labelled texts of together at most ``most_bytes``; ids
    are picked from the labels alone, so the documents are read with a bounded
    broadcast of ids. One row stands for an id that several rows bear."""
    marks = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (remainder("doc_id", MODULUS) != HELD_OUT))
        .groupBy("doc_id").agg(F.min("quality").alias("_y"), F.max("quality").alias("_most")).where("_y = _most")
        .select("doc_id", "_y", F.xxhash64(F.lit(SEED), "doc_id").alias("_h"))
    )
    marks = stored(marks, "marks")
    picked = [marks.where(f"_y = {y}").orderBy("_h", "doc_id").limit(sample // 2) for y in (0, 1)]
    chosen = stored(picked[0].unionByName(picked[1]), "chosen")
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("_t", F.xxhash64("text"))
    one = found.groupBy("doc_id").agg(F.min("_t").alias("_t"))
    rows = found.join(one, ["doc_id", "_t"]).dropDuplicates(["doc_id"]).select("_h", "doc_id", "_y", "text")
    rows = stored(rows.withColumn("_size", F.coalesce(F.octet_length("text"), F.lit(0))), "sample")
    kept, total = [], 0
    for r in sorted(rows.select("_h", "doc_id", "_size").collect()):  # a row per sampled id
        if total + r["_size"] <= most_bytes:
            kept.append(r["doc_id"])
            total += r["_size"]
    held = rows.join(F.broadcast(rows.sparkSession.createDataFrame([(i,) for i in kept], "doc_id long")), "doc_id")
    got = sorted(held.collect(), key=lambda r: (r["_h"], r["doc_id"]))
    return [(int(r["_y"]), r["text"]) for r in got]


def fit_model(docs: DataFrame, labels: DataFrame) -> Model:
    return train(sample_rows(docs, labels))


def score_documents(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of every document, with score."""
    rows = docs.select(F.struct(*keep).alias("_keep"), F.col(text).alias("_text"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    fields = rows.select("_keep").schema

    def run(batches):
        for batch in batches:
            scores = list(held.value.score(x.as_py() for x in batch["_text"]))
            yield pa.RecordBatch.from_arrays([batch["_keep"], pa.array(scores, pa.float64())], names=["_keep", "score"])

    return rows.mapInArrow(run, fields.add("score", "double")).select("_keep.*", "score")
