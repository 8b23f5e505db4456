"""Operator 3: language identification by averaged hashed subword embeddings.

A text is lower-cased, everything but letters becomes a word boundary, and the
1- to 4-character windows of the boundary-marked words are hashed into
``BUCKETS``. The text's vector is the average of its windows' embeddings; a
linear softmax gives the language. Embeddings and softmax are trained together
by stochastic gradient descent in numpy, on at most ``SAMPLE`` documents
(a hash sample, split evenly between languages; every fifth of them is set
aside for calibration). Calibration fits the softmax's temperature on these,
then takes the rejection threshold as the score below which at most
``REJECT`` of the correctly recognised calibration documents fall, but never
above ``MOST``: a calibrated score beyond one half is likelier right than wrong.

Prediction is a map over all documents: since embeddings and softmax are
linear, one bucket x language table gives a text's logits as an average of
rows. Texts are read in slices of ``SLICE`` characters that overlap by the
window length, so memory is bounded for any text and no part is skipped.

Defined results: a text that is null, empty or has no letter is ``und`` with
score 0 and not accepted; without any learnable row all texts are ``und``;
null ids are never learned from and never held out; repeated rows get equal
predictions; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chatweave.llm.common import join_small, remainder, stored

BUCKETS, DIM, ORDERS = 1 << 14, 16, (1, 2, 3, 4)
SAMPLE, EPOCHS, STEPS, BATCH, RATE = 4000, 8, 800, 32, 8.0
REJECT, MOST, SLICE, SEED = 0.002, 0.5, 1 << 18, 7
MODULUS, HELD_OUT = 3, 1
_STEP = np.uint32(2654435761)


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Code point -> its lower-case letter, or 0 where it is no letter."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for c in range(len(out)):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def window_buckets(text: str) -> Iterator[np.ndarray]:
    """Buckets of all windows of a text, slice by slice. A window holds at
    least one letter and at most one boundary at either end."""
    table, reach = letter_table(), max(ORDERS) - 1
    for at in range(0, len(text), SLICE):
        own = min(SLICE, len(text) - at)  # windows that start here belong to this slice
        part = text[at : at + own + reach]
        c = table[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        if at == 0:
            c, own = np.concatenate([np.zeros(1, np.uint32), c]), own + 1
        if at + own >= len(text):
            c = np.concatenate([c, np.zeros(1, np.uint32)])
        letter, h = c > 0, np.zeros(len(c), dtype=np.uint32)
        inner = np.ones(len(c), dtype=bool)  # no boundary strictly inside the window
        for n in range(1, max(ORDERS) + 1):
            k = len(c) - n + 1
            if k <= 0:
                break
            h = (h[:k] ^ c[n - 1 :]) * _STEP
            h ^= h >> np.uint32(15)
            if n > 2:
                inner = inner[:k] & letter[n - 2 : n - 2 + k]
            else:
                inner = inner[:k]
            if n in ORDERS:
                good = inner & (letter[:k] if n < 2 else letter[:k] | letter[n - 1 :] if n == 2 else True)
                yield (((h[:own][good[:own]]) + np.uint32(n * 40503)) * _STEP >> np.uint32(18)).astype(np.int32) & (BUCKETS - 1)


def bucket_counts(text: str | None) -> np.ndarray:
    out = np.zeros(BUCKETS, dtype=np.int64)
    for b in window_buckets(text or ""):
        out += np.bincount(b, minlength=BUCKETS)
    return out


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  #: bucket x language, calibrated
    threshold: float

    def logits(self, text: str) -> np.ndarray | None:
        total, n = np.zeros(len(self.languages)), 0
        for b in window_buckets(text):
            total += self.table[b].sum(axis=0, dtype=np.float64)
            n += len(b)
        return total / n if n else None

    def predict(self, text: str | None) -> tuple[str, float]:
        z = self.logits(text) if text and self.languages else None
        if z is None:
            return "und", 0.0
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def train(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """rows: (language, buckets, counts or shares) of whole texts, in a fixed
    order."""
    rows = [r for r in rows if len(r[1])]
    languages = sorted({r[0] for r in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), 0.0)
    of = {x: i for i, x in enumerate(languages)}
    aside = [i % 5 == 4 for i in range(len(rows))]
    fit, held = [r for r, a in zip(rows, aside) if not a], [r for r, a in zip(rows, aside) if a]
    rng = np.random.default_rng(SEED)
    e, w = rng.normal(0, 0.1, (BUCKETS, DIM)), np.zeros((DIM, len(languages)))
    epochs = max(EPOCHS, -(-STEPS * BATCH // len(fit)))  # small samples are walked through more often
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(fit))
        for at in range(0, len(order), BATCH):
            batch = [fit[i] for i in order[at : at + BATCH]]
            ids = np.concatenate([r[1] for r in batch])
            part = np.concatenate([r[2] / r[2].sum() for r in batch])
            starts = np.cumsum([0, *[len(r[1]) for r in batch[:-1]]])
            x = np.add.reduceat(e[ids] * part[:, None], starts)
            z = x @ w
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), [of[r[0]] for r in batch]] -= 1
            p /= len(batch)
            back = p @ w.T
            w -= rate * (x.T @ p)
            np.subtract.at(e, ids, rate * part[:, None] * np.repeat(back, [len(r[1]) for r in batch], axis=0))
    raw = (e @ w).astype(np.float64)
    held = held or fit
    z = np.stack([(raw[b] * (n / n.sum())[:, None]).sum(axis=0) for _, b, n in held])
    y = np.array([of[r[0]] for r in held])

    def loss(t: float) -> float:
        s = z * t
        m = s.max(axis=1)
        return float((m + np.log(np.exp(s - m[:, None]).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    temper = min(np.geomspace(0.05, 5, 60), key=loss)
    s = z * temper
    p = np.exp(s - s.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y])
    threshold = min(MOST, float(right[int(REJECT * len(right))])) if len(right) else 0.0
    return Model(languages, (raw * temper).astype(np.float32), threshold)


def sample_rows(docs: DataFrame) -> DataFrame:
    """At most ``SAMPLE`` learnable documents as (lang, key, buckets, shares):
    per language the rows with the smallest hashes, cut by language counts so
    that no language passes one task whole."""
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("doc_id", MODULUS) != HELD_OUT))
    key = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    sizes = stored(rows.groupBy("lang").agg(F.count("*").alias("_n")), "languages")
    quota = max(2, SAMPLE // max(1, sizes.count()))
    near = join_small(rows.select("doc_id", "lang", "text", key.alias("_key")), sizes, ["lang"], "inner")
    near = near.where(F.col("_key") < 1.5 * quota / F.col("_n") + 30.0 / F.col("_n"))

    def count(batches):
        for batch in batches:
            out = {"lang": [], "key": [], "doc_id": [], "buckets": [], "counts": []}
            for lang, k, d, text in zip(*(batch[c].to_pylist() for c in ("lang", "_key", "doc_id", "text"))):
                n = bucket_counts(text)
                b = np.flatnonzero(n)
                for c, v in zip(out, (lang, k, d, b.astype("<i4").tobytes(), (n[b] / max(1, n.sum())).astype("<f4").tobytes())):
                    out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("lang", pa.string()), ("key", pa.float64()), ("doc_id", pa.int64()), ("buckets", pa.binary()), ("counts", pa.binary())]))

    counted = near.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(count, "lang string, key double, doc_id long, buckets binary, counts binary")
    nth = F.row_number().over(W.partitionBy("lang").orderBy("key", "doc_id", "buckets", "counts"))
    return counted.withColumn("_nth", nth).where(F.col("_nth") <= quota).drop("_nth")


def fit_model(docs: DataFrame) -> Model:
    """Learns from rows of ``docs`` (doc_id, text, lang) that are not held out."""
    got = sample_rows(docs).collect()  # at most SAMPLE rows of at most BUCKETS entries
    got.sort(key=lambda r: (r["key"], r["doc_id"], r["lang"], r["buckets"]))
    return train([(r["lang"], np.frombuffer(r["buckets"], "<i4"), np.frombuffer(r["counts"], "<f4")) for r in got])


def identify(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` with lang_pred, score and accepted."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by BUCKETS x languages
    if any(c in keep for c in ("lang_pred", "score", "accepted")):
        raise ValueError("keep must not hold lang_pred, score or accepted")
    source = docs.select(*keep, F.col(text).alias("_text"))
    fields = source.select(*keep).schema

    def run(batches):
        m = held.value
        for batch in batches:
            got = [m.predict(t) for t in (x.as_py() for x in batch["_text"])]
            cols = [batch[c] for c in keep]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[0] != "und" and g[1] >= m.threshold for g in got], pa.bool_())],
                names=[*keep, "lang_pred", "score", "accepted"],
            )

    return source.mapInArrow(run, fields.add("lang_pred", "string").add("score", "double").add("accepted", "boolean"))


def language_id(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Fits on ``docs`` and predicts all of it."""
    return identify(docs, fit_model(docs.select("doc_id", "text", "lang")), keep or ["doc_id"])
