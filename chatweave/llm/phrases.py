"""Operator 12: phrase collocations by Misra-Gries summaries and exact counts.

Words and pieces are cut as the contract says; everything is per language.

Texts are stored in batches of some megabytes. First pass: runs of 1 to
``LONGEST`` words of a piece are hashed to 64 bits (by rolling sums over a buffer
of texts; no Python per word), and counted per batch. Each hash partition (the
top bits of the hash) gets one packed list of (next 32 bits, count) per batch,
after its mass. A partition knows its whole mass before the first list comes and
feeds the lists to a Misra-Gries summary of more than mass / threshold counters:
merge, subtract the first count beyond the capacity from all, drop what is not
above zero. All that is subtracted from one counter is less than the threshold, so
each run that occurs ``threshold`` times survives; a survivor whose count and
what was subtracted stay below the threshold is left out. The number of
partitions grows with the bytes of text, so a partition does not.

Second pass. A partition answers each batch with those of its hashes that
survived, and the batch meets its texts again: nothing is broadcast, and what a
task holds is a batch, however large the corpus and its frequent runs are. Runs
with such a hash are told apart by a second 64-bit hash, spelled out, and their
strings counted exactly: per batch, then per hash partition. Scores then are
joins of the counted strings by language and part.

A run that is frequent has frequent parts, so all counts that scores need are
there. If a phrase lies in a longer candidate that is as frequent, then also in
one that is longer by one word, so only those are compared.

Texts longer than a buffer are cut between words, with the next words as
context, so memory is bounded by the longest word.

Defined results: a null or empty text has no words; a null language is ``und``;
equal rows count each; an empty table gives an empty table; other columns are
left alone.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chatweave.llm.common import join_small, stored

THRESHOLD, LONGEST, TOP = 100, 5, 2000
BUFFER = 4 << 20  #: bytes of text whose words are cut at once
BATCH = 16 << 20  #: bytes of text per batch
PART_BYTES = 64 << 20  #: bytes of text per hash partition, at most

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: 1: between words of a piece, 2: between pieces
CLASS = np.zeros(256, dtype=np.uint8)
CLASS[list(b" \t")], CLASS[list(b".,;:!?\n\v\f\r")] = 1, 2
BREAK = re.compile(rb"[ \t.,;:!?\n-\r]")
MASK = (1 << 64) - 1
#: odd multipliers of the two rolling hashes
ROLLS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_STEP, _MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BLOCK = 1 << 19


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(30))


@lru_cache(maxsize=4)
def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for places in a block."""
    both = []
    for b in (base, pow(base, -1, 1 << 64)):
        x = np.full(BLOCK, b, dtype=np.uint64)
        x[0] = 1
        both.append(np.multiply.accumulate(x))
    return both[0], both[1]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A hash of each word data[start:end], from running sums of
    (byte + 1) * base**place."""
    up, down = _powers(base)
    at_start, at_end, back = (np.empty(len(starts), dtype=np.uint64) for _ in range(3))
    carry = np.uint64(0)
    for low in range(0, len(data) + 1, BLOCK):
        part = data[low : low + BLOCK]
        scale, unscale = np.uint64(pow(base, low, 1 << 64)), np.uint64(pow(base, -low, 1 << 64))
        sums = np.empty(len(part) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum((part + np.uint64(1)) * up[: len(part)], out=sums[1:])
        sums = sums * scale + carry
        i, j = np.searchsorted(starts, (low, low + BLOCK))
        at_start[i:j], back[i:j] = sums[starts[i:j] - low], down[starts[i:j] - low] * unscale
        i, j = np.searchsorted(ends, (low, low + BLOCK))
        at_end[i:j] = sums[ends[i:j] - low]
        carry = sums[-1]
    return _mix((at_end - at_start) * back + (ends - starts).astype(np.uint64) * _STEP)


class Words:
    """Words of a buffer: where they are, their pieces, and hashes of runs."""

    def __init__(self, data: bytes, limit: int):
        self.raw, self.data = data, np.frombuffer(data, dtype=np.uint8)
        kind = CLASS[self.data]
        inside = np.zeros(len(kind) + 2, dtype=np.int8)
        inside[1:-1] = kind == 0
        edges = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        cuts = np.flatnonzero(kind == 2)
        self.piece = np.searchsorted(cuts, self.starts)
        self.n = int(np.searchsorted(self.starts, limit))  # the rest is context

    def runs(self, salt: int, base: int, longest: int = LONGEST):
        """Per length: the hash of the run at each word, and whether it is one."""
        w = word_hashes(self.data, self.starts, self.ends, base)
        g = _mix(w ^ np.uint64(salt))
        for k in range(1, longest + 1):
            if k > 1:
                g = _mix(g[:-1] * _STEP + w[k - 1 :] + np.uint64(k))
            m = min(self.n, len(g))
            whole = self.piece[:m] == self.piece[k - 1 : k - 1 + m]
            yield k, g[:m], whole

    def spell(self, i: int, k: int) -> str:
        return b" ".join(self.raw[s:e] for s, e in zip(self.starts[i : i + k], self.ends[i : i + k])).decode("utf-8")


def cut(text: bytes, size: int = BUFFER, longest: int = LONGEST):
    """(part, limit) of a text: words that start before ``limit`` are the
    part's own, up to ``longest - 1`` words after it are context."""
    at, after = 0, re.compile(rb"(?:[ \t]+[^ \t.,;:!?\n-\r]+){0,%d}" % (longest - 1))
    while len(text) - at > size:
        found = BREAK.search(text, at + size)
        if not found:
            break
        end = found.start()
        yield text[at : after.match(text, end).end()], end - at
        at = end
    yield text[at:], len(text) - at


def buffers(batches, size: int = BUFFER):
    """(lang, Words) of all texts of (_lang, _text), short ones together."""
    held: dict[str, list[bytes]] = {}
    total = 0

    def drain():
        for lang, texts in held.items():
            joined = b"\n".join(texts)
            yield lang, Words(joined, len(joined))
        held.clear()

    for batch in batches:
        for lang, text in zip(batch["_lang"].to_pylist(), batch["_text"]):
            raw = bytes(text.as_buffer() or b"").translate(LOWER)
            if len(raw) > size:
                for part, limit in cut(raw, size):
                    yield lang, Words(part, limit)
                continue
            if total + len(raw) > size:
                yield from drain()
                total = 0
            held.setdefault(lang, []).append(raw)
            total += len(raw) + 1
    yield from drain()


def salt_of(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode("utf-8"))


def counted(x: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often (with what weight) they occur."""
    if weights is None:
        x = np.sort(x)
    else:
        order = np.argsort(x, kind="stable")
        x, weights = x[order], weights[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(x)), dtype=bool), x[1:] != x[:-1]]))
    if weights is None:
        return x[first], np.diff(np.append(first, len(x)))
    return x[first], (np.add.reduceat(weights, first) if len(first) else weights)


def packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted 32-bit keys as steps, and counts, byte plane by byte plane (a
    plane of zeros compresses to nothing)."""
    both = np.stack([np.diff(keys, prepend=np.uint32(0)), np.minimum(counts, (1 << 32) - 1).astype("<u4")]).astype("<u4")
    return both.view(np.uint8).reshape(2, len(keys), 4).transpose(0, 2, 1).tobytes()


def unpacked(blob) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(blob, dtype=np.uint8).reshape(2, 4, -1)
    both = np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u4")[:, :, 0]
    return np.cumsum(both[0], dtype=np.uint32), both[1].astype(np.int64)


class Summary:
    """A Misra-Gries summary of at most ``capacity`` counters. ``error`` is what
    may have been subtracted from one; merging two adds their errors."""

    def __init__(self, capacity: int):
        self.capacity, self.error = capacity, 0
        self.keys, self.counts = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.held += len(keys)
        if self.held > max(self.capacity, 1 << 18):
            self.settle()

    def merge(self, other: "Summary") -> None:
        other.settle()
        self.error += other.error
        self.add(other.keys, other.counts)

    def settle(self) -> None:
        lists = [(self.keys, self.counts), *self.waiting]
        self.waiting, self.held = [], 0
        keys, counts = counted(np.concatenate([k for k, _ in lists]), np.concatenate([c for _, c in lists]))
        if len(keys) > self.capacity:
            beyond = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            self.error += beyond
            counts = counts - beyond
            keys, counts = keys[counts > 0], counts[counts > 0]
        self.keys, self.counts = keys, counts

    def frequent(self, threshold: int) -> np.ndarray:
        self.settle()
        return self.keys[self.counts + self.error >= threshold]


def batched(docs: DataFrame, text: str, lang: str, size: int) -> DataFrame:
    """(batch, _lang, _text) of all texts, stored: rows of a batch follow one
    another, and hold about ``size`` bytes of text or one text."""

    def run(batches):
        task, seq, held = TaskContext.get().partitionId() << 40, 0, 0
        for batch in batches:
            numbers = []
            for n in pc.binary_length(batch["_text"]).to_pylist():
                if held and held + n > size:
                    seq, held = seq + 1, 0
                held += n
                numbers.append(task + seq)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), batch["_lang"], batch["_text"]], names=["batch", "_lang", "_text"])

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("_lang"), F.col(text).alias("_text")).where("_text <> ''")
    return stored(rows.mapInArrow(run, "batch long, _lang string, _text string"), "texts")


def hash_lists(texts: DataFrame, bits: int, longest: int) -> DataFrame:
    """(part, kind, mass, batch, list): per hash partition the mass (kind 0) and
    the packed counts (kind 1) of each batch's runs."""

    def run(batches):
        def flush(number, held):
            hashes = [g[whole] for lang, words in buffers(held) for _, g, whole in words.runs(salt_of(lang), ROLLS[0], longest)]
            keys, counts = counted(np.concatenate(hashes)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            if not len(keys):
                return
            part = (keys >> np.uint64(64 - bits)).astype(np.int64)
            low = ((keys << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
            first = np.flatnonzero(np.diff(part, prepend=-1))
            last = np.append(first[1:], len(part))
            names = ["part", "kind", "mass", "batch", "list"]
            n, parts, mass = len(first), pa.array(part[first]), pa.array(np.add.reduceat(counts, first))
            yield pa.RecordBatch.from_arrays([parts, pa.array([0] * n, pa.int32()), mass, pa.array([number] * n, pa.int64()), pa.nulls(n, pa.binary())], names=names)
            for at in range(0, n, 256):
                # a partition's 32 bits may hold two runs: one counter for both
                lists = [packed(*counted(low[i:j], counts[i:j])) for i, j in zip(first[at : at + 256], last[at : at + 256])]
                m = len(lists)
                yield pa.RecordBatch.from_arrays([parts.slice(at, m), pa.array([1] * m, pa.int32()), pa.array([0] * m, pa.int64()), pa.array([number] * m, pa.int64()), pa.array(lists, pa.binary())], names=names)

        now, held = None, []
        for batch in batches:
            numbers = batch["batch"].to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for i, j in zip(edges, edges[1:]):
                if j > i:
                    if held and numbers[i] != now:
                        yield from flush(now, held)
                        held = []
                    now = int(numbers[i])
                    held.append(batch.slice(i, j - i))
        if held:
            yield from flush(now, held)

    return texts.mapInArrow(run, "part long, kind int, mass long, batch long, list binary")


def survivors(lists: DataFrame, threshold: int, bits: int) -> DataFrame:
    """(batch, keys): per batch and hash partition, those of the batch's hashes
    (their first ``bits`` + 32 bits) that may occur ``threshold`` times."""

    def run(batches):
        def answers(part, mass, held):
            summary = Summary(mass // threshold + 1)
            for _, blob in held:
                summary.add(*unpacked(blob))
            keys = summary.frequent(threshold)
            if not len(keys):
                return
            numbers, found = [], []
            for number, blob in held:
                own = unpacked(blob)[0]
                own = own[keys[np.minimum(np.searchsorted(keys, own), len(keys) - 1)] == own]
                if len(own):
                    numbers.append(number)
                    found.append((own.astype("<u8") | np.uint64(part << 32)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(found, pa.binary())], names=["batch", "keys"])

        now, mass, held = None, 0, []
        for batch in batches:
            for part, kind, weight, number, blob in zip(*(batch[c].to_pylist() for c in ("part", "kind", "mass", "batch")), batch["list"]):
                if part != now:
                    if held:
                        yield from answers(now, mass, held)
                    now, mass, held = part, 0, []
                if kind == 0:
                    mass += weight
                else:
                    held.append((number, blob.as_py()))
        if held:
            yield from answers(now, mass, held)

    return lists.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(run, "batch long, keys binary")


class Known:
    """Membership of the hashes among a batch's survivors: a table of 2**22
    places leaves most others out before the exact search."""

    def __init__(self, keys: np.ndarray, bits: int):
        self.keys, self.shift = keys, np.uint64(32 - bits)
        self.table = np.zeros(1 << 22, dtype=bool)
        self.table[keys & np.uint64((1 << 22) - 1)] = True

    def __call__(self, g: np.ndarray) -> np.ndarray:
        """Places of the hashes that are known."""
        if not len(self.keys):
            return np.zeros(0, dtype=np.int64)
        x = g >> self.shift
        maybe = np.flatnonzero(self.table[x & np.uint64((1 << 22) - 1)])
        x = x[maybe]
        at = np.minimum(np.searchsorted(self.keys, x), len(self.keys) - 1)
        return maybe[self.keys[at] == x]


def spelled_counts(texts: DataFrame, found: DataFrame, bits: int, longest: int) -> DataFrame:
    """(part, lang, phrases, counts): per batch, hash partition and language the
    surviving runs, in order and parted by newlines, and how often each occurs
    (32-bit numbers). Without phrases, counts is the number of words."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k.as_buffer(), "<u8") for k in right["keys"]]
        known = Known(np.sort(np.concatenate(keys)) if keys else np.zeros(0, dtype=np.uint64), bits)
        words_of, total, part_of = {}, {}, {}
        for lang, words in buffers(left.to_batches()):
            words_of[lang] = words_of.get(lang, 0) + words.n
            counts, parts, salt = total.setdefault(lang, {}), part_of.setdefault(lang, {}), salt_of(lang)
            for (k, g, whole), (_, h, _) in zip(words.runs(salt, ROLLS[0], longest), words.runs(salt, ROLLS[1], longest)):
                at = np.flatnonzero(whole)
                at = at[known(g[at])]
                order = at[np.lexsort((h[at], g[at]))]
                new = np.ones(len(order), dtype=bool)
                new[1:] = (g[order[1:]] != g[order[:-1]]) | (h[order[1:]] != h[order[:-1]])
                first = np.flatnonzero(new)
                often = np.diff(np.append(first, len(order))).tolist()
                for i, n, part in zip(order[first].tolist(), often, (g[order[first]] >> np.uint64(64 - bits)).tolist()):
                    phrase = words.spell(i, k)
                    counts[phrase] = counts.get(phrase, 0) + n
                    parts[phrase] = part
        rows = [(0, lang, None, np.array([n], dtype="<u8").tobytes()) for lang, n in words_of.items()]
        for lang, counts in total.items():
            parts, held = part_of[lang], {}
            for phrase in sorted(counts):
                held.setdefault(parts[phrase], []).append(phrase)
            rows += [(part, lang, "\n".join(some), np.array([counts[x] for x in some], dtype="<u4").tobytes()) for part, some in held.items()]
        columns = list(zip(*rows)) or [()] * 4
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.binary()))], names=["part", "lang", "phrases", "counts"])

    return texts.groupBy("batch").cogroup(found.groupBy("batch")).applyInArrow(run, "part long, lang string, phrases string, counts binary")


def summed(lists: DataFrame, threshold: int) -> DataFrame:
    """(lang, phrase, f): the sums of all lists that reach the threshold, and
    all words of a language (phrase null)."""

    def run(batches):
        def done(total, words):
            some = [(lang, phrase, n) for lang, of in total.items() for phrase, n in of.items() if n >= threshold] + [(lang, None, n) for lang, n in words.items()]
            return pa.RecordBatch.from_pydict({"lang": [x[0] for x in some], "phrase": [x[1] for x in some], "f": [x[2] for x in some]}, schema=pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())]))

        now, total, words = None, {}, {}
        for batch in batches:
            for part, lang, phrases, counts in zip(batch["part"].to_pylist(), batch["lang"].to_pylist(), batch["phrases"], batch["counts"]):
                if part != now:
                    yield done(total, words)
                    now, total, words = part, {}, {}
                if not phrases.is_valid:
                    words[lang] = words.get(lang, 0) + int(np.frombuffer(counts.as_buffer(), "<u8")[0])
                    continue
                of = total.setdefault(lang, {})
                for phrase, n in zip(phrases.as_py().split("\n"), np.frombuffer(counts.as_buffer(), "<u4").tolist()):
                    of[phrase] = of.get(phrase, 0) + n
        yield done(total, words)

    return lists.repartition("part").sortWithinPartitions("part").mapInArrow(run, "lang string, phrase string, f long")


def frequent_runs(docs: DataFrame, text: str = "text", lang: str = "lang", threshold: int = THRESHOLD, longest: int = LONGEST, batch: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all runs of 1 to ``longest`` words that occur
    ``threshold`` times, and (lang, n) the words of each language."""
    texts = batched(docs, text, lang, batch)
    size = texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    parts = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES)
    bits = min(31, max(1, (parts - 1).bit_length()))
    found = survivors(hash_lists(texts, bits, longest), threshold, bits)
    counts = stored(summed(spelled_counts(texts, found, bits, longest), threshold), "counts")
    runs = counts.where("phrase IS NOT NULL").select("lang", "phrase", F.size(F.split("phrase", " ")).alias("words"), "f")
    return runs, counts.where("phrase IS NULL").select("lang", F.col("f").alias("n"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", threshold: int = THRESHOLD, longest: int = LONGEST, top: int = TOP, batch: int = BATCH) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first
    ``top`` phrases."""
    runs, totals = frequent_runs(docs, text, lang, threshold, longest, batch)
    candidates = runs.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    # a phrase inside a longer candidate that is as frequent goes
    split = F.split("phrase", " ")
    inner = F.array(F.slice(split, 1, F.col("words") - 1), F.slice(split, 2, F.col("words") - 1))
    within = candidates.where("words > 2").select("lang", F.explode(F.transform(inner, lambda x: F.array_join(x, " "))).alias("phrase"), F.col("a").alias("longer"))
    within = within.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = candidates.join(within, ["lang", "phrase"], "left").where("longer IS NULL OR longer < a").drop("longer")
    parts = kept.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    parts = parts.withColumns({"first": F.array_join(F.slice(split, F.lit(1), F.col("cut")), " "), "rest": F.array_join(F.slice(split, F.col("cut") + 1, F.col("words") - F.col("cut")), " ")})
    part = runs.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    rest = runs.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    joined = join_small(parts.join(part, ["lang", "first"]).join(rest, ["lang", "rest"]), totals, ["lang"], "inner")
    wide = joined.withColumns({c: F.col(c).cast("decimal(18,0)") for c in ("l", "r", "n")}).withColumn("wa", F.col("a").cast("decimal(18,0)"))
    scored = wide.withColumn("score", F.expr("(wa * n * 1000) div (l * r)"))
    worst = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("_w"))
    flat = worst.select("lang", "phrase", "a", F.col("_w.l").cast("long").alias("l"), F.col("_w.r").cast("long").alias("r"), F.col("n").cast("long").alias("n"), F.col("_w.score").alias("score"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    out = flat.withColumn("rank", rank).where(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
