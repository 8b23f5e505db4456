"""Operator 4: mixture-controlled packing by deficit round-robin.

Every source is a queue of its documents' token ids (each document ends with
``END``). A sequence (window) of ``WINDOW`` tokens has WINDOW / QUANTUM slots.
Slots are dealt by deficit: the next slot goes to the source with the largest
shortfall, ``(2 k + 1) / weight`` being smallest after k quanta, among sources
that still have a full quantum. Deficits thus carry over from window to window.
By default weights are the sources' token totals, so that every window shows
the corpus mixture and all queues end together; with other weights a source
that runs dry leaves its share to the others. The sources' last, partial
quanta follow one another in the last windows, so only the very last sequence
is short.

The dealing has a closed form: the number of quanta a source has got when
window w begins follows from w alone. So deficits also carry over partitions:
a task that knows where its documents stand in their queues cuts them into
pieces without talking to any other task. Queue positions come from per
(input partition, source) totals, summed over partitions, so no source passes
one task and no document is shuffled. Ids are written once and read twice.

With more than ``MOST_QUEUES`` sources, only small ones share queues, which
bounds the state: every source with a given weight and the largest of the
others (by bytes of text) keep a queue of their own, and the tail is hashed
into ``MOST_QUEUES // 4`` queues. A tail queue weighs what its members weigh
together, and has their documents in input order. A tail source is smaller
than each source with a queue of its own and no given weight. Weights are
never dropped.

Defined results: null and empty texts are one END token; a null source is a
source of its own; repeated rows are packed as often as they occur; an empty
table gives an empty table. No id is dropped, repeated or truncated.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chatweave.llm.common import stored
from chatweave.llm.tokens import NAME, encoder

WINDOW, QUANTUM, END = 2048, 64, 1
MOST_QUEUES = 1024
#: numbers held at once where windows or quanta have a column per queue (8 MB each)
HELD = 1 << 20


class Deal:
    """Where each queue stands when a window begins."""

    def __init__(self, tokens: np.ndarray, weights: np.ndarray, window: int = WINDOW, quantum: int = QUANTUM):
        if window % quantum:
            raise ValueError("window must be a multiple of quantum")
        self.tokens, self.window, self.quantum = np.asarray(tokens, dtype=np.int64), window, quantum
        self.weights = np.maximum(np.asarray(weights, dtype=np.float64), 1e-12)
        self.quanta = self.tokens // quantum
        self.slots = window // quantum
        self.full = int(self.quanta.sum())
        tails = self.tokens - self.quanta * quantum
        #: place of a source's last, partial quantum in the whole stream
        self.tail_at = self.full * quantum + np.cumsum(tails) - tails
        self.total = int(self.tokens.sum())
        # water level f at which sum(min(quanta, f * weight)) reaches a slot count
        dry = self.quanta / self.weights
        order = np.argsort(dry, kind="stable")
        self._level = np.concatenate([[0.0], dry[order]])
        rest = self.weights.sum() - np.concatenate([[0.0], np.cumsum(self.weights[order])[:-1]]) if len(order) else np.zeros(0)
        self._filled = np.concatenate([[0.0], np.cumsum(np.diff(self._level) * rest)])

    def dealt(self, windows: np.ndarray) -> np.ndarray:
        """Quanta of each queue (columns) dealt before each window (rows): the
        first slots in the order ((2 k + 1) / weight, queue)."""
        h = np.minimum(np.asarray(windows, dtype=np.int64) * self.slots, self.full)
        f = np.interp(h, self._filled, self._level)
        k = np.minimum(np.rint(f[:, None] * self.weights), self.quanta).astype(np.int64)
        if not k.size:
            return k
        while True:
            gap = h - k.sum(axis=1)
            rows = np.flatnonzero(gap)
            if not len(rows):
                break
            for r, sign in ((rows[gap[rows] > 0], 1), (rows[gap[rows] < 0], -1)):
                if len(r):
                    k[r] = self._moved(k[r], np.abs(gap[r]), sign)
        rows = np.arange(len(k))
        while len(rows):  # rounding may have left a dealt slot behind one that is not
            part = k[rows]
            a, b = self._next(part, 1), self._next(part, -1)
            i = np.arange(len(part))
            pa_, pb = (2 * part[i, a] + 1) / self.weights[a], (2 * part[i, b] - 1) / self.weights[b]
            swap = (part[i, a] < self.quanta[a]) & (part[i, b] > 0) & ((pa_ < pb) | ((pa_ == pb) & (a < b)))
            rows = rows[swap]
            k[rows, a[swap]] += 1
            k[rows, b[swap]] -= 1
        return k

    def _moved(self, k: np.ndarray, gap: np.ndarray, sign: int) -> np.ndarray:
        """``k`` after up to ``gap`` more slots of each row were dealt (1) or
        taken back (-1): as many as come before any queue's second one."""
        queues = np.arange(k.shape[1])
        if sign > 0:
            first = np.where(k < self.quanta, (2 * k + 1) / self.weights, np.inf)
            second = np.where(k + 1 < self.quanta, (2 * k + 3) / self.weights, np.inf)
            order = np.argsort(first, axis=1, kind="stable")
        else:  # last dealt first: largest, then the highest queue
            first = np.where(k > 0, -(2 * k - 1) / self.weights, np.inf)
            second = np.where(k > 1, -(2 * k - 3) / self.weights, np.inf)
            order = k.shape[1] - 1 - np.argsort(first[:, ::-1], axis=1, kind="stable")
        ahead = np.take_along_axis(first, order, 1)
        # the least second slot among a queue and those before it
        bound = np.minimum.accumulate(np.take_along_axis(second, order, 1), axis=1)
        take = np.ones(k.shape, dtype=bool)
        take[:, 1:] = ahead[:, 1:] < bound[:, :-1]
        take = np.logical_and.accumulate(take, axis=1) & (queues < gap[:, None]) & np.isfinite(ahead)
        out = k.copy()
        np.put_along_axis(out, order, np.take_along_axis(k, order, 1) + sign * take, 1)
        return out

    def _next(self, k: np.ndarray, sign: int) -> np.ndarray:
        """The queue whose slot comes next (1), or came last (-1)."""
        if sign > 0:
            return np.where(k < self.quanta, (2 * k + 1) / self.weights, np.inf).argmin(axis=1)
        last = np.where(k > 0, (2 * k - 1) / self.weights, -np.inf)
        return k.shape[1] - 1 - last[:, ::-1].argmax(axis=1)

    def _slices(self, n: int):
        """Ranges of ``n`` rows that, with a column per queue, are held at once."""
        step = max(1, HELD // max(1, len(self.tokens)))
        return [(at, min(n, at + step)) for at in range(0, n, step)]

    def window_of(self, queue: np.ndarray, quantum: np.ndarray) -> np.ndarray:
        """The window that holds the given quantum of a queue: the slots that
        come before it, counted queue by queue."""
        slots = np.empty(len(queue), dtype=np.int64)
        queues = np.arange(len(self.tokens))
        for low, high in self._slices(len(queue)):
            q = queue[low:high]
            t = ((2 * quantum[low:high] + 1) / self.weights[q])[:, None]
            lower = queues < q[:, None]  # of equal ones the lower queue comes first

            def before(k):
                x = (2 * k + 1) / self.weights
                return (x < t) | ((x == t) & lower)

            k = np.clip(np.floor((t * self.weights + 1) / 2), 0, self.quanta).astype(np.int64)
            while (more := before(k) & (k < self.quanta)).any():
                k += more
            while (less := (k > 0) & ~before(k - 1)).any():
                k -= less
            slots[low:high] = k.sum(axis=1)
        return slots // self.slots

    def places(self, windows: np.ndarray, queue: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each (window, queue): the queue's quanta dealt before the window
        and after it, and those of lower queues in the window."""
        begin, end, ahead = (np.empty(len(windows), dtype=np.int64) for _ in range(3))
        order = np.argsort(windows, kind="stable")
        unique, first = np.unique(windows[order], return_index=True)
        last = np.append(first[1:], len(order))
        for low, high in self._slices(len(unique)):
            at = order[first[low] : last[high - 1]]
            row = np.searchsorted(unique[low:high], windows[at])
            now = self.dealt(unique[low:high])
            follows = np.append(unique[low + 1 : high] == unique[low : high - 1] + 1, False)
            then = np.empty_like(now)
            then[:-1][follows[:-1]] = now[1:][follows[:-1]]
            then[~follows] = self.dealt(unique[low:high][~follows] + 1)
            given = np.cumsum(then - now, axis=1)
            own = queue[at]
            begin[at], end[at] = now[row, own], then[row, own]
            ahead[at] = given[row, own] - (end[at] - begin[at])
        return begin, end, ahead

    def pieces(self, queue: np.ndarray, start: np.ndarray, length: np.ndarray):
        """Cuts documents at [start, start + length) of their queues. Returns
        document number, start in the document, length, sequence, offset."""
        q, full = self.quantum, self.quanta[queue] * self.quantum
        body = np.minimum(np.maximum(full - start, 0), length)
        has = np.flatnonzero(body > 0)
        # a window has a quantum of the queue at least: its quanta say which
        low, high = start[has] // q, (start[has] + body[has] - 1) // q
        n = high - low + 1
        doc = np.repeat(has, n)
        quantum = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        win = self.window_of(queue[doc], quantum)
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (win[1:] != win[:-1])
        doc, win = doc[new], win[new]
        own = queue[doc]
        begin, end, ahead = self.places(win, own)
        here, there = begin * q, end * q
        lo, hi = np.maximum(start[doc], here), np.minimum(start[doc] + body[doc], there)
        offset = ahead * q + lo - here
        real = hi > lo
        parts = [(doc[real], lo[real] - start[doc[real]], (hi - lo)[real], win[real], offset[real])]
        tail = np.flatnonzero(length > body)  # in the source's partial quantum
        at = self.tail_at[queue[tail]] + start[tail] + body[tail] - full[tail]
        stop = at + length[tail] - body[tail]
        while len(tail):
            w = at // self.window
            hi = np.minimum(stop, (w + 1) * self.window)
            parts.append((tail, at - stop + length[tail], hi - at, w, at - w * self.window))
            tail, at, stop = tail[hi < stop], hi[hi < stop], stop[hi < stop]
        return [np.concatenate(x) for x in zip(*parts)]


def _key(source: str | None) -> str:
    """The queue of a source of its own; tail queues are "#0", "#1", ..."""
    return "" if source is None else "=" + source


def own_queues(docs: DataFrame, text: str, source: str, weights: dict[str | None, float] | None) -> set[str] | None:
    """Keys of the sources that keep a queue of their own (None: all do)."""
    key = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    if docs.select(key.alias("queue")).distinct().limit(MOST_QUEUES + 1).count() <= MOST_QUEUES:
        return None
    sizes = stored(docs.groupBy(key.alias("queue")).agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 1).alias("n")), "sizes")
    given = docs.sparkSession.createDataFrame([(_key(s),) for s in weights or ()], "queue string")
    own = {r["queue"] for r in sizes.join(given, "queue", "left_semi").select("queue").collect()}
    room = max(0, MOST_QUEUES - _tail_queues() - len(own))
    return own | {r["queue"] for r in sizes.join(given, "queue", "left_anti").orderBy(F.desc("n"), "queue").limit(room).collect()}


def _tail_queues() -> int:
    return max(1, MOST_QUEUES // 4)


def encoded(docs: DataFrame, doc_id: str, text: str, source: str, name: str, own: set[str] | None = None) -> DataFrame:
    """(doc_id, queue key, part, local start, tokens, ids), written once. Part
    is the input partition; local start counts the queue's tokens before the
    document in it. Sources not in ``own`` share the tail queues."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text"), F.col(source).cast("string").alias("queue"))
    held, tail = docs.sparkSession.sparkContext.broadcast(own), _tail_queues()
    schema = pa.schema([("doc_id", pa.int64()), ("queue", pa.string()), ("part", pa.int32()), ("local", pa.int64()), ("tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        enc, seen, part, own = encoder(name), {}, TaskContext.get().partitionId(), held.value
        end = np.array([END], dtype=enc.dtype).tobytes()
        for batch in batches:
            ids = [enc.ids(x.as_py()) + end for x in batch["_text"]]
            tokens = [len(x) // enc.dtype.itemsize for x in ids]
            local, queues = [], [_key(q) for q in batch["queue"].to_pylist()]
            if own is not None:
                queues = [q if q in own else f"#{zlib.crc32(q.encode('utf-8', 'surrogatepass')) % tail}" for q in queues]
            for q, n in zip(queues, tokens):
                local.append(seen.get(q, 0))
                seen[q] = local[-1] + n
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(queues, pa.string()), pa.array([part] * len(ids), pa.int32()), pa.array(local, pa.int64()), pa.array(tokens, pa.int64()), pa.array(ids, pa.binary())], schema=schema)

    return stored(rows.mapInArrow(run, "doc_id long, queue string, part int, local long, tokens long, ids binary"), "ids")


def pack(docs: DataFrame, weights: dict[str | None, float] | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source", name: str = NAME, window: int = WINDOW, quantum: int = QUANTUM) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and ids (the piece's ids, 2 or 4 bytes each)."""
    ids = encoded(docs, doc_id, text, source, name, own_queues(docs, text, source, weights))
    totals = stored(ids.groupBy("part", "queue").agg(F.sum("tokens").alias("n")), "totals")
    queues = sorted(totals.groupBy("queue").agg(F.sum("n").alias("n")).collect(), key=lambda r: (r["queue"] == "", r["queue"]))
    number = {r["queue"]: i for i, r in enumerate(queues)}
    tokens = np.array([r["n"] for r in queues], dtype=np.int64)
    given = None if weights is None else {_key(s): w for s, w in weights.items()}
    # a shared queue has only sources without a given weight
    shares = tokens if given is None else np.array([given.get(r["queue"], 0.0) for r in queues])
    deal = Deal(tokens, shares, window, quantum)
    before = W.partitionBy("queue").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = stored(totals.select("part", "queue", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    placed = ids.join(bases, ["part", "queue"])
    held = docs.sparkSession.sparkContext.broadcast((deal, number))
    step = max(1, 2000 * MOST_QUEUES // max(MOST_QUEUES, len(queues)))  # documents by queues held at once
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        deal, number = held.value
        for big in batches:
            for at in range(0, big.num_rows, step):
                batch = big.slice(at, step)
                queue = np.array([number[q] for q in batch["queue"].to_pylist()], dtype=np.int64)
                start = batch["base"].to_numpy() + batch["local"].to_numpy()
                tokens = batch["tokens"].to_numpy()
                doc, lo, n, win, offset = deal.pieces(queue, start, tokens)
                size = len(batch["ids"][0].as_buffer()) // int(tokens[0])
                views = [memoryview(x.as_buffer()) for x in batch["ids"]]
                cuts = [views[d][a * size : (a + k) * size] for d, a, k in zip(doc.tolist(), lo.tolist(), n.tolist())]
                crc = [zlib.crc32(np.frombuffer(c, dtype=f"<u{size}").astype("<u4").data) for c in cuts]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (lo, n, crc, tokens[doc], win, offset)), pa.array([bytes(c) for c in cuts], pa.binary())], schema=schema)

    return placed.select("doc_id", "queue", "local", "tokens", "ids", "base").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
