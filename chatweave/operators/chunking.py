"""Pack chat lines into size-bounded chunks.

Lines are ``sender: text`` on one line, in ``(time, message_id)`` order per
``(chat_key, batch_id)``; a chunk never crosses a batch, so every load of new
messages is chunked on its own.

``chunk_greedy`` (the default) packs whole lines while the chunk, lines
joined by a newline, stays within ``size`` characters. A line longer than
``size`` closes the open chunk and is cut alone: its words are packed the
same way with spaces, a word longer than ``size`` is cut every ``size``
characters. Chunks are stripped and empty ones dropped.

Greedy packing is a sequential fold, yet one chat may hold a large share of
all messages, so the fold is split over range partitions and made exact
with a stitch:

* the lines are range-partitioned, sorted and stored with their partition id
  (:func:`sequence.range_sorted`), so all passes see the same partitions;
* pass 1, per partition: only its first and last group segment can touch
  another partition. The first may continue a chunk left open by the previous
  one, so its fold is run for all entry states (open length -1..size) at
  once. Entries that overflow at the same line share one state from then on,
  so the fold is a short list of pieces: entries that have not overflowed
  (exit = entry + added length), and ranges of entries with one exit state.
  Each segment also yields the last ``size+1`` characters of its text;
* stitch, in levels: up to ``FAN`` consecutive summaries of a chat are
  composed into one until a chat has at most ``FAN``; then the entry states go
  down the same levels. A task holds ``FAN`` summaries (at most about 12 KB
  each, 3 MB), whatever the number of partitions;
* pass 2, per segment: the real fold with the segment's entry state, carried
  text and chunk-number offset; a segment leaves its final open chunk to the
  next partition. The carries are one row of at most about 1 KB per
  partition boundary: broadcast up to ``BROADCAST_CARRIES`` rows (1 MB), beyond
  which the lines are joined by a shuffle and sorted again (at 800,000
  partitions they are 0.8 GB, and no task or driver holds them).

``chunk_grid`` is the pure-SQL alternative: ``chunk_no = floor(offset /
size)``; not greedy, and a chunk can exceed ``size`` by one line.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatweave.functions.text import format_line, whitespace_class
from chatweave.operators.sequence import range_sorted, with_positions
from chatweave.session import join_bounded, materialize

# Chunk size in characters (code points) and overlap.
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 0
LINE_JOINER = "\n"

# Summaries composed by one task, and carries that are broadcast at most.
FAN = 256
BROADCAST_CARRIES = 1_000

GROUP = ["chat_key", "batch_id"]
ORDER = ["time", "message_id"]

LINES_SCHEMA = "chat_key string, batch_id long, time long, message_id long, line string"
CHUNKS_SCHEMA = T.StructType(
    [
        T.StructField("chat_key", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("chunk_no", T.LongType()),
        T.StructField("text", T.StringType()),
    ]
)


def format_lines(messages: DataFrame) -> DataFrame:
    """``(chat_key, batch_id, time, message_id, line)``: ``sender: text``
    with inner line breaks turned into spaces. ``batch_id`` is 0 when the
    messages carry none."""
    batch = F.col("batch_id").cast("long") if "batch_id" in messages.columns else F.lit(0).cast("long")
    return messages.select(
        "chat_key",
        batch.alias("batch_id"),
        F.col("time").cast("long").alias("time"),
        F.col("message_id").cast("long").alias("message_id"),
        format_line("sender", "text").alias("line"),
    ).where(F.col("line").isNotNull())


def line_offsets(lines: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """The joined text of a chat, kept distributed: per line its number
    ``line_no`` and its start ``offset`` in the lines joined by newlines."""
    df = lines.withColumn("_len", F.length("line"))
    out = with_positions(df, GROUP, ORDER, "_len", num_partitions)
    return out.select(
        *GROUP, *ORDER, F.col("_pos").alias("line_no"), F.col("_offset").alias("offset"), "line"
    )


def _strip_expr(c) -> F.Column:
    ws = whitespace_class()
    return F.regexp_replace(c, f"^[{ws}]+|[{ws}]+$", "")


def chunk_grid(lines: DataFrame, size: int = CHUNK_SIZE, num_partitions: int | None = None) -> DataFrame:
    """Chunks by offset grid: ``chunk_no = floor(offset / size)``, lines
    joined in order. Every chunk is its own group of bounded size."""
    off = line_offsets(lines, num_partitions)
    return (
        off.withColumn("chunk_no", F.floor(F.col("offset") / size).cast("long"))
        .groupBy(*GROUP, "chunk_no")
        .agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("_l"))
        .select(
            *GROUP, "chunk_no",
            _strip_expr(F.array_join(F.transform("_l", lambda x: x["line"]), LINE_JOINER)).alias("text"),
        )
        .where(F.col("text") != "")
    )


# --- greedy -----------------------------------------------------------------

def split_long_line(line: str, size: int = CHUNK_SIZE) -> list[str]:
    """Pieces of a line longer than ``size``: words packed with spaces, words
    longer than ``size`` cut every ``size`` characters."""
    out: list[str] = []
    cur: str | None = None
    for word in line.split(" "):
        parts = [word[i:i + size] for i in range(0, len(word), size)] or [""]
        for part in parts:
            if cur is None:
                cur = part
            elif len(cur) + 1 + len(part) <= size:
                cur = cur + " " + part
            else:
                out.append(cur)
                cur = part
    if cur is not None:
        out.append(cur)
    return out


def greedy_fold(lines: list[str], size: int = CHUNK_SIZE) -> list[str]:
    """Reference fold over one group's lines (used by tests)."""
    chunks: list[str] = []
    open_: list[str] | None = None
    s = -1
    for line in lines:
        n = len(line)
        if n > size:
            if open_ is not None:
                chunks.append(LINE_JOINER.join(open_))
            chunks.extend(split_long_line(line, size))
            open_, s = None, -1
        elif s == -1:
            open_, s = [line], n
        elif s + 1 + n <= size:
            open_.append(line)
            s += 1 + n
        else:
            chunks.append(LINE_JOINER.join(open_))
            open_, s = [line], n
    if open_ is not None:
        chunks.append(LINE_JOINER.join(open_))
    return [c.strip() for c in chunks if c.strip()]


class Fold:
    """Greedy packing of a run of lines as a function of the entry state.

    ``pieces``: sorted ``(low, moving, value, starts)``; the piece of an entry
    ``e`` is the last with ``low <= e``. Its exit is ``e + value`` if it is
    moving (no line has overflowed yet), else ``value``; ``starts`` counts the
    chunks begun. The first piece is entry -1 (no open chunk) alone.
    """

    def __init__(self, size: int, fixed: bool = False):
        self.size, self.added, self.high = size, 0, -1 if fixed else size
        # states: open length, chunks begun since the state arose, and its
        # ranges of entries [(low, chunks begun before)]
        self.length, self.begun, self.ranges = np.array([-1]), np.array([0]), [[(-1, 0)]]

    def add(self, n: int, long_starts: int = 0) -> None:
        """A line of length ``n``; ``long_starts``: pieces of a longer line."""
        if n > self.size:
            self.begun += long_starts
            self._merge(np.ones(len(self.length), dtype=bool), -1)
            if self.high >= 0:
                self.ranges[0].append((0, long_starts - int(self.begun[0])))
                self.high = -1
            return
        over = (self.length == -1) | (self.length + 1 + n > self.size)
        self.begun += over
        self.length = np.where(over, n, self.length + 1 + n)
        fits = self.size - self.added - 1 - n  # moving entries up to here stay
        if self.high >= 0 and fits < self.high:
            low = max(0, fits + 1)
            if not over.any():
                self.length, self.begun = np.append(self.length, n), np.append(self.begun, 1)
                over = np.append(over, True)
                self.ranges.append([(low, 0)])
            else:
                k = int(np.argmax(over))
                self.ranges[k].append((low, 1 - int(self.begun[k])))
            self.high = low - 1
        self.added += 1 + n
        if over.sum() > 1:
            self._merge(over, n)

    def _merge(self, which: np.ndarray, length: int) -> None:
        """The states in ``which`` are one from now on."""
        ks = np.flatnonzero(which)
        into = int(ks[0])
        for k in ks[1:]:
            shift = int(self.begun[k] - self.begun[into])
            self.ranges[into] += [(low, before + shift) for low, before in self.ranges[k]]
        keep = np.ones(len(which), dtype=bool)
        keep[ks[1:]] = False
        self.length[into] = length
        self.length, self.begun = self.length[keep], self.begun[keep]
        self.ranges = [r for r, ok in zip(self.ranges, keep) if ok]

    def pieces(self) -> list[tuple[int, bool, int, int]]:
        out = [
            (low, False, int(self.length[k]), int(self.begun[k]) + before)
            for k, ranges in enumerate(self.ranges) for low, before in ranges
        ]
        if self.high >= 0:
            out.append((0, True, self.added, 0))
        return sorted(out)


def apply_pieces(pieces, entry: int) -> tuple[int, int]:
    """(exit state, chunks begun) for one entry state."""
    lows = [p[0] for p in pieces]
    _, moving, value, starts = pieces[bisect_right(lows, entry) - 1]
    return (entry + value if moving else value), starts


def compose_pieces(first, then, size: int):
    """The pieces of one run of lines followed by another."""
    out, lows = [], [p[0] for p in then]
    for i, (low, moving, value, starts) in enumerate(first):
        if not moving:
            exit_, more = apply_pieces(then, value)
            out.append((low, False, exit_, starts + more))
            continue
        high = first[i + 1][0] - 1 if i + 1 < len(first) else size
        k = bisect_right(lows, low + value) - 1
        while k < len(then) and then[k][0] <= high + value:
            t_low, t_moving, t_value, t_starts = then[k]
            out.append((max(low, t_low - value), t_moving, value + t_value if t_moving else t_value, starts + t_starts))
            k += 1
    return out


_PIECES = "low array<int>, moving array<boolean>, value array<int>, starts array<bigint>"
SUMMARY_SCHEMA = f"chat_key string, batch_id long, node long, {_PIECES}, tail string"
ENTRY_SCHEMA = "chat_key string, batch_id long, node long, _entry int, _carry string, _offset long, _continues boolean"


def _unpack(row):
    return list(zip(map(int, row.low), map(bool, row.moving), map(int, row.value), map(int, row.starts)))


def _pack(pieces):
    return [list(x) for x in zip(*pieces)]


def _joined(before: str | None, tail: str, size: int) -> str:
    return (tail if before is None else before + LINE_JOINER + tail)[-(size + 1):]


def _summarize(size: int):
    """Per sorted partition: the folds of its first and last segment."""

    def summarize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, pid, key, fold, tail, first = [], None, None, None, None, True

        def close():
            rows.append((key[0], key[1], pid, *_pack(fold.pieces()), tail))

        for pdf in batches:
            for p, ck, bid, line in zip(pdf["_pid"].tolist(), pdf["chat_key"].tolist(), pdf["batch_id"].tolist(), pdf["line"].tolist()):
                if (ck, bid) != key:
                    if key is not None and first:
                        close()
                        first = False
                    fold, tail = Fold(size, fixed=key is not None), None
                    pid, key = int(p), (ck, bid)
                n = len(line)
                fold.add(n, len(split_long_line(line, size)) if n > size else 0)
                tail = _joined(tail, line, size)
        if key is not None:
            close()  # the last segment, or the only one
        yield pd.DataFrame(rows, columns=["chat_key", "batch_id", "node", "low", "moving", "value", "starts", "tail"])

    return summarize


def _compose(size: int):
    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        pieces, tail = None, None
        for row in pdf.itertuples(index=False):
            pieces = _unpack(row) if pieces is None else compose_pieces(pieces, _unpack(row), size)
            tail = _joined(tail, row.tail, size)
        head = pdf.iloc[0]
        return pd.DataFrame([(head.chat_key, head.batch_id, head.node // FAN, *_pack(pieces), tail)],
                            columns=["chat_key", "batch_id", "node", "low", "moving", "value", "starts", "tail"])

    return compose


def _descend(size: int):
    """Entry states of the summaries below nodes whose entry is known."""

    def descend(above: pd.DataFrame, below: pd.DataFrame) -> pd.DataFrame:
        out, below = [], below.sort_values("node")
        for known, carry, offset, goes_on in zip(above["_entry"], above["_carry"], above["_offset"], above["_continues"]):
            entry, offset = int(known), int(offset)
            carry = None if entry < 0 else carry
            for i, row in enumerate(below.itertuples(index=False)):
                out.append((row.chat_key, row.batch_id, row.node, entry, carry, offset, bool(goes_on) or i < len(below) - 1))
                exit_, starts = apply_pieces(_unpack(row), entry)
                text = _joined(carry, row.tail, size)
                entry, offset = exit_, offset + starts
                carry = None if entry < 0 else text[len(text) - entry:] if entry else ""
        return pd.DataFrame(out, columns=["chat_key", "batch_id", "node", "_entry", "_carry", "_offset", "_continues"])

    return descend


def entry_states(summaries: DataFrame, size: int) -> DataFrame:
    """Entry state, carried text and chunk offset of every segment of a group
    that spans several partitions (``node`` is the partition id)."""
    spans = summaries.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*GROUP)
    levels = [materialize(summaries.join(spans, GROUP, "left_semi"))]
    while (levels[-1].groupBy(*GROUP).count().agg(F.max("count")).first()[0] or 0) > FAN:
        below = levels[-1].withColumn("_up", F.floor(F.col("node") / FAN))
        levels.append(materialize(below.groupBy(*GROUP, "_up").applyInPandas(_compose(size), SUMMARY_SCHEMA)))
    known = levels[-1].select(*GROUP).distinct().selectExpr(
        *GROUP, "-1L AS node", "-1 AS _entry", "CAST(NULL AS STRING) AS _carry", "0L AS _offset", "false AS _continues")
    for i, level in enumerate(reversed(levels)):
        below = level.withColumn("_up", F.lit(-1).cast("long") if i == 0 else F.floor(F.col("node") / FAN))
        above = known.withColumnRenamed("node", "_up")
        known = materialize(
            above.groupBy(*GROUP, "_up").cogroup(below.groupBy(*GROUP, "_up")).applyInPandas(_descend(size), ENTRY_SCHEMA))
    return known


def _emit(size: int):
    """The real fold, per segment (rows of one partition id and group)."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, open_, s, count, cur_no, left_open = None, None, -1, 0, 0, False
        for pdf in batches:
            out = []

            def flush():
                if open_ is not None:
                    text = LINE_JOINER.join(open_).strip()
                    if text:
                        out.append((key[1], key[2], cur_no, text))

            cols = zip(pdf["_pid"].tolist(), pdf["chat_key"].tolist(), pdf["batch_id"].tolist(), pdf["line"].tolist(),
                       pdf["_entry"].tolist(), pdf["_carry"].tolist(), pdf["_offset"].tolist(), pdf["_continues"].tolist())
            for pid, ck, bid, line, entry, carry, offset, cont in cols:
                if (pid, ck, bid) != key:
                    if key is not None and not left_open:
                        flush()
                    key, open_, s, count, cur_no = (pid, ck, bid), None, -1, 0, 0
                    if entry is not None and not pd.isna(entry):
                        s, count = int(entry), int(offset)
                        if s >= 0:
                            open_, cur_no = [carry or ""], count - 1
                    left_open = bool(cont) if cont is not None and not pd.isna(cont) else False
                n = len(line)
                if n > size:
                    flush()
                    for piece in split_long_line(line, size):
                        piece = piece.strip()
                        if piece:
                            out.append((ck, bid, count, piece))
                        count += 1
                    open_, s = None, -1
                elif s == -1:
                    open_, s, cur_no = [line], n, count
                    count += 1
                elif s + 1 + n <= size:
                    open_.append(line)
                    s += 1 + n
                else:
                    flush()
                    open_, s, cur_no = [line], n, count
                    count += 1
            if out:
                yield pd.DataFrame(out, columns=["chat_key", "batch_id", "chunk_no", "text"])
        if key is not None and not left_open and open_ is not None:
            text = LINE_JOINER.join(open_).strip()
            if text:
                yield pd.DataFrame([(key[1], key[2], cur_no, text)], columns=["chat_key", "batch_id", "chunk_no", "text"])

    return emit


def chunk_greedy(lines: DataFrame, size: int = CHUNK_SIZE, num_partitions: int | None = None) -> DataFrame:
    """Greedy chunks ``(chat_key, batch_id, chunk_no, text)`` of ``lines``
    (see module doc). ``chunk_no`` counts chunk starts within the group."""
    r = range_sorted(lines.select("chat_key", "batch_id", "time", "message_id", "line"), GROUP, ORDER, num_partitions)
    summaries = materialize(r.mapInPandas(_summarize(size), SUMMARY_SCHEMA))
    states = entry_states(summaries, size).withColumn("_pid", F.col("node").cast("int")).drop("node")
    keys = ["_pid", *GROUP]
    carried = join_bounded(r, states, keys, max_rows=BROADCAST_CARRIES).select(
        *keys, *ORDER, "line", "_entry", "_carry", "_offset", "_continues")
    # a shuffle join deals segments out whole but not in order
    ordered = carried.sortWithinPartitions(*keys, *ORDER)
    return ordered.mapInPandas(_emit(size), CHUNKS_SCHEMA)
