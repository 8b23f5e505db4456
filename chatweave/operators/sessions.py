"""Sessions of a chat: lines parted where nobody wrote for a while (K1).

A line starts a session if it is the first of its (chat, batch) or comes more
than ``gap`` after the line before it. Which line is before it is a question
across partitions, and a chat may hold a third of all lines, so there is no
``lag`` over a chat: the lines are range-partitioned, sorted and stored
(:func:`sequence.range_sorted`); a pass per partition counts the gaps inside it;
and a row per (partition, chat) with its first and last time tells whether a
gap lies at the boundary, and how many sessions began before. Only these rows
meet in a window.

``chunk_session`` then packs each session greedily by the fold of
:mod:`chatweave.operators.chunking`, with the session as part of the group: the
fold starts anew at each session, and a session that spans many partitions
is stitched like a large chat.

Defined results: lines of equal time are one session; a negative gap makes
every line a session; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatweave.operators.chunking import CHUNK_SIZE, GROUP, LINES_SCHEMA, ORDER, chunk_greedy
from chatweave.operators.sequence import BROADCAST_ROWS, range_sorted
from chatweave.session import join_bounded, materialize

#: Longest silence within a session, in seconds of message time.
SESSION_GAP = 6 * 3600


def with_sessions(lines: DataFrame, gap: int = SESSION_GAP, num_partitions: int | None = None) -> DataFrame:
    """``lines`` with ``session_no``, counted from 0 per (chat, batch)."""
    r = range_sorted(lines.select(*[f.split(" ")[0] for f in LINES_SCHEMA.split(", ")]), GROUP, ORDER, num_partitions)
    schema = T.StructType([*r.schema.fields, T.StructField("_gaps", T.LongType())])

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Gaps before each line within its (partition, chat, batch)."""
        key, last, seen = None, 0, 0
        for pdf in batches:
            if pdf.empty:
                continue
            chat, batch, time = pdf["chat_key"].to_numpy(), pdf["batch_id"].to_numpy(), pdf["time"].to_numpy(dtype=np.int64)
            new = np.ones(len(pdf), dtype=bool)
            new[1:] = (chat[1:] != chat[:-1]) | (batch[1:] != batch[:-1])
            before = np.empty(len(pdf), dtype=np.int64)
            before[1:] = time[:-1]
            goes_on = (chat[0], batch[0]) == key
            new[0], before[0] = not goes_on, last
            starts = ~new & (time - before > gap)
            total = np.cumsum(starts)
            # less what was counted before the line's own chat began
            base = np.maximum.accumulate(np.where(new, total, 0))
            count = total - base
            first = np.cumsum(new) == (0 if goes_on else 1)
            if goes_on:
                count[first] += seen
            key, last, seen = (chat[-1], batch[-1]), int(time[-1]), int(count[-1])
            yield pdf.assign(_gaps=count)

    marked = materialize(r.mapInPandas(local, schema))
    parts = marked.groupBy("_pid", *GROUP).agg(F.min("time").alias("_first"), F.max("time").alias("_last"), F.max("_gaps").alias("_n"))
    order = Window.partitionBy(*GROUP).orderBy("_pid")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_edge", F.coalesce((F.col("_first") - F.lag("_last").over(order) > gap).cast("long"), F.lit(0)))
    # sessions that began in earlier parts, and at this part's own first line
    parts = parts.withColumn("_before", F.coalesce(F.sum(F.col("_n") + F.col("_edge")).over(earlier), F.lit(0)) + F.col("_edge")).where("_before > 0")
    joined = join_bounded(marked, materialize(parts.select("_pid", *GROUP, "_before")), ["_pid", *GROUP], max_rows=BROADCAST_ROWS)
    return joined.withColumn("session_no", F.col("_gaps") + F.coalesce("_before", F.lit(0))).drop("_pid", "_gaps", "_before")


def sessions(lines: DataFrame, gap: int = SESSION_GAP, num_partitions: int | None = None) -> DataFrame:
    """``(chat_key, batch_id, session_no, first_time, last_time, n_lines)``."""
    return with_sessions(lines, gap, num_partitions).groupBy(*GROUP, "session_no").agg(
        F.min("time").alias("first_time"), F.max("time").alias("last_time"), F.count(F.lit(1)).alias("n_lines"))


def chunk_session(lines: DataFrame, gap: int = SESSION_GAP, size: int = CHUNK_SIZE, num_partitions: int | None = None) -> DataFrame:
    """Greedy chunks that never cross a session: ``(chat_key, batch_id,
    session_no, chunk_no, text)``; ``chunk_no`` counts within the session."""
    parted = with_sessions(lines, gap, num_partitions)
    # a (chat, batch) is one name, its session takes the place of the batch
    keyed = parted.withColumn("chat_key", F.concat(F.col("batch_id").cast("string"), F.lit(":"), "chat_key")).withColumn("batch_id", F.col("session_no"))
    chunks = chunk_greedy(keyed.drop("session_no"), size, num_partitions)
    at = F.locate(":", "chat_key")
    return chunks.select(
        F.substring("chat_key", at + 1, F.length("chat_key")).alias("chat_key"), F.substring("chat_key", F.lit(1), at - 1).cast("long").alias("batch_id"),
        F.col("batch_id").alias("session_no"), "chunk_no", "text")
