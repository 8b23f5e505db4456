"""Row positions and running sums within ordered groups, without putting a
whole group into one task.

``row_number() OVER (PARTITION BY chat ORDER BY time)`` sends each chat to a
single task; one chat holding a third of all messages would then be one
third of the job on one core. Instead:

1. range-partition on ``(group, order)`` -- a large group is spread over
   many consecutive partitions -- and sort within partitions; the sorted
   partitions and their ids are stored (a reliable checkpoint), because a
   range partitioner that is run again may cut elsewhere: every later step
   reads the same stored partitions;
2. one pass per partition (Arrow batches) computes positions and running
   sums local to the partition, carrying state across batches;
3. per ``(partition, group)`` totals (partial aggregation) give, for each
   group that continues from an earlier partition, the offset to add. At most
   one group crosses each partition boundary, so there are at most as many
   offsets as partitions, about 60 bytes each: 48 MB at 800,000 partitions.
   They are broadcast only up to ``BROADCAST_ROWS`` rows (0.6 MB), beyond
   which the join shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatweave.session import join_bounded, materialize

# Offsets of at most this many partitions are broadcast.
BROADCAST_ROWS = 10_000


def default_partitions(df: DataFrame) -> int:
    """Range-partition count for ``df``: never fewer than the input's own
    partitions. An explicit count is not resized by adaptive execution, so a
    fixed ``spark.sql.shuffle.partitions`` alone would put ever more data in
    each partition as the input grows. The input is a checkpoint (or a scan)
    here, whose partitions are sized by bytes (``maxPartitionBytes`` /
    the adaptive advisory size), so the count scales with the data."""
    configured = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(configured, df.rdd.getNumPartitions())


def range_sorted(df: DataFrame, group_cols: list[str], order_cols: list[str], num_partitions: int | None = None) -> DataFrame:
    """Range-partitioned on group then order keys, sorted within partitions,
    with the partition id in ``_pid``, stored: ``_pid`` is data, not a function
    of how the partitioner happened to sample. ``order_cols`` must make the
    order total."""
    df = materialize(df)  # the partitioner reads its input in a job of its own
    n = num_partitions or default_partitions(df)
    keys = [*group_cols, *order_cols]
    return materialize(
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_pid", F.spark_partition_id())
    )


def _run_ids(pdf: pd.DataFrame, group_cols: list[str], prev_key) -> tuple[np.ndarray, bool]:
    """Run number per row (a new run whenever the group key changes) and
    whether the first run continues ``prev_key``."""
    change = np.zeros(len(pdf), dtype=bool)
    for c in group_cols:
        s = pdf[c]
        change |= (s != s.shift()).to_numpy()
    if len(pdf):
        change[0] = True
    continues = prev_key is not None and len(pdf) > 0 and tuple(pdf[group_cols].iloc[0]) == prev_key
    if continues:
        change[0] = False
    return np.cumsum(change), continues


def with_positions(
    df: DataFrame,
    group_cols: list[str],
    order_cols: list[str],
    length_col: str | None = None,
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``_pos`` (0-based position within the group, in order) and, when
    ``length_col`` is given, ``_offset``: the sum of ``length + 1`` over the
    earlier rows of the group (the start of the row in the group's rows joined
    by one separator character)."""
    r = range_sorted(df, group_cols, order_cols, num_partitions)
    out_schema = T.StructType(r.schema.fields + [T.StructField("_lpos", T.LongType())]
                              + ([T.StructField("_loff", T.LongType())] if length_col else []))

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prev_key, pos, off = None, 0, 0
        for pdf in batches:
            if pdf.empty:
                continue
            runs, continues = _run_ids(pdf, group_cols, prev_key)
            lpos = pdf.groupby(runs).cumcount().to_numpy(dtype=np.int64)
            first = runs == runs[0]
            if continues:
                lpos[first] += pos
            pdf = pdf.assign(_lpos=lpos)
            if length_col:
                step = pdf[length_col].fillna(0).to_numpy(dtype=np.int64) + 1
                csum = pd.Series(step).groupby(runs).cumsum().to_numpy() - step
                if continues:
                    csum[first] += off
                pdf = pdf.assign(_loff=csum)
                off = int(csum[-1] + step[-1])
            pos = int(lpos[-1]) + 1
            prev_key = tuple(pdf[group_cols].iloc[-1])
            yield pdf

    loc = r.mapInPandas(local, out_schema)

    aggs = [F.count(F.lit(1)).alias("_n")]
    if length_col:
        aggs.append(F.sum(F.coalesce(F.col(length_col).cast("long"), F.lit(0)) + 1).alias("_len"))
    totals = r.groupBy("_pid", *group_cols).agg(*aggs)
    w = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_pid", *group_cols,
        F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_pos0"),
        *([F.coalesce(F.sum("_len").over(w), F.lit(0)).alias("_off0")] if length_col else []),
    ).where(F.col("_pos0") > 0)

    joined = join_bounded(loc, materialize(offsets), ["_pid", *group_cols], max_rows=BROADCAST_ROWS)
    out = joined.withColumn("_pos", F.col("_lpos") + F.coalesce(F.col("_pos0"), F.lit(0)))
    drop = ["_lpos", "_pos0", "_pid"]
    if length_col:
        out = out.withColumn("_offset", F.col("_loff") + F.coalesce(F.col("_off0"), F.lit(0)))
        drop += ["_loff", "_off0"]
    return out.drop(*drop)
