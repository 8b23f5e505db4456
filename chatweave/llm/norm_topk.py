"""Operator 10: exact top-k by inner product over norm-sorted blocks.

Vectors are cut into blocks by descending length: quantiles of the length,
and a hash where one length is too frequent, so a block is bounded for any
data. In a block, vectors are rotated by the eigenvectors of the second moment
matrix (from a bounded sample; any rotation gives the right result), so the
first few coordinates carry most of an inner product. The blocks of the longest
vectors give every query a threshold: its k-th best score so far. For the
others, a block is not sent to queries whose threshold its longest vector
cannot reach; then the vectors too short for a query's threshold are left out,
and partial sums over a few coordinates plus the Cauchy-Schwarz bound on the
residuals leave out most others. What remains gets its exact integer score.

Queries go to blocks in packets of ``PACKET``; a block gives back at most k
rows per query, so nothing of the size queries x vectors is ever written.

Defined results: a vector that is null, or holds a null or a non-finite
component, takes no part; a null id takes no part; vectors are compared within
one length only; ties go to the smaller id; repeated rows are separate
candidates, and no row whose id is the query's own is its candidate; equal
query rows give one result; an empty table gives an empty table. Sums are
exact while they fit 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chatweave.llm.common import join_small, stored

K, SCALE = 10, 1024
BLOCK, PACKET, SAMPLE = 4096, 256, 4096
HEAD = 0.25  #: share of rotated coordinates in each partial sum


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component; null if the vector takes no part."""
    x = F.transform(vector, lambda v: v.cast("double"))
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(vector.isNotNull() & ~odd, F.transform(x, lambda v: F.floor(v * scale)))


def rotation(sample: list[list[int]], width: int) -> np.ndarray:
    if not sample or not width:
        return np.eye(width)
    m = np.array(sample, dtype=np.float64)
    return np.linalg.eigh(m.T @ m)[1][:, ::-1].copy()


class Block:
    """Vectors of one block by descending length."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, turn: np.ndarray):
        norm = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))
        order = np.lexsort((ids, -norm))
        self.ids, self.rows, self.norm = ids[order], rows[order], norm[order]
        self.turned = self.rows.astype(np.float64) @ turn
        width = rows.shape[1]
        step = max(1, int(width * HEAD))
        self.cuts = [*range(step, width, step)]
        self.rest = [np.sqrt((self.turned[:, c:] ** 2).sum(axis=1)) for c in self.cuts]

    def best(self, query: np.ndarray, own: int, turned: np.ndarray, floor: float, k: int):
        """Ids and exact scores of the (at most) k best with a score >= floor,
        the query's own id left out, and ties to the smaller id."""
        length = float(np.sqrt((turned**2).sum()))
        slack = 1e-6 + 1e-9 * length * (float(self.norm[0]) if len(self.norm) else 0.0)
        if floor == -np.inf:
            live = np.arange(len(self.ids))
        else:  # the first so many are long enough
            n = len(self.norm) if floor <= 0 else int(np.searchsorted(-self.norm * length, -(floor - slack), side="right"))
            live = np.arange(n)
        part, done = np.zeros(len(live)), 0
        if floor > -np.inf:
            for c, rest in zip(self.cuts, self.rest):
                part = part + self.turned[live, done:c] @ turned[done:c]
                left = float(np.sqrt((turned[c:] ** 2).sum()))
                ok = part + rest[live] * left >= floor - slack
                live, part, done = live[ok], part[ok], c
        live = live[self.ids[live] != own]
        score = self.rows[live] @ query
        order = np.lexsort((self.ids[live], -score))[:k]
        order = order[score[order] >= floor]
        return self.ids[live][order], score[order]


def _matrix(column, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten()).astype(np.int64).reshape(len(flat), width)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best vectors."""
    spark = vectors.sparkSession

    def prepared(df: DataFrame, name: str) -> DataFrame:
        v = scaled(F.col(vector), scale)
        rows = df.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
        norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
        return stored(rows.withColumn("d", F.size("v")).withColumn("norm", F.sqrt(norm)), name)

    rows = prepared(vectors, "vectors")
    distinct = stored(prepared(queries, "queries").dropDuplicates(["id", "v"]), "distinct")
    packets = max(1, -(-distinct.count() // PACKET))
    asked = distinct.withColumn("packet", F.pmod(F.xxhash64(F.lit(10), "id"), F.lit(packets)))
    # blocks: length quantiles, then a hash where a quantile holds more than a block
    total = rows.count()
    cells = max(1, min(10_000, -(-total // block)))
    cuts = sorted(set(rows.agg(F.percentile_approx("norm", [i / cells for i in range(1, cells)] or [0.5], 10_000)).first()[0] or []), reverse=True)
    cell = F.expr(f"size(filter(array({','.join(f'{c!r}D' for c in cuts)}), c -> c > norm))") if cuts else F.lit(0)
    rows = rows.withColumn("cell", cell)
    sizes = stored(rows.groupBy("d", "cell").agg(F.count("*").alias("n"), F.max("norm").alias("most")), "cells")
    slices = F.greatest(F.lit(1), F.ceil(F.col("n") / block)).cast("int")
    cellwise = join_small(rows, sizes, ["d", "cell"], "inner")
    filed = cellwise.select("id", "v", "d", "cell", F.pmod(F.xxhash64("id", "v"), slices).cast("int").alias("slice"))
    blocks = sizes.withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1)))
    widths = [r["d"] for r in sizes.select("d").distinct().limit(1001).collect()][:1000]
    turns = {}
    for d in widths:
        some = rows.where(F.col("d") == d).select("v").orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE)
        turns[d] = rotation([r["v"] for r in some.collect()], d)
    held = spark.sparkContext.broadcast(turns)

    def scores(targets: DataFrame, thresholds: DataFrame) -> DataFrame:
        """targets: (d, cell, slice, packet) pairs of block and packet."""
        known = asked.join(thresholds.withColumnRenamed("query_id", "id"), "id", "left")
        packed = known.groupBy("d", "packet").agg(F.collect_list(F.struct("id", "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))).alias("q"))
        sent = targets.join(packed, ["d", "packet"]).select("d", "cell", "slice", "q")

        def search(key, own: pa.Table, sent: pa.Table) -> pa.Table:
            d, out = key[0].as_py(), {"query_id": [], "id": [], "score": []}
            if own.num_rows and sent.num_rows:
                turn = held.value.get(d, np.eye(d))
                one = Block(own["id"].to_numpy(), _matrix(own["v"], d), turn)
                for packet in sent["q"]:
                    for q in packet.as_py():
                        v = np.array(q["v"], dtype=np.int64)
                        ids, score = one.best(v, q["id"], v.astype(np.float64) @ turn, q["floor"], k)
                        out["query_id"] += [q["id"]] * len(ids)
                        out["id"] += ids.tolist()
                        out["score"] += score.tolist()
            return pa.table({c: pa.array(x, pa.int64()) for c, x in out.items()})

        by = ["d", "cell", "slice"]
        return filed.groupBy(*by).cogroup(sent.groupBy(*by)).applyInArrow(search, "query_id long, id long, score long")

    nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    heads = asked.groupBy("d", "packet").agg(F.max("norm").alias("longest"))
    none = spark.createDataFrame([], "query_id long, floor double")
    first = blocks.join(blocks.groupBy("d").agg(F.min("cell").alias("cell")), ["d", "cell"], "left_semi")
    seeds = stored(scores(first.join(heads, "d").select("d", "cell", "slice", "packet"), none), "seeds")
    ranked = seeds.withColumn("rank", nth).where(F.col("rank") <= k)
    floors = stored(ranked.where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("floor")), "floors")
    # a block is sent to a packet if its longest vector can reach the packet's lowest threshold
    least = asked.join(floors.withColumnRenamed("query_id", "id"), "id", "left").groupBy("d", "packet").agg(F.min(F.coalesce("floor", F.lit(float("-inf")))).alias("least"), F.max("norm").alias("longest"))
    others = blocks.join(first.select("d", "cell", "slice"), ["d", "cell", "slice"], "left_anti").join(least, "d").where(F.col("most") * F.col("longest") * (1 + 1e-9) + 1e-6 >= F.col("least"))
    rest = scores(others.select("d", "cell", "slice", "packet"), floors)
    merged = ranked.select("query_id", "id", "score").unionByName(rest).withColumn("rank", nth).where(F.col("rank") <= k)
    return merged.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
