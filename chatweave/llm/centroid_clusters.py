"""Operator 13: exact Lloyd clustering with heap-ordered bounds.

Components become integers (floor(scale * x)), centroids stay integers (floor of
the mean), so every distance, tie and centroid is exact.

Bounds. When a vector is scanned, its gap is the distance to the second
nearest centroid less that to its own. Until the own centroid's and the largest
other centroid's drifts have added up to the gap, the vector cannot change its
cluster. So each cluster has an ``offset``, the sum of these drifts since the
first round, and keeps its vectors in a heap ordered by gap + offset at the time
of the scan. In a round only the vectors whose key the offset has reached are
popped and scanned against all centroids again; they go to the heap of the
cluster they fall to. Keys are lowered, and drifts raised, by more than
rounding can amount to, so a popped vector may keep its cluster, but none that
is not popped could change.

In Spark a heap is a set of stored runs sorted by (cluster, key), one per
round: entries are never rewritten. Offsets only grow, so what a round pops are the
entries with a key between the cluster's last offset and its present one, a
range that prunes the runs' row groups; an entry is live while its key is above
the offset. Vectors lie in a table bucketed by row, so a popped row (20 bytes)
goes to its vector, not the vector to the row. Sums per cluster change by the
vectors that move only: a task gives one row of sums per cluster it touched.
The driver holds k centroids.

Defined results: a vector that is null, has another number of components, or
holds a null or a non-finite one takes no part; a row without id is clustered but
never a first centroid; rows that share an id are vectors of their own; if
fewer than k vectors have an id, all of them are first centroids, and an empty
table (or one without ids) gives an empty table; a cluster without vectors
keeps its centroid; other columns are left alone. Sums are exact within 38
digits; a distance or inertia beyond 64 bits is null.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatweave.llm.common import join_small, stored
from chatweave.operators.sequence import default_partitions
from chatweave.session import checkpoint_root, scratch_path

K, ROUNDS, WIDTH, SCALE, SEED = 8, 10, 64, 1024, "3"
SLACK = 1e-12  #: share by which bounds are widened against rounding
#: popped rows are broadcast up to so many (16 bytes each)
FEW_ROWS = 500_000


def scaled(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), whole numbers held as doubles."""
    return np.floor(scale * values.astype(np.float64))


def squared(x: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Exact squared distances of whole-number rows to all centroids, in 64 bits
    where they fit, else as Python integers."""
    most = max([abs(c) for row in centroids for c in row], default=0)
    most = max(most, int(np.abs(x).max(initial=0)))
    bound = 4 * most * most * max(1, x.shape[1])
    if bound < 1 << 63:
        kind = np.float64 if bound < 1 << 53 else np.int64
        x, c = x.astype(kind), np.array(centroids, dtype=np.int64).astype(kind)
        return ((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * (x @ c.T)).astype(np.int64)
    wide = np.array([[int(v) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)
    return np.array([[sum((a - b) ** 2 for a, b in zip(row, c)) for c in centroids] for row in wide], dtype=object)


def root(values: np.ndarray) -> np.ndarray:
    return np.sqrt(values.astype(np.float64))


def nearest(distance: np.ndarray, offsets: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, heap key) of each row of exact distances."""
    own = distance.argmin(axis=1)  # the first of equal ones
    at = np.asarray(offsets)[own]
    if distance.shape[1] == 1:
        return own, np.full(len(own), np.inf)
    least = root(distance[np.arange(len(own)), own])
    others = distance.copy()
    others[np.arange(len(own)), own] = others.max() + 1
    second = root(others.min(axis=1))
    key = at + (second - least) - SLACK * (second + least + at)
    return own, np.maximum(key, np.nextafter(at, np.inf))  # an entry lies above the offset it is pushed at


def advanced(offsets: list[float], old: list[list[int]], new: list[list[int]]) -> list[float]:
    """Offsets after the centroids moved: own drift and largest other drift."""
    drift = [math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y))) * (1 + SLACK) for x, y in zip(old, new)]
    rest = [max((d for j, d in enumerate(drift) if j != i), default=0.0) for i in range(len(drift))]
    return [o + (d + r) * (1 + SLACK) if d + r else o for o, d, r in zip(offsets, drift, rest)]


def rows_of(batch, name: str = "v") -> np.ndarray:
    values = batch[name].flatten().to_numpy(zero_copy_only=False)
    return values.reshape(batch.num_rows, -1)


class Vectors:
    """Vectors in a table bucketed by row number, in the scratch folder."""

    def __init__(self, vectors: DataFrame, vec_id: str, vector: str, width: int):
        spark = vectors.sparkSession
        checkpoint_root(spark)
        v = F.col(vector)
        odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        kept = vectors.select(F.col(vec_id).alias("id"), v.alias("v")).where(v.isNotNull() & (F.size(v) == width) & ~odd)
        numbered = stored(kept.withColumn("row", F.monotonically_increasing_id()), "vectors")
        self.n = default_partitions(numbered)
        self.name = f"vectors_{uuid.uuid4().hex}"
        dealt = numbered.repartition(self.n, "row")
        dealt.write.bucketBy(self.n, "row").sortBy("row").option("path", scratch_path(spark, "bucketed")).option("compression", "zstd").saveAsTable(self.name)
        self.table = spark.table(self.name)

    def drop(self, spark: SparkSession) -> None:
        spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def first(self, k: int, seed: str) -> list[list[float]]:
        by = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
        rows = self.table.where("id IS NOT NULL").select(by.alias("h"), "v").orderBy("h", "v").limit(k).collect()
        return [list(r.v) for r in rows]

    def beside(self, rows: DataFrame) -> DataFrame:
        """(row, v, before) of the rows of (row, cluster)."""
        few = rows.limit(FEW_ROWS + 1).count() <= FEW_ROWS
        rows = rows.select("row", F.col("cluster").alias("before"))
        return self.table.select("row", "v").join(F.broadcast(rows) if few else rows, "row")


ENTRY = "kind int, row long, cluster int, key double, n long, sums array<string>"


def scanned(rows: DataFrame, centroids: list[list[int]], offsets: list[float], scale: int) -> DataFrame:
    """Heap entries (kind 0: row, cluster, key) of the rows of (row, v, before),
    and what their moves add to the clusters (kind 1: cluster, n, sums)."""

    def run(batches):
        k, d = len(centroids), len(centroids[0])
        count, sums = np.zeros(k, dtype=np.int64), np.zeros((k, d), dtype=object)
        schema = pa.schema([("kind", pa.int32()), ("row", pa.int64()), ("cluster", pa.int32()), ("key", pa.float64()), ("n", pa.int64()), ("sums", pa.list_(pa.string()))])
        for batch in batches:
            if not batch.num_rows:
                continue
            x = scaled(rows_of(batch), scale)
            own, key = nearest(squared(x, centroids), offsets)
            before = batch["before"].to_numpy()
            exact = x.astype(np.int64) if np.abs(x).max(initial=0) < 2.0**40 else np.array([[int(v) for v in r] for r in x.tolist()], dtype=object)
            for j in range(k):
                came, left = (own == j) & (before != j), (own != j) & (before == j)
                count[j] += int(came.sum()) - int(left.sum())
                sums[j] += exact[came].sum(axis=0).astype(object) - exact[left].sum(axis=0).astype(object)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), batch["row"], pa.array(own.astype(np.int32)), pa.array(key), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.string()))], schema=schema)
        touched = [j for j in range(k) if count[j] or any(sums[j])]
        if touched:
            m = len(touched)
            yield pa.RecordBatch.from_arrays([pa.array([1] * m, pa.int32()), pa.nulls(m, pa.int64()), pa.array(touched, pa.int32()), pa.nulls(m, pa.float64()), pa.array(count[touched]), pa.array([[str(v) for v in sums[j]] for j in touched], pa.list_(pa.string()))], schema=schema)

    return rows.mapInArrow(run, ENTRY)


class Heaps:
    """The clusters' heaps: a stored run per round."""

    def __init__(self) -> None:
        self.runs: list[DataFrame] = []

    def push(self, entries: DataFrame) -> DataFrame:
        run = stored(entries.sortWithinPartitions("kind", "cluster", "key"), "heap")
        self.runs.append(run.where("kind = 0").select("row", "cluster", "key"))
        return run

    def between(self, low: list[float], high: list[float] | None) -> DataFrame:
        """Entries with a key above ``low`` and, if given, up to ``high``."""
        ranges = [
            f"(cluster = {c} AND key > {low[c]!r}D" + (f" AND key <= {high[c]!r}D)" if high else ")")
            for c in range(len(low)) if high is None or high[c] > low[c]
        ]
        found = [r.where(" OR ".join(ranges) or "false").select("row", "cluster") for r in self.runs]
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out


def changes(run: DataFrame, k: int, width: int) -> tuple[list[int], list[list[int]]]:
    """What a run adds to the clusters' counts and sums (k x width numbers)."""
    deltas = run.where("kind = 1").select("cluster", "n", F.posexplode("sums").alias("i", "s"))
    totals = deltas.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    count, sums = [0] * k, [[0] * width for _ in range(k)]
    for r in totals:
        count[r.cluster], sums[r.cluster][r.i] = int(r.n), int(r.s)
    return count, sums


def distances(rows: DataFrame, centroids: list[list[int]], scale: int) -> DataFrame:
    """(id, cluster, distance as text) of rows of (id, v, cluster)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cluster = batch["cluster"].to_numpy()
                d = squared(scaled(rows_of(batch), scale), centroids)[np.arange(batch.num_rows), cluster]
                yield pa.RecordBatch.from_arrays([batch["id"], batch["cluster"], pa.array([str(v) for v in d.tolist()], pa.string())], names=["id", "cluster", "d"])

    return rows.select("id", "v", "cluster").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, cluster int, d string")


def cluster(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding",
    k: int = K, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: str = SEED, report: list | None = None,
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256
    of every vector that takes part. ``report`` gets the scanned rows of each
    round."""
    spark = vectors.sparkSession
    held = Vectors(vectors, vec_id, vector, width)
    try:
        centroids = [[int(v) for v in scaled(np.array(row), scale)] for row in held.first(k, seed)]
        k = len(centroids)
        offsets, count, sums = [0.0] * k, [0] * k, [[0] * width for _ in range(k)]
        heaps, before = Heaps(), None
        for turn in range(rounds + 1 if k else 0):
            if before is None:
                due = held.table.select("row", "v", F.lit(-1).alias("before"))
            elif before == offsets:
                break  # no centroid has moved: nothing can change any more
            else:
                due = held.beside(heaps.between(before, offsets))
            run = heaps.push(scanned(due, centroids, offsets, scale))
            if report is not None:
                report.append(run.where("kind = 0").count())
            if turn == rounds:
                before = offsets
                break
            more, added = changes(run, k, width)
            count = [a + b for a, b in zip(count, more)]
            sums = [[a + b for a, b in zip(x, y)] for x, y in zip(sums, added)]
            moved = [[s // n for s in row] if n else old for row, n, old in zip(sums, count, centroids)]
            before, offsets = offsets, advanced(offsets, centroids, moved)
            centroids = moved
        if k:
            live = heaps.between(offsets, None)
            rows = held.table.join(live, "row")
        else:
            rows = held.table.limit(0).withColumn("cluster", F.lit(0))
        placed = stored(distances(rows, centroids or [[0] * width], scale).withColumn("d", F.col("d").cast("decimal(38,0)")), "placed")
    finally:
        held.drop(spark)
    names = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids)]
    per = placed.groupBy("cluster").agg(F.sum("d").alias("_c"))
    per = stored(per.join(F.broadcast(spark.createDataFrame(names, "cluster int, centroid_sha256 string")), "cluster"), "inertia")
    total = per.agg(F.sum("_c").alias("_t"))
    out = join_small(placed, per.crossJoin(F.broadcast(total)), ["cluster"], "inner")
    long = lambda c: F.expr(f"try_cast({c} AS bigint)")
    return out.select(F.col("id").alias(vec_id), "cluster", long("d").alias("distance"), long("_c").alias("cluster_inertia"), long("_t").alias("inertia"), "centroid_sha256")
