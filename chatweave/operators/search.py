"""Nearest-neighbour search of query vectors among item vectors.

Exact top-k, blocked: the items of a group (a chat) are cut by hash into
blocks of about ``BLOCK_ITEMS``, its queries into buckets of about
``BUCKET_QUERIES``. Every (group, block, bucket) is one cogroup: a numpy block
product finds the items within rounding of the k nearest, whose distances are
then computed again term by term, and k rows per query leave the task. So a
query costs one row per block and k rows back, never a row per item, no task
holds more than a block and a bucket however large a chat is, and the result is
exact: sums run left to right in double, as a SQL fold does, and ties go to
the smaller item key. ``row_number() <= k`` per query and group merges the
blocks (with a partial group limit before the shuffle).

Metrics: ``l2``, and ``cosine`` on unit vectors, where a zero vector has
similarity 0 to everything; distance is then ``1 - similarity``. Only vectors
of one length are compared.

``lsh_topk`` is the approximate option: random projections cut into intervals;
a query is compared with the items that share an interval with it, by the same
blocked search within ``(group, projection, interval)``.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatweave.functions.vectors import normalise
from chatweave.session import join_bounded, materialize

BLOCK_ITEMS, BUCKET_QUERIES = 4096, 1024
_PAIR_VALUES = 1 << 22  # vector components of finalists held at once


@dataclass(frozen=True)
class VectorIndex:
    """Items with their block, and the number of blocks per group."""

    items: DataFrame  # group cols, _dim, item keys, _v, _block
    groups: DataFrame  # group cols, _dim, _blocks
    group_cols: tuple[str, ...]
    item_keys: tuple[str, ...]
    metric: str


def _prepared(df: DataFrame, vec_col: str, metric: str, *keep: str) -> DataFrame:
    v = normalise(vec_col) if metric == "cosine" else F.col(vec_col)
    out = df.select(*keep, v.cast("array<double>").alias("_v")).where(F.col("_v").isNotNull())
    stored = materialize(out.withColumn("_dim", F.size("_v")))
    # aliases, so that queries and items may come from one table
    return stored.select(*[F.col(c).alias(c) for c in stored.columns])


def _parts(df: DataFrame, by: list[str], size: int, name: str) -> DataFrame:
    """Per group, into how many parts of about ``size`` rows it is cut."""
    return materialize(df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name)))


def build_index(
    items: DataFrame,
    vec_col: str = "embedding",
    group_cols: tuple[str, ...] = ("chat_key",),
    item_keys: tuple[str, ...] = ("item_id",),
    metric: str = "l2",
    block_items: int = BLOCK_ITEMS,
) -> VectorIndex:
    by = [*group_cols, "_dim"]
    base = _prepared(items, vec_col, metric, *group_cols, *item_keys)
    groups = _parts(base, by, block_items, "_blocks")
    cut = join_bounded(base, groups, by, "inner")
    cut = cut.withColumn("_block", F.pmod(F.xxhash64(*item_keys), F.col("_blocks")).cast("int")).drop("_blocks")
    return VectorIndex(cut, groups, tuple(group_cols), tuple(item_keys), metric)


def _closest(k: int, metric: str):
    """Function of items and queries (a vector per row): the k nearest items of
    each query as (query, item, distance), ties to the earlier item."""

    def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        if not q.shape[1]:
            return np.zeros(len(q))
        if metric == "cosine":
            return 1.0 - np.cumsum(q * x, axis=1)[:, -1]
        d = q - x
        return np.sqrt(np.cumsum(d * d, axis=1)[:, -1])

    def rough(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A monotone stand-in for the distance and its rounding error."""
        if metric == "cosine":
            return 1.0 - q @ x.T, np.full(len(q), 1e-9)
        qq, xx = (q * q).sum(axis=1), (x * x).sum(axis=1)
        return qq[:, None] + xx[None, :] - 2 * (q @ x.T), 1e-9 * (qq + xx.max()) + 1e-300

    def closest(x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, cols, dist = [], [], []
        step = max(1, _PAIR_VALUES // (len(x) * max(1, x.shape[1])))
        for at in range(0, len(q), step):
            part = q[at:at + step]
            near, slack = rough(part, x)
            if len(x) > k:
                edge = np.partition(near, k - 1, axis=1)[:, k - 1]
                r, c = np.nonzero(near <= (edge + 2 * slack)[:, None])
            else:
                r, c = (i.ravel() for i in np.indices(near.shape))
            d = exact(part[r], x[c])
            order = np.lexsort((c, d, r))
            r, c, d = r[order], c[order], d[order]
            first = np.searchsorted(r, np.arange(len(part)))
            keep = np.arange(len(r)) - first[r] < k
            rows.append(r[keep] + at)
            cols.append(c[keep])
            dist.append(d[keep])
        return np.concatenate(rows), np.concatenate(cols), np.concatenate(dist)

    return closest


def _nearest(k: int, metric: str, query_key: str, keys: list[str], out: list[str]):
    """Cogroup function: the k nearest items of each query in one block."""
    closest = _closest(k, metric)

    def nearest(items: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if items.empty or queries.empty:
            return pd.DataFrame(columns=out)
        items = items.sort_values(keys, kind="stable").reset_index(drop=True)
        rows, cols, dist = closest(np.stack(items["_v"].to_numpy()), np.stack(queries["_v"].to_numpy()))
        found = items.iloc[cols].reset_index(drop=True)
        found[query_key] = queries[query_key].to_numpy()[rows]
        found["distance"] = dist
        return found[out]

    return nearest


def search(
    index: VectorIndex,
    queries: DataFrame,
    k: int = 10,
    vec_col: str = "embedding",
    query_key: str = "query_id",
    bucket_queries: int = BUCKET_QUERIES,
) -> DataFrame:
    """Top-k items per query within its group: ``(query_key, group cols,
    item keys, rank, distance)``; for cosine also ``similarity``. Queries are
    told apart by ``(query_key, group cols)``."""
    g, keys = list(index.group_cols), list(index.item_keys)
    by = [*g, "_dim"]
    q = _prepared(queries.dropDuplicates([query_key, *g]), vec_col, index.metric, query_key, *g)
    counts = _parts(q, by, bucket_queries, "_buckets")
    buckets = join_bounded(q, counts, by, "inner")
    asked = buckets.withColumn("_bucket", F.pmod(F.xxhash64(query_key), F.col("_buckets")).cast("int")).drop("_buckets")
    sent = join_bounded(asked, index.groups, by, "inner").withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    held = join_bounded(index.items, counts, by, "inner").withColumn("_bucket", F.explode(F.sequence(F.lit(0), F.col("_buckets") - 1)))
    item_fields = [index.items.schema[c] for c in [*g, *keys]]
    schema = T.StructType([T.StructField(query_key, q.schema[query_key].dataType), *item_fields, T.StructField("distance", T.DoubleType())])
    at = [*by, "_block", "_bucket"]
    found = (
        held.select(*at, *keys, "_v").groupBy(*at)
        .cogroup(sent.select(*at, query_key, "_v").groupBy(*at))
        .applyInPandas(_nearest(k, index.metric, query_key, keys, schema.names), schema)
    )
    rank = F.row_number().over(Window.partitionBy(query_key, *g).orderBy("distance", *keys))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k).select(query_key, *g, *keys, "rank", "distance")
    return best.withColumn("similarity", 1.0 - F.col("distance")) if index.metric == "cosine" else best


def topk(
    queries: DataFrame,
    items: DataFrame,
    k: int = 10,
    group_cols: tuple[str, ...] = ("chat_key",),
    item_keys: tuple[str, ...] = ("item_id",),
    query_key: str = "query_id",
    query_vec: str = "embedding",
    item_vec: str = "embedding",
    metric: str = "l2",
    block_items: int = BLOCK_ITEMS,
    bucket_queries: int = BUCKET_QUERIES,
) -> DataFrame:
    """Exact top-k (see module doc); ``metric`` is 'l2' or 'cosine'."""
    index = build_index(items, item_vec, group_cols, item_keys, metric, block_items)
    return search(index, queries, k, query_vec, query_key, bucket_queries)


# Random projections of the approximate search and their interval length.
PROJECTIONS, INTERVAL = 8, 0.5


def projection(table: int, dim: int) -> list[float]:
    """Coefficients in [-1, 1), from the MD5 of ``table:component``."""
    return [int(hashlib.md5(f"{table}:{j}".encode()).hexdigest()[:8], 16) / 2.0**31 - 1.0 for j in range(dim)]


def intervals(vec: Column, dim: int) -> Column:
    """``(_t, _b)`` per projection: its number and the vector's interval."""

    def one(t: int) -> Column:
        line = F.array(*[F.lit(c) for c in projection(t, dim)])
        terms = F.zip_with(vec, line, lambda x, c: x.cast("double") * c)
        total = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
        return F.struct(F.lit(t).alias("_t"), F.floor(total / INTERVAL).alias("_b"))

    return F.array(*[one(t) for t in range(PROJECTIONS)])


def lsh_topk(
    queries: DataFrame,
    items: DataFrame,
    dim: int,
    k: int = 10,
    group_cols: tuple[str, ...] = ("chat_key",),
    item_keys: tuple[str, ...] = ("item_id",),
    query_key: str = "query_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """Approximate top-k among items that share an interval with the query on
    some projection. Same output as ``topk``; recall below 1."""
    g, keys = list(group_cols), list(item_keys)

    def filed(df: DataFrame, *keep: str) -> DataFrame:
        return df.select(*keep, vec_col, F.explode(intervals(F.col(vec_col), dim)).alias("_x")).select(*keep, vec_col, "_x.*")

    near = topk(
        filed(queries, query_key, *g), filed(items, *g, *keys), k, (*g, "_t", "_b"), tuple(keys), query_key, vec_col, vec_col)
    once = near.drop("_t", "_b", "rank").dropDuplicates([query_key, *g, *keys])
    rank = F.row_number().over(Window.partitionBy(query_key, *g).orderBy("distance", *keys))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select(query_key, *g, *keys, "rank", "distance")
