"""A stored vector index that a search reads in part (K3, K5, A5).

``write_index`` lays items out in blocks of at most ``BLOCK_ITEMS`` vectors of
one group (a chat) that lie near each other, one row per block with packed
keys and vectors, and a block table: centre, radius and count of each block.

* A group larger than a block is split level by level: at most ``PIVOTS`` of
  its own items (those with the smallest key hash) are pivots, every item goes to
  the nearest, and cells that are still too large are split again. A cell
  that geometry cannot split (equal vectors) is cut by hash. Work per level is
  one pass over the items of too large cells, dealt out by cell and salt, so no
  task holds more than ``SALT_ITEMS`` of them however large a chat is.
* Blocks are range-partitioned by (group, cell) into shelves of about
  ``SHELF_BYTES``, one folder each: cells of one parent are neighbours, and a
  shelf without a needed block is not opened.
* Appended batches are folders of their own (``_batch=``), overwritten when
  a batch is run again.

``search_index`` is exact. For every query the nearest blocks that hold k items
are read first; their k-th distance bounds the rest: a block can only matter if
the least distance its centre and radius allow (triangle inequality; for
cosine the largest product) does not exceed it. Only such blocks are read,
each against the queries that need it. Distances of finalists are computed as
in :mod:`chatweave.operators.search`, so results equal ``topk`` bit for bit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatweave.operators.search import _closest, _parts, _prepared
from chatweave.session import join_bounded, materialize

BLOCK_ITEMS, PIVOTS, MAX_LEVELS, SALT_ITEMS = 4096, 64, 8, 65_536
SHELF_BYTES = 64 << 20
#: queries, and blocks of the block table, that one task compares
BUCKET_QUERIES, BUCKET_BLOCKS = 1024, 4096
#: rows that are handed to Python at once, as groups that are small (a chat with a
#: few items) cost more to hand over than to work on
LOT_ROWS = 2048
#: rows found that are handed back at once
FOUND_ROWS = 65_536
#: shelves named in a filter; beyond, all are listed and the join picks blocks
NAMED_SHELVES = 10_000
#: share by which bounds give way to rounding
SLACK = 1e-9


@dataclass(frozen=True)
class StoredIndex:
    """Where an index lies and how it is keyed."""

    path: str
    group_cols: tuple[str, ...]
    item_keys: tuple[str, ...]
    metric: str
    keys: T.StructType  # group columns and item keys

    def blocks_schema(self) -> T.StructType:
        packed = [T.StructField(c, T.ArrayType(self.keys[c].dataType)) for c in self.item_keys]
        return T.StructType([*(self.keys[c] for c in self.group_cols), *_BLOCK, *packed, T.StructField("_v", T.ArrayType(T.DoubleType())), *_PLACE, T.StructField("_shelf", T.IntegerType()), T.StructField("_batch", T.LongType())])

    def table_schema(self) -> T.StructType:
        return T.StructType([*(self.keys[c] for c in self.group_cols), *_BLOCK, *_PLACE, T.StructField("_shelf", T.IntegerType()), T.StructField("_batch", T.LongType())])

    def blocks(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.blocks_schema()).parquet(f"{self.path}/blocks")

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.table_schema()).parquet(f"{self.path}/table")


_BLOCK = [T.StructField("_dim", T.IntegerType()), T.StructField("_cell", T.LongType()), T.StructField("_part", T.IntegerType()), T.StructField("_n", T.IntegerType())]
_PLACE = [T.StructField("_centre", T.ArrayType(T.DoubleType())), T.StructField("_radius", T.DoubleType())]


def _lot(by: list[str], rows: int):
    """Deals whole groups into lots of about ``LOT_ROWS`` of ``rows`` rows."""
    return F.pmod(F.xxhash64(F.lit(4), *by), F.lit(max(1, -(-rows // LOT_ROWS))))


def _split(items: DataFrame, by: list[str], keys: list[str], block_items: int) -> DataFrame:
    """Items with ``_cell`` and ``_part``, no (cell, part) much above ``block_items``."""
    cells = items.withColumn("_cell", F.lit(1).cast("long"))
    at = [*by, "_cell"]
    done: list[DataFrame] = []
    for _ in range(MAX_LEVELS):
        sizes = materialize(cells.groupBy(*at).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > block_items))
        if not sizes.limit(1).count():
            break
        done.append(join_bounded(cells, sizes.select(*at), at, "left_anti"))
        large = join_bounded(cells, sizes, at, "inner")
        by_hash = Window.partitionBy(*at).orderBy(F.xxhash64(*keys), *keys)
        want = F.least(F.lit(PIVOTS), F.greatest(F.lit(2), F.ceil(2 * F.col("_size") / block_items)))
        pivots = large.withColumn("_nth", F.row_number().over(by_hash)).where(F.col("_nth") <= PIVOTS).where(F.col("_nth") <= want)
        pivots = materialize(pivots.select(*at, "_nth", F.col("_v").alias("_pivot"), F.ceil(F.col("_size") / SALT_ITEMS).cast("int").alias("_salts")))
        salted = large.withColumn("_salt", F.pmod(F.xxhash64(F.lit(1), *keys), F.ceil(F.col("_size") / SALT_ITEMS)).cast("int")).drop("_size")
        # aliases, as items and pivots come from one table
        pivots = pivots.select(*[F.col(c).alias(c) for c in pivots.columns])
        sent = pivots.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")

        def placed(some: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
            if some.empty:
                return some.drop(columns="_salt")
            x, p = np.stack(some["_v"].to_numpy()), np.stack(of.sort_values("_nth")["_pivot"].to_numpy())
            near = ((p * p).sum(axis=1)[None, :] - 2 * (x @ p.T)).argmin(axis=1)
            return some.assign(_cell=some["_cell"].to_numpy() * PIVOTS + near).drop(columns="_salt")

        schema = T.StructType([f for f in salted.schema.fields if f.name != "_salt"])
        cells = materialize(salted.groupBy(*at, "_salt").cogroup(sent.groupBy(*at, "_salt")).applyInPandas(placed, schema))
    out = cells
    for part in done:
        out = out.unionByName(part)
    # cells that could not be split that way are cut by hash
    counts = _parts(out, at, block_items, "_parts")
    cut = join_bounded(out, counts, at, "inner")
    return cut.withColumn("_part", F.pmod(F.xxhash64(F.lit(2), *keys), F.col("_parts")).cast("int")).drop("_parts")


def write_index(
    items: DataFrame,
    path: str,
    vec_col: str = "embedding",
    group_cols: tuple[str, ...] = ("chat_key",),
    item_keys: tuple[str, ...] = ("item_id",),
    metric: str = "l2",
    batch_id: int = 0,
    block_items: int = BLOCK_ITEMS,
) -> StoredIndex:
    """Write ``items`` as batch ``batch_id`` of the index at ``path``. Items
    without a vector are left out; vectors of different lengths lie apart."""
    spark, g, keys = items.sparkSession, list(group_cols), list(item_keys)
    base = _prepared(items, vec_col, metric, *g, *keys)
    by = [*g, "_dim"]
    index = StoredIndex(path.rstrip("/"), tuple(g), tuple(keys), metric, T.StructType([base.schema[c] for c in [*g, *keys]]))
    cut = _split(base, by, keys, block_items)
    names = [*g, "_dim", "_cell", "_part", "_n", *keys, "_v", "_centre", "_radius"]

    at = [*by, "_cell", "_part"]

    def packed(lot: pd.DataFrame) -> pd.DataFrame:
        lot = lot.sort_values(keys, kind="stable")
        columns, vectors, rows = {c: lot[c].to_numpy() for c in [*at, *keys]}, lot["_v"].to_numpy(), []
        for own in lot.groupby(at, sort=False).indices.values():
            x = np.stack(vectors[own]).reshape(len(own), -1)
            centre = x.mean(axis=0)
            radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1).max())) if x.shape[1] else 0.0
            rows.append([*(columns[c][own[0]] for c in at), len(own), *(columns[c][own].tolist() for c in keys), x.ravel().tolist(), centre.tolist(), radius])
        return pd.DataFrame(rows, columns=names)

    schema = T.StructType(index.blocks_schema().fields[:-2])
    blocks = materialize(cut.groupBy(_lot(at, base.count()).alias("_lot")).applyInPandas(packed, schema))
    size = blocks.agg(F.sum(F.col("_n") * (F.col("_dim") + len(keys)) * 8)).first()[0] or 0
    shelves = max(1, -(-int(size) // SHELF_BYTES))
    order = [*by, "_cell", "_part"]
    # a range partitioner samples anew each time it runs, so the shelf is written as data
    shelved = blocks.repartitionByRange(shelves, *order).sortWithinPartitions(*order).withColumn("_shelf", F.spark_partition_id())
    shelved.write.mode("overwrite").partitionBy("_shelf").parquet(f"{index.path}/blocks/_batch={int(batch_id)}")
    written = spark.read.schema(T.StructType(index.blocks_schema().fields[:-1])).parquet(f"{index.path}/blocks/_batch={int(batch_id)}")
    written.select(*index.table_schema().names[:-1]).write.mode("overwrite").parquet(f"{index.path}/table/_batch={int(batch_id)}")
    return index


def _bounds(metric: str, q: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least, middle and largest distance of each query to a block's items."""
    dots, lengths = q @ centres.T, np.sqrt((q * q).sum(axis=1))
    if metric == "cosine":
        middle, reach = 1.0 - dots, lengths[:, None] * radius[None, :]
        slack = SLACK
    else:
        sizes = np.sqrt((centres * centres).sum(axis=1))
        middle = np.sqrt(np.maximum(0.0, lengths[:, None] ** 2 + sizes[None, :] ** 2 - 2 * dots))
        # the root of a difference of squares keeps half of the digits
        reach, slack = np.broadcast_to(radius, middle.shape), np.sqrt(SLACK) * 1e-2 * (lengths[:, None] + sizes[None, :]) + SLACK * radius
    return middle - reach - slack, middle, middle + reach + slack


def _routes(metric: str, k: int, query_key: str, at: list[str], place: list[str], out: list[str]):
    """Cogroup function: the blocks of a piece of the block table that may hold
    one of a query's k nearest items, as far as the bounds can tell. A lot has
    the blocks and queries of many pieces (``at``)."""

    def routes(blocks: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if blocks.empty or queries.empty:
            return pd.DataFrame(columns=out)
        vectors, centres, radii = queries["_v"].to_numpy(), blocks["_centre"].to_numpy(), blocks["_radius"].to_numpy()
        counts, asking, parts = blocks["_n"].to_numpy(dtype=np.int64), queries.groupby(at, sort=False).indices, []
        for piece, own in blocks.groupby(at, sort=False).indices.items():
            if (those := asking.get(piece)) is None:
                continue
            q, n = np.stack(vectors[those]), counts[own]
            least, middle, most = _bounds(metric, q, np.stack(centres[own]).reshape(len(n), -1), radii[own])
            order = np.argsort(most, axis=1)
            enough = (np.cumsum(n[order], axis=1) >= k)
            last = np.where(enough.any(axis=1), enough.argmax(axis=1), len(n) - 1)
            edge = np.where(enough.any(axis=1), np.take_along_axis(most, np.take_along_axis(order, last[:, None], 1), 1)[:, 0], np.inf)
            r, b = np.nonzero(least <= edge[:, None])
            parts.append((those[r], own[b], least[r, b], middle[r, b], edge[r]))
        if not parts:
            return pd.DataFrame(columns=out)
        r, b, least, middle, edge = (np.concatenate(x) for x in zip(*parts))
        found = blocks[place].iloc[b].reset_index(drop=True)
        found[query_key] = queries[query_key].to_numpy()[r]
        found["_least"], found["_middle"], found["_edge"], found["_n"] = least, middle, edge, counts[b]
        return found[out]

    return routes


def search_index(
    index: StoredIndex, queries: DataFrame, k: int = 10, vec_col: str = "embedding", query_key: str = "query_id", report: dict | None = None
) -> DataFrame:
    """Exact top-k of a stored index: the columns of ``search``. ``report`` gets
    the numbers of (query, block) pairs there are and were read, and of blocks."""
    spark, g, keys = queries.sparkSession, list(index.group_cols), list(index.item_keys)
    by, place = [*g, "_dim"], [*g, "_dim", "_cell", "_part", "_batch"]
    asked = [query_key, *g, "_dim"]
    q = _prepared(queries.dropDuplicates([query_key, *g]), vec_col, index.metric, query_key, *g)
    table = index.table(spark)
    buckets, chunks = _parts(q, by, BUCKET_QUERIES, "_buckets"), _parts(table, by, BUCKET_BLOCKS, "_chunks")
    sent = join_bounded(join_bounded(q, buckets, by, "inner"), chunks, by, "inner")
    sent = sent.withColumn("_bucket", F.pmod(F.xxhash64(query_key), F.col("_buckets")).cast("int")).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    held = join_bounded(join_bounded(table, buckets, by, "inner"), chunks, by, "inner")
    held = held.withColumn("_chunk", F.pmod(F.xxhash64("_cell", "_part", "_batch"), F.col("_chunks")).cast("int")).withColumn("_bucket", F.explode(F.sequence(F.lit(0), F.col("_buckets") - 1)))
    at = [*by, "_chunk", "_bucket"]
    held = held.select(*[F.col(c).alias(c) for c in held.columns])
    fields = [q.schema[query_key], *(table.schema[c] for c in place), *(T.StructField(c, T.DoubleType()) for c in ("_least", "_middle", "_edge")), T.StructField("_n", T.IntegerType())]
    schema = T.StructType(fields)
    lot = _lot(at, held.count() + sent.count()).alias("_lot")
    routes = (
        held.select(*at, "_cell", "_part", "_batch", "_centre", "_radius", "_n").groupBy(lot)
        .cogroup(sent.select(*at, query_key, "_v").groupBy(lot))
        .applyInPandas(_routes(index.metric, k, query_key, at, place, schema.names), schema)
    )
    near = Window.partitionBy(*asked).orderBy("_middle", "_cell", "_part", "_batch").rowsBetween(Window.unboundedPreceding, -1)
    edge = F.min("_edge").over(Window.partitionBy(*asked))
    routes = materialize(routes.withColumns({"_edge": edge, "_first": F.coalesce(F.sum("_n").over(near), F.lit(0)) < k}).where("_first OR _least <= _edge").drop("_edge", "_n", "_middle"))
    first = materialize(_read(index, routes.where("_first"), q, k, query_key))
    worst = first.groupBy(*asked).agg(F.count(F.lit(1)).alias("_held"), F.sort_array(F.collect_list("distance")).alias("_d"))
    worst = worst.select(*asked, F.when(F.col("_held") >= k, F.element_at("_d", k)).otherwise(float("inf")).alias("_worst"))
    later = materialize(routes.where("NOT _first").join(worst, asked).where("_least <= _worst").select(*routes.columns))
    found = first
    if later.limit(1).count():
        found = found.unionByName(_read(index, later, q, k, query_key))
    found = found.drop("_dim")
    if report is not None:
        read = routes.where("_first").unionByName(later)
        report.update(
            blocks=table.count(), pairs=join_bounded(q, table.groupBy(*by).count(), by, "inner").agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0],
            pairs_read=read.count(), blocks_read=read.select(*place).distinct().count())
    rank = F.row_number().over(Window.partitionBy(query_key, *g).orderBy("distance", *keys))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k).select(query_key, *g, *keys, "rank", "distance")
    return best.withColumn("similarity", 1.0 - F.col("distance")) if index.metric == "cosine" else best


def _read(index: StoredIndex, routes: DataFrame, q: DataFrame, k: int, query_key: str) -> DataFrame:
    """(query, group, dim, item keys, distance): the k nearest items of each
    (query, block) of ``routes``. Only the shelves of these blocks are opened."""
    spark, g, keys = q.sparkSession, list(index.group_cols), list(index.item_keys)
    place = [*g, "_dim", "_cell", "_part", "_batch"]
    blocks = index.blocks(spark)
    shelves = join_bounded(index.table(spark).select(*place, "_shelf"), materialize(routes.select(*place).distinct()), place, "left_semi").select("_batch", "_shelf").distinct()
    named = shelves.limit(NAMED_SHELVES + 1).collect()
    if len(named) <= NAMED_SHELVES:
        of: dict[int, list[int]] = {}
        for r in named:
            of.setdefault(r["_batch"], []).append(r["_shelf"])
        terms = [(F.col("_batch") == b) & F.col("_shelf").isin(s) for b, s in of.items()]
        only = F.lit(False)
        for t in terms:
            only = only | t
        blocks = blocks.where(only)
    # the queries of a block, in packets
    packet = F.pmod(F.xxhash64(F.lit(3), query_key), F.ceil(F.count(F.lit(1)).over(Window.partitionBy(*place)) / BUCKET_QUERIES)).cast("int")
    asked = routes.select(query_key, *place).withColumn("_packet", packet).join(q, [query_key, *g, "_dim"])
    packets = materialize(asked.groupBy(*place, "_packet").agg(F.collect_list(F.struct(F.col(query_key).alias("q"), F.col("_v").alias("v"))).alias("_asked")))
    rows = join_bounded(blocks, packets, place, "inner", max_rows=32)
    names = [query_key, *g, "_dim", *keys, "distance"]
    schema = T.StructType([q.schema[query_key], *(index.keys[c] for c in g), q.schema["_dim"], *(index.keys[c] for c in keys), T.StructField("distance", T.DoubleType())])
    closest = _closest(k, index.metric)

    def table_of(parts) -> pd.DataFrame:
        return pd.DataFrame({c: np.concatenate([p[i] for p in parts]) for i, c in enumerate(names)})

    def run(batches):
        for batch in batches:
            parts, held = [], 0
            for row in batch.to_dict("records"):
                # a block's items lie in the order of their keys
                x = np.asarray(row["_v"], dtype=np.float64).reshape(row["_n"], row["_dim"])
                asked = np.empty(len(row["_asked"]), dtype=object)
                asked[:] = [a["q"] for a in row["_asked"]]
                r, c, distance = closest(x, np.stack([np.asarray(a["v"], dtype=np.float64) for a in row["_asked"]]))
                same = [np.full(len(r), row[name], dtype=object) for name in [*g, "_dim"]]
                parts.append([asked[r], *same, *(np.asarray(row[key])[c] for key in keys), distance])
                held += len(r)
                if held >= FOUND_ROWS:
                    yield table_of(parts)
                    parts, held = [], 0
            if parts:
                yield table_of(parts)

    return rows.select(*g, "_dim", "_n", *keys, "_v", "_asked").mapInPandas(run, schema)
