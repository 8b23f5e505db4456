"""Operator 7: mixing sources to target weights along a curriculum.

Targets. Sources in code point order (null last) weigh 1, 2, 3, repeating, and
share the corpus size; no target exceeds ``MOST_EPOCHS`` times its source's
size, and what is cut off goes to the others by weight (water filling: sources
are cut in the order of cap / weight, so one pass over the sorted sources
finds them all).

Curriculum. A source's weight over training time is a piecewise linear curve
with the target as its integral. Its documents stand in hash order; every
epoch walks through them once more. The word demand at which a copy's middle
comes up is inverted through the integrated curve, which gives the copy's
training position in [0, 1). Copies whose middle lies beyond the target are
not taken, so a source's taken words differ from its target by at most half a
document. ``in_order`` and ``mix`` return the copies, range-sorted by position.

Running sums never put a source in one task: documents are cut into hash
ranges sized by the row count, ranges are summed before the shuffle, and only
within a range (a share of one source) are rows sorted.

Defined results: null and empty texts have size 0 and are not taken; a null
source is a source of its own; rows without id are ordered by their text;
repeated rows are rows of their own (equal rows are taken in any order);
an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chatweave.llm.common import join_small, stored

WEIGHTS, MOST_EPOCHS = (1, 2, 3), 3
RANGE_ROWS, LEAST_RANGES = 20_000, 64
WORD = r"[^\x20\x09-\x0D]+"

#: weight -> knots (time, relative weight): light sources early, heavy ones late
CURVES: dict[int, list[tuple[float, float]]] = {
    1: [(0.0, 1.5), (1.0, 0.5)],
    2: [(0.0, 1.0), (1.0, 1.0)],
    3: [(0.0, 0.5), (0.5, 1.0), (1.0, 1.5)],
}


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def rank_of(doc_id: Column, text: Column) -> Column:
    """60 bits of md5 of the id (of the text where there is no id)."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.concat(F.lit("t"), F.coalesce(text, F.lit(""))))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """sizes: (source, source_size), a row per source. Adds weight and target."""
    one = W.partitionBy(F.lit(0))
    ordered = sizes.withColumn("_k", F.row_number().over(one.orderBy(F.asc_nulls_last("source"))))
    pick = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.col("_k") - 1) % len(WEIGHTS) + 1).cast("int"))
    capped = ordered.withColumn("weight", pick).withColumn("_cap", (MOST_EPOCHS * F.col("source_size")).cast("double"))
    by = one.orderBy(F.col("_cap") / F.col("weight"), "_k")
    level = (F.sum("source_size").over(one) - F.coalesce(F.sum("_cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing))
    levels = capped.withColumn("_level", level)
    # before the first source that stays below its cap all are cut off
    at = F.min(F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("weight"), "_k", "_level"))).over(one)
    final = levels.withColumn("_final", at["_level"])
    return final.select("source", "source_size", "weight", F.coalesce(F.least("_cap", F.col("_final") * F.col("weight")), "_cap").alias("target"))


def position(share: Column, weight: Column, curves=CURVES) -> Column:
    """Training time at which the integrated curve of ``weight`` reaches
    ``share`` of its total."""
    out = share
    for w, knots in curves.items():
        pieces, total = [], 0.0
        for (t0, a), (t1, b) in zip(knots, knots[1:]):
            pieces.append((t0, t1 - t0, a, b, total))
            total += (t1 - t0) * (a + b) / 2
        at = None
        for t0, h, a, b, done in pieces:
            r = share * total - done
            inside = F.lit(t0) + 2 * r / (a + F.sqrt(F.greatest(F.lit(0.0), a * a + 2 * (b - a) / h * r)))
            at = inside if at is None else F.when(share * total >= done, inside).otherwise(at)
        out = F.when(weight == w, at).otherwise(out)
    return out


def assign(docs: DataFrame, keep: list[str], doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Columns ``keep`` packed in ``_doc``, with size, source_size, target,
    taken (words), copies, and positions (an array, one per copy)."""
    rows = docs.select(
        F.struct(*keep).alias("_doc"), F.col(doc_id).alias("_id"), F.col(source).alias("source"),
        size_of(F.col(text)).alias("size"), rank_of(F.col(doc_id), F.col(text)).alias("_rank"),
    ).withColumn("_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    if not any(c == text for c in keep):  # light rows are read once
        rows = stored(rows, "sizes")
    light = stored(rows.select("source", "_key", "size", "_rank"), "ranks")
    ranges = max(LEAST_RANGES, -(-light.count() // RANGE_ROWS))
    part = F.expr(f"_rank div {-(-(1 << 60) // ranges)}")
    sums = stored(light.groupBy("source", "_key", part.alias("_part")).agg(F.sum("size").alias("n")), "sums")
    goal = stored(targets(sums.groupBy("source").agg(F.sum("n").alias("source_size"))), "targets")
    before = F.coalesce(F.sum("n").over(W.partitionBy("_key").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = sums.select("source", "_key", "_part", before.alias("_base"))
    bases = stored(bases.join(goal, bases["source"].eqNullSafe(goal["source"])).drop("source"), "bases")
    inner = W.partitionBy("_key", "_part").orderBy("_rank", "_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = join_small(rows.withColumn("_part", part), bases, ["_key", "_part"], "inner")
    middle = F.col("_base") + F.coalesce(F.sum("size").over(inner), F.lit(0)) + F.col("size") / 2
    placed = placed.withColumn("_middle", middle)
    demands = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(MOST_EPOCHS - 1)), lambda e: F.col("_middle") + e * F.col("source_size")),
        lambda d: (d < F.col("target")) & (F.col("size") > 0),
    )
    placed = placed.withColumn("_demands", demands).withColumn("copies", F.size("_demands").cast("long"))
    where = F.transform("_demands", lambda d: position(d / F.col("target"), F.col("weight")))
    return placed.select("_doc", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", where.alias("positions"))


def in_order(assigned: DataFrame) -> DataFrame:
    """The rows of ``assign`` once for each taken copy, range-sorted by
    position, the copy's training time."""
    copies = assigned.select(*[c for c in assigned.columns if c != "positions"], F.explode("positions").alias("position"))
    return copies.repartitionByRange("position").sortWithinPartitions("position")


def mix(docs: DataFrame, keep: list[str], position: bool = True, **names: str) -> DataFrame:
    """A row per taken copy, in training order: columns ``keep`` and, unless it
    is not wanted, position."""
    copies = assign(docs, keep, **names).select("_doc", "positions")
    return in_order(copies).select("_doc.*", *["position"] * position)
