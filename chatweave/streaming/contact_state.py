"""Contact handles kept up to date by deltas.

The containment join of all handles with all contact addresses costs in
proportion to both. A load brings few new handles and few new addresses, so
their pairs are kept: with each update, new handles meet the addresses known
before, and new addresses meet all handles. A handle whose id text changed
counts as new; pairs are kept by (row id, text) and by address, so what was
removed or changed falls out when the pairs are joined with the present tables.

State is a folder per update (``batch_id=``): pairs first, then the handles and
addresses they cover. A break between them makes the next update find the same
pairs again (they count once); an update run again replaces its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatweave.operators.addresses import valid_addresses
from chatweave.operators.containment import containment_join
from chatweave.session import materialize
from chatweave.sources import sinks
from chatweave.streaming.incremental import _exists

TEXTS = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])
PATTERNS = T.StructType([T.StructField("address", T.StringType())])
PAIRS = T.StructType([T.StructField("address", T.StringType()), *TEXTS.fields])


def _known(spark: SparkSession, state_dir: str, name: str, schema: T.StructType, before: int) -> DataFrame:
    path = f"{state_dir}/{name}"
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return sinks.read_batches(spark, path, schema).where(F.col("batch_id") < before).drop("batch_id").distinct()


def update_pairs(texts: DataFrame, patterns: DataFrame, state_dir: str, batch_id: int) -> dict[str, int]:
    """Bring the pairs of ``(id, text)`` and ``(address)`` up to date. Returns
    how many texts met how many addresses, old and new."""
    spark = texts.sparkSession
    old_texts = _known(spark, state_dir, "texts", TEXTS, batch_id)
    old_patterns = materialize(_known(spark, state_dir, "patterns", PATTERNS, batch_id))
    new_texts = materialize(texts.where("text IS NOT NULL").distinct().join(old_texts, ["id", "text"], "left_anti"))
    new_patterns = materialize(patterns.where("address IS NOT NULL").distinct().join(old_patterns, "address", "left_anti"))
    work = {"new_texts": new_texts.count(), "old_patterns": old_patterns.count(), "new_patterns": new_patterns.count(), "all_texts": 0}
    found = []
    if work["new_texts"] and work["old_patterns"]:
        found.append(containment_join(new_texts, "text", old_patterns, "address"))
    if work["new_patterns"]:
        every = old_texts.unionByName(new_texts).distinct()
        work["all_texts"] = every.count()
        found.append(containment_join(every, "text", new_patterns, "address"))
    pairs = spark.createDataFrame([], PAIRS)
    for part in found:
        pairs = pairs.unionByName(part.select(*PAIRS.names))
    sinks.write_batch(pairs, f"{state_dir}/pairs", batch_id)
    sinks.write_batch(new_texts, f"{state_dir}/texts", batch_id)
    sinks.write_batch(new_patterns, f"{state_dir}/patterns", batch_id)
    return work


def current_pairs(texts: DataFrame, patterns: DataFrame, state_dir: str) -> DataFrame:
    """``(address, id, text)`` of the pairs that hold now."""
    pairs = _known(texts.sparkSession, state_dir, "pairs", PAIRS, 1 << 62)
    return pairs.join(texts.distinct(), ["id", "text"], "left_semi").join(patterns.distinct(), "address", "left_semi")


def _handles(handle: DataFrame) -> DataFrame:
    return handle.select(F.col("rowid").alias("id"), F.col("id").alias("text"))


def update_contact_handles(contacts: DataFrame, handle: DataFrame, state_dir: str, batch_id: int) -> dict[str, int]:
    return update_pairs(_handles(handle), valid_addresses(contacts).select("address"), state_dir, batch_id)


def maintained_contact_handles(contacts: DataFrame, handle: DataFrame, state_dir: str) -> DataFrame:
    """The rows of ``contact_handles`` from the maintained pairs; to be given
    to ``load_messages`` as ``members``."""
    addresses = valid_addresses(contacts).select("chat_key", "member_pos", "name", "addr_pos", "address")
    now = _handles(handle)
    pairs = current_pairs(now, addresses.select("address"), state_dir)
    # a handle row that occurs twice gives each pair twice, as the join does
    copies = now.groupBy("id", "text").agg(F.count(F.lit(1)).cast("int").alias("_copies"))
    pairs = pairs.join(copies, ["id", "text"]).select("address", F.explode(F.array_repeat(F.col("id"), F.col("_copies"))).alias("handle_id"))
    return addresses.join(pairs, "address").select("chat_key", "member_pos", "name", "addr_pos", "address", "handle_id")
