"""Operator 5: delta-maintained token totals.

A store below one shared folder holds, per committed batch, a ledger (signed
rows per document and tokenizer version) and its signed sums by source,
language and tokenizer version. Totals are the sums over all batches, so a
batch of inserts, deletes or revised counts costs in proportion to itself: its
old values come from the ledger rows of just the documents it names.

A batch is written to folders that bear its id and counts only once its commit
row is written. A batch whose id is committed is not applied again; one that
broke off before leaves folders that the next attempt overwrites.

Defined results: an insert of a live document, or a revision of an unknown
one, sets its count (upsert); a delete of an unknown document does nothing; a
revision with null source or language keeps the old one; of several
changes to one document in a batch the highest ``seq`` counts, then delete
before insert and revise, then the larger count; rows without id are inserted
one by one and never revised or deleted; null counts are 0; null sources and
languages are groups of their own; an empty batch commits and changes nothing.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatweave.llm.common import stored
from chatweave.llm.tokens import NAME, encoder

GROUP = ["source", "lang", "tokenizer"]
LEDGER = "doc_id long, tokenizer string, source string, lang string, n_docs long, n_tokens long"
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
CHANGES = "op string, doc_id long, tokenizer string, source string, lang string, n_tokens long, seq long"


class TokenRollups:
    """The store below ``path`` (a folder that all executors share)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        for name, schema in (("ledger", LEDGER), ("totals", TOTALS), ("commits", "n_rows long")):
            empty = spark.createDataFrame([], schema).withColumn("batch_id", F.lit("none"))
            empty.write.mode("ignore").partitionBy("batch_id").parquet(f"{self.path}/{name}")

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(f"{schema}, batch_id string").parquet(f"{self.path}/{name}")

    def _committed(self, name: str, schema: str) -> DataFrame:
        done = self._read("commits", "n_rows long").select("batch_id").distinct()
        return self._read(name, schema).join(done, "batch_id", "left_semi")

    def is_committed(self, batch_id: str) -> bool:
        return self._read("commits", "n_rows long").where(F.col("batch_id") == batch_id).limit(1).count() > 0

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Applies ``changes`` (columns of ``CHANGES``; seq may be missing)
        once. False if the batch was committed before."""
        if not re.fullmatch(r"[A-Za-z0-9._-]+", batch_id) or batch_id == "none":
            raise ValueError("a batch id is letters, digits, '.', '_' and '-'")
        if self.is_committed(batch_id):
            return False
        if "seq" not in changes.columns:
            changes = changes.withColumn("seq", F.lit(0))
        changes = changes.select(*[F.col(f.name).cast(f.dataType) for f in self.spark.createDataFrame([], CHANGES).schema])
        signed = stored(self._signed(changes), f"batch-{batch_id}")
        signed.write.mode("overwrite").parquet(f"{self.path}/ledger/batch_id={batch_id}")
        sums = signed.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        sums.write.mode("overwrite").parquet(f"{self.path}/totals/batch_id={batch_id}")
        self.spark.range(1).select(F.lit(signed.count()).alias("n_rows")).write.mode("overwrite").parquet(f"{self.path}/commits/batch_id={batch_id}")
        return True

    def _signed(self, changes: DataFrame) -> DataFrame:
        key = ["doc_id", "tokenizer"]
        count = F.coalesce("n_tokens", F.lit(0)).cast("long")
        anonymous = changes.where("doc_id IS NULL AND op = 'insert'")
        order = F.struct(F.coalesce("seq", F.lit(0)), F.col("op") == "delete", F.coalesce("n_tokens", F.lit(0)), F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
        last = (
            changes.where(F.col("doc_id").isNotNull() & F.col("op").isin("insert", "delete", "revise"))
            .withColumn("tokenizer", F.coalesce("tokenizer", F.lit("")))
            .groupBy(*key).agg(F.max_by(F.struct("op", "source", "lang", count.alias("n_tokens")), order).alias("new"))
        )
        live = (
            self._committed("ledger", LEDGER).where("doc_id IS NOT NULL").join(last.select(*key), key, "left_semi")
            .groupBy(*key, "source", "lang").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs > 0")
            .select(*key, F.struct("source", "lang", "n_tokens").alias("old"))
        )
        both = last.join(live, key, "left")
        kept = F.col("new.op") == "revise"
        minus = F.when(F.col("old").isNotNull(), F.struct(F.col("old.source").alias("source"), F.col("old.lang").alias("lang"), F.lit(-1).cast("long").alias("n_docs"), (-F.col("old.n_tokens")).alias("n_tokens")))
        plus = F.when(F.col("new.op") != "delete", F.struct(
            F.when(kept, F.coalesce("new.source", "old.source")).otherwise(F.col("new.source")).alias("source"),
            F.when(kept, F.coalesce("new.lang", "old.lang")).otherwise(F.col("new.lang")).alias("lang"),
            F.lit(1).cast("long").alias("n_docs"), F.col("new.n_tokens").alias("n_tokens")))
        rows = both.select(*key, F.explode(F.array_compact(F.array(minus, plus))).alias("x")).select(*key, "x.*")
        loose = anonymous.select("doc_id", F.coalesce("tokenizer", F.lit("")).alias("tokenizer"), "source", "lang", F.lit(1).cast("long").alias("n_docs"), count.alias("n_tokens"))
        return rows.unionByName(loose)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens of what is live."""
        sums = self._committed("totals", TOTALS).groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 OR n_tokens <> 0")


def token_counts(docs: DataFrame, keep: list[str], text: str = "text", name: str = NAME) -> DataFrame:
    """Columns ``keep`` with n_tokens of every whole text (null: 0)."""
    rows = docs.select(F.struct(*keep).alias("_keep"), F.col(text).alias("_text"))
    fields = rows.select("_keep").schema

    def run(batches):
        enc = encoder(name)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["_keep"], pa.array([enc.count(x.as_py()) for x in batch["_text"]], pa.int64())], names=["_keep", "n_tokens"])

    return rows.mapInArrow(run, fields.add("n_tokens", "long")).select("_keep.*", "n_tokens")
