"""The corpus pipeline: quality rules, language ID, n-gram Jaccard join,
mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that ``run``
writes as Parquet and reads back as the next stage's docs. All but the last
return the columns of ``documents``. As a stage's result is written before the
next one is called, the tables that a stage kept in the shared scratch folder
are removed when the stage after it begins. Columns may have any names.
"""

from __future__ import annotations

from functools import wraps

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chatweave.llm import curriculum, language_id, ngram_join, packing, quality_rules
from chatweave.llm.common import FEW_IDS, join_small, scratch_group, stored, table
from chatweave.session import remove_path

#: Some stages (a trained classifier, an id-level join on hashes) have no SQL form.
ORACLE_SQL = None

#: Near copies: shingles of so many words, and the least Jaccard similarity of them.
NEAR_WORDS, NEAR_PERCENT = 5, 80

#: scratch folders of each stage's calls, by application and place
_scratch: dict[tuple[str, int], list[str]] = {}


def _stage(place: int):
    """A stage that first removes the scratch of other stages (also of an earlier run)."""

    def wrap(stage):
        @wraps(stage)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            app = spark.sparkContext.applicationId
            for key in [k for k in _scratch if k[0] == app and k[1] != place]:
                for path in _scratch.pop(key):
                    remove_path(spark, path)
            with scratch_group() as paths:
                out = stage(spark, docs, sf_dir)
            _scratch.setdefault((app, place), []).extend(paths)
            return out

        return run_stage

    return wrap


def _all(docs: DataFrame) -> list[str]:
    """Every column of ``docs``, quoted where its name needs it."""
    return [c if c.isidentifier() else f"`{c.replace('`', '``')}`" for c in docs.columns]


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` as (_row, _doc, text): a number of each row that stays the same
    whenever the rows are read. A table read from files has it in the file's place
    and the row's place in the file; any other is stored with numbers."""
    rows = docs.withColumn("_doc", F.struct(*_all(docs)))
    try:
        placed = rows.select("_doc", "text", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    except AnalysisException:
        return stored(rows.select(F.monotonically_increasing_id().alias("_row"), "_doc", "text"), "numbered")
    files = placed.select("_file").distinct().select("_file", F.dense_rank().over(W.orderBy("_file")).cast("long").alias("_n"))
    placed = join_small(placed, stored(files, "files"), ["_file"], "inner")
    return placed.select((F.col("_n") * F.lit(1 << 40) + F.col("_at")).alias("_row"), "_doc", "text")


@_stage(0)
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the certified cutoffs."""
    rows = docs.select(F.struct(*_all(docs)).alias("_doc"), "doc_id", "text", "lang")
    judged = quality_rules.quality_rules(rows, table(spark, sf_dir, "labels"), ["_doc"])
    return judged.where("kept").select("_doc.*")


@_stage(1)
def keep_recognised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised with a calibrated score."""
    model = language_id.fit_model(docs.select("doc_id", "text", "lang"))
    rows = docs.select(F.struct(*_all(docs)).alias("_doc"), "text")
    return language_id.identify(rows, model, ["_doc"]).where("accepted").select("_doc.*")


@_stage(2)
def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies. Rows are told apart by a
    number of their own, so rows that share an id, or have none, are compared
    like any others. Rows without words link with nothing and stay."""
    rows = numbered(docs)
    groups = ngram_join.ngram_join(rows.select("_row", "text"), doc_id="_row", words=NEAR_WORDS, percent=NEAR_PERCENT)
    others = stored(groups.where("_row <> component_id").select("_row"), "others")
    few = others.limit(FEW_IDS + 1).count() <= FEW_IDS
    return rows.join(F.broadcast(others) if few else others, "_row", "left_anti").select("_doc.*")


@_stage(3)
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return curriculum.mix(docs, _all(docs), position=False)


@_stage(4)
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences (ids are left out of the result)."""
    return packing.pack(docs).drop("ids")


STAGES = [
    ("quality rules", keep_quality),
    ("language ID", keep_recognised),
    ("n-gram Jaccard join", keep_one_of_copies),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return docs
