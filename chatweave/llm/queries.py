"""The registered queries of this subpackage: each applies one operator to its
whole table and returns the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatweave.llm import centroid_clusters, curriculum, html_templates, language_id, line_crf, ngram_join, norm_topk, packing, phrases, quality_rules, token_index, token_rollups, url_rules
from chatweave.llm.common import remainder, stored, table
from chatweave.llm.tokens import NAME
from chatweave.session import scratch_path


#: The production rules of op6: (host and path, verdict).
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op1_html_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_templates.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), ["page_id", "url"])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = quality_rules.quality_rules(docs, table(spark, sf_dir, "labels"), ["doc_id"])
    return out.select("doc_id", *quality_rules.STATISTICS, "base_failed", "kept")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language_id.language_id(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    held = F.coalesce(remainder("doc_id", language_id.MODULUS) == language_id.HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("ids")


def op5_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals of all documents after four commits: the load, the load
    again (no effect), the removal of exact copies of a document with a
    smaller id, and counts revised by the id that ends a document."""
    docs = table(spark, sf_dir, "documents").withColumn("hash", F.md5("text"))
    counts = stored(token_rollups.token_counts(docs, ["doc_id", "source", "lang", "hash"]), "counts")
    rows = counts.withColumn("tokenizer", F.lit(NAME))
    firsts = counts.where("hash IS NOT NULL").groupBy("hash").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = rows.join(firsts, "hash").where("doc_id <> first")
    later = rows.join(copies.select("doc_id"), "doc_id", "left_anti")
    store = token_rollups.TokenRollups(spark, scratch_path(spark, "rollups"))
    load = rows.withColumn("op", F.lit("insert"))
    store.commit("load", load)
    store.commit("load", load)
    store.commit("copies", copies.withColumn("op", F.lit("delete")))
    store.commit("end-id", later.withColumn("op", F.lit("revise")).withColumn("n_tokens", F.col("n_tokens") + 1))
    return store.totals()


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return url_rules.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules, ["page_id"])


def op7_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix is written in training order; what a document has in it is read
    back. Documents may share an id or have none, so rows have numbers."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", F.monotonically_increasing_id().alias("row"))
    assigned = stored(curriculum.assign(docs, ["doc_id", "row"]), "assigned")
    order = stored(curriculum.in_order(assigned), "order")
    of = ["size", "source_size", "target"]
    used = order.groupBy("_doc.row", "_doc.doc_id", *of).agg((F.count("position") * F.col("size")).alias("taken"), F.min("position").alias("first_position"))
    rest = assigned.where("copies = 0").select("_doc.doc_id", *of, "taken", F.lit(None).cast("double").alias("first_position"))
    return used.drop("row").unionByName(rest)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, percent=85)


def op9_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = line_crf.fit_model(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(remainder("doc_id", line_crf.MODULUS) == line_crf.HELD_OUT, F.lit(False))
    out = line_crf.score_documents(docs, model, ["doc_id"])
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_norm_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return norm_topk.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op11_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = token_index.write(docs)
    read = made.read(token_index.row_keys(docs, "doc_id"), "doc_id")
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_templates, op2_quality_rules, op3_language_id, op4_packing, op5_token_rollups,
        op6_url_rules, op7_curriculum_mix, op8_ngram_join, op9_line_crf, op10_norm_topk, op11_token_index,
        op12_phrases, op13_centroid_clusters,
    )
}
