"""From documents to packed training sequences: four stages, each applying one operator of rekurve.llm to all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from rekurve.llm import language, near_copies, packing, toxicity
from rekurve.llm.common import cut_lineage, free_name, likely, marked

#: A document is kept if one language has this share of its letters.
LANGUAGE_SHARE = 0.5
#: Near copies share this of their distinct five-word shingles (Jaccard similarity).
COPY_WORDS, COPY_SHARE = 5, 0.8
#: Bytes of rows that a Python worker gets at once, unless the session names a limit.  Spark's own, 64 MB, lets all texts of a task stand
#: in one batch: in the buffers of the JVM, in its queue of rows that wait for the worker, and twice in the worker.
BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def small_batches(spark: SparkSession) -> None:
    """For the session, as what a stage returns runs only when it is written."""
    if spark.conf.get(BATCH_LIMIT, None) is None:
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no letter, or in which no language has half of the letters; without a language to learn from, the first only."""
    small_batches(spark)
    model = language.learn(docs, "doc_id", "text", "lang")
    if not model.langs:
        return docs.filter(language.has_letter(F.col("text")))
    found = free_name(docs, "found")
    d = docs.withColumn(found, language.language_of(spark, F.col("text"), model))
    return d.filter((F.col(f"{found}.language") != language.UNKNOWN) & (F.col(f"{found}.score") >= LANGUAGE_SHARE)).drop(found)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the classifier, learned from the labels of those that are left, calls toxic."""
    small_batches(spark)
    reviews = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.learn(docs, reviews, "doc_id", "text", "lang")
    score = free_name(docs, "score")
    return docs.withColumn(score, toxicity.toxicity(spark, F.col("text"), model)).filter(F.col(score) < 0.5).drop(score)


def one_of_each_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, repeated rows included, the one with the smallest doc_id (a missing one last)."""
    small_batches(spark)
    row = free_name(docs, "row")
    d = cut_lineage(docs.withColumn(row, F.monotonically_increasing_id()))  # written, so that a row has one number in all that follows
    found = cut_lineage(near_copies.near_copies(d, row, "text", COPY_WORDS, COPY_SHARE))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col(row))
    first = found.join(d.select(row, "doc_id"), row).groupBy("component_id").agg(F.min(order)[row].alias(row))  # combined before it is shuffled
    lost = cut_lineage(found.select(row).join(first.select(row), row, "left_anti"))
    marks = marked(lost, row)  # so only texts that may go are shuffled
    return likely(d, row, marks, "left_anti").unionByName(likely(d, row, marks).join(lost, row, "left_anti")).drop(row)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens."""
    small_batches(spark)
    p = packing.pack_notes(docs, public_tokenizers.path("word_bpe_49k.json"), experiment_id="doc_id", description="text")
    return p.withColumnsRenamed({"experiment_id": "doc_id", "note_tokens": "doc_tokens"})


STAGES = [("language", known_language), ("toxicity", not_toxic), ("near copies", one_of_each_copy), ("packing", packed)]

#: SQL can't express the stages; tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
