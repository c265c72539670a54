"""From raw documents to packed sequences: the stages of STAGES, each on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, with
the decisions taken: rejected documents and near-duplicates are gone, and removed lines and words are gone from text
(n_chars follows the text).
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from littoral.llm import common, jaccard_join, line_dedup, packing, quality, substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumn("text", F.col(text)).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose probability of the top grade is at least one half."""
    common.text_batches(spark)
    docs = docs.select(*COLUMNS)
    model = quality.fit(docs, quality.ratings(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return quality.grade(docs, model, keep=[*COLUMNS]).filter("keep").select(*COLUMNS)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes all later repeated runs of two lines and more; documents stay, even when nothing is left of them."""
    return _with_text(line_dedup.drop_repeated_runs(docs.select(*COLUMNS)), "kept")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class the document with the least doc_id stays. Rows that share a doc_id stay or go alike."""
    docs = docs.select(*COLUMNS)
    classes = common.cut(jaccard_join.near_duplicates(docs).filter("class_id <=> doc_id").select("doc_id").distinct())
    return docs.join(classes, docs.doc_id.eqNullSafe(classes.doc_id), "left_semi").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words under windows of 35 words that start more than once; the others are joined by one space. A document
    without such windows keeps its text as it is."""
    done = substring_dedup.remove_repeats(docs.select(*COLUMNS))
    return _with_text(done.withColumn("kept", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))), "kept")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in sequences of 1024 tokens."""
    cut_up = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(cut_up.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", repeated_lines),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("best_fit_packing", packed),
]

#: A learnt classifier and the shingle join aren't SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared checkpoint folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{common.ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
