"""A corpus pipeline of five operators over ``documents``; counted with the training-data subpackage.

Every stage takes what its predecessor kept and returns the columns of ``documents``, the last one the rates:

1. quality classifier: documents that score below the threshold go;
2. n-gram Jaccard join: of each group of near-duplicates the document with the smallest doc_id stays;
3. benchmark decontamination: documents that hold a benchmark window go;
4. secret scans: secrets are replaced by ``[kind]`` in the text, and n_chars follows;
5. mixing: a nonnegative rate per document, so that expected tokens per language meet the target weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontamination, mixing, ngram_join, quality_classifier, secret_scans
from corpusloom.llm.common import remove, scratch_path, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scans.redact(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, mixing.labelled_languages(docs, table(spark, sf_dir, "labels")), mixing.TARGETS)


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", decontaminated),
    ("secret scans", without_secrets),
    ("mixing", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's table goes once the next one's is written, so one copy of the kept texts exists beside the input."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"pipeline-{k}")
        made = stage(spark, docs, sf_dir)
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs


#: Neighbours in a latent space have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None
