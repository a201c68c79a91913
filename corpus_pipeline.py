"""The corpus pipeline: language, quality, near-duplicates, source weights, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
documents; `run` writes each stage's rows to the shared folder before the next one reads them.

Defined cases are those of the operators: null and empty texts have no language and go in the first stage; rows that
repeat an id stay apart until the third stage leaves one of each group; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import jaccard, language, mixing, packing, quality
from quire.llm.common import crc_mod, small_batches, stored, table

#: The least share of the probability that a text's language must have.
LANGUAGE_SHARE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and those between languages. Learns from the rows that op6 learns from."""
    small_batches(spark)
    model = language.train(docs.filter(crc_mod(F.col("doc_id"), 4) != 2))
    named = docs.select(*[F.col(c).alias(f"kept_{c}") for c in docs.columns])
    found = language.predict(named, model, text="kept_text")
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LANGUAGE_SHARE)).select(*[F.col(f"kept_{c}").alias(c) for c in docs.columns])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier scores below its threshold. Learns from the labels that op1 learns from."""
    small_batches(spark)
    model = quality.train(docs, quality.training_labels(spark, sf_dir))
    named = docs.select(*[F.col(c).alias(f"kept_{c}") for c in docs.columns])
    found = quality.score(named, model, text="kept_text")
    return found.filter(F.col("score") >= quality.THRESHOLD).select(*[F.col(f"kept_{c}").alias(c) for c in docs.columns])


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each group of near-duplicates."""
    small_batches(spark)
    return jaccard.one_of_each(docs)


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes from each source what its target allows; words that are taken twice are two rows."""
    small_batches(spark)
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences."""
    small_batches(spark)
    return packing.pack(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [
    ("language_id", known_language),
    ("quality_classifier", good_quality),
    ("ngram_jaccard_join", without_near_duplicates),
    ("source_mixing", source_weights),
    ("best_fit_packing", packed),
]

#: Language, quality and packing have no SQL form; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
