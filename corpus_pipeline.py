"""A training corpus from the documents table in five stages, each an operator of statelens.llm.

Every stage works on all rows that its predecessor kept; all but the last return the columns
of documents. Each result is written and read again, so a lost executor costs one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statelens.llm import decontam, language_id, line_dedup, packing, simhash
from statelens.llm._common import fold, save, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (null text, no letter) go; a null lang takes the prediction."""
    model = language_id.fit(docs, fold(F.col("doc_id"), 3) != 1)
    return language_id.with_language(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A line of 10 characters or more stays in the first document that holds it; n_chars follows the text."""
    kept = line_dedup.dedup_lines(docs).withColumn("text", F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text")))
    kept = kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    return simhash.first_of_groups(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; from the others every benchmark passage is cut, again until none is left."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document's tokens in sequences of 1,024."""
    return packing.pack(docs)


STAGES = [("language_id", language), ("line_dedup", lines), ("simhash_near_dedup", near_copies), ("decontamination", benchmark), ("packing", sequences)]

#: Language models, fingerprint groups and tokens aren't SQL; tests/llm/test_pipeline.py holds each stage against one written row by row.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name)
    return docs
