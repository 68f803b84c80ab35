"""The corpus pipeline: five operators in a row over ``documents``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortis.llm import line_dedup, mixing, quality, simhash
from cohortis.llm.common import Scratch, table
from cohortis.llm.queries import GOOD, MIX_WEIGHTS, held_out, packed


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at GOOD or more."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"))))
    scored = quality.score_quality(docs, model, out="__score")
    return scored.filter(F.col("__score") >= GOOD).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the later copies of repeated line runs; those that lose every line go, n_chars follows."""
    cut = line_dedup.dedup_lines(docs).filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of SimHash near-duplicates."""
    return simhash.drop_near_duplicates(docs, width=3, distance=3)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the target weights of their sources ask for."""
    return mixing.mix_documents(docs, MIX_WEIGHTS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces and their places in training sequences."""
    return packed(docs.select("doc_id", "text"))


STAGES = [("quality", classify), ("line_dedup", dedup_lines), ("simhash", dedup_near), ("mixing", mix), ("packing", pack)]

ORACLE_SQL = None  # trained trees, prefix doubling, SimHash and tokenizers are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is kept in the cluster's shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.write(name, stage(spark, docs, sf_dir))
    return docs
