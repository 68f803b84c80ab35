"""Reading and writing study tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortis.sources.profiles import RAW_SCHEMA, FeatureProfile

REPORT_DIGITS = 2


def read_raw(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Raw patient table with a declared schema (no inference pass over the data)."""
    return read_table(spark, path, RAW_SCHEMA, fmt)


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    reader = spark.read.schema(schema)
    if fmt == "csv":
        return reader.option("header", True).option("encoding", "UTF-8").csv(path)
    return reader.format(fmt).load(path)


def write_table(df: DataFrame, path: str, fmt: str = "csv", partition_by: list[str] | None = None) -> None:
    """Write UTF-8 CSV with header, or Parquet partitioned for cohort pruning."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).option("encoding", "UTF-8").csv(path)
    else:
        writer.format(fmt).save(path)


def read_model_table(spark: SparkSession, path: str, profile: FeatureProfile, fmt: str = "csv") -> DataFrame:
    return read_table(spark, path, profile.schema, fmt)


def schema_listing(df: DataFrame) -> DataFrame:
    """(ordinal, name, type) of every column."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "ordinal int, name string, type string")


def metric_report(metrics: DataFrame, value_columns: list[str], digits: int = REPORT_DIGITS) -> DataFrame:
    """The printed form of a metric table: values rounded to report precision."""
    return metrics.withColumns({c: F.round(F.col(c), digits) for c in value_columns})
