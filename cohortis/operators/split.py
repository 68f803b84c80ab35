"""Train/test splits, folds, batches and cohort roles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortis.functions.keyed import keyed_hash
from cohortis.operators.ranking import assign_by_rank, row_numbers


def stratified_split(
    df: DataFrame, label: str, key: str, test_fraction: float = 0.2, seed: int = 42, out: str = "split"
) -> DataFrame:
    """Exactly ceil(fraction * n) rows of each class become ``test``, the others ``train``."""
    sliced = assign_by_rank(
        df, label, key, seed, "split", lambda n: [F.ceil(F.lit(test_fraction) * n)], "__slice"
    )
    return sliced.withColumn(out, F.when(F.col("__slice") == 0, "test").otherwise("train")).drop("__slice")


def stratified_folds(
    df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42, out: str = "fold"
) -> DataFrame:
    """k folds whose class counts differ by at most one."""
    return assign_by_rank(
        df, label, key, seed, "fold", lambda n: [F.floor(n * i / k) for i in range(1, k)], out
    )


def batches(df: DataFrame, key: str, size: int = 64, seed: int | None = None, out: str = "batch_id") -> DataFrame:
    """Exact batches of ``size`` rows: in key order, or shuffled when a seed is given."""
    numbered = row_numbers(df, [], key, seed, "batch", "__row")
    return numbered.withColumn(out, F.floor(F.col("__row") / size)).drop("__row")


def hashed_batches(df: DataFrame, key: str, n_batches: int, seed: int = 42, out: str = "batch_id") -> DataFrame:
    """About equal batches without any shuffle: a keyed hash modulo the batch count."""
    return df.withColumn(out, F.pmod(keyed_hash(seed, "batch", key), F.lit(n_batches)))


def cohort_roles(df: DataFrame, train: Sequence[str], cohort: str = "cohort", out: str = "role") -> DataFrame:
    """Mark the cohorts used for training; the rest are external."""
    return df.withColumn(out, F.when(F.col(cohort).isin(*train), "train").otherwise("external"))
