"""Counts, distinct values, pooling, set difference, correlation."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def patients_matching(df: DataFrame, test: Column, key: str = "pid") -> DataFrame:
    return df.agg(F.countDistinct(F.when(test, F.col(key))).alias("patients"))


def patients_per_flag(df: DataFrame, flags: list[str], key: str = "pid") -> DataFrame:
    """Distinct keys with each 0/1 flag set.

    The flags that hold are unpivoted first, so the distinct runs on (flag, key)
    pairs that combine before the shuffle.
    """
    names = F.array(*[F.when(F.col(f"`{c}`") == 1, F.lit(c)) for c in flags])
    pairs = df.select(F.explode(F.array_compact(names)).alias("bucket"), key).distinct()
    return pairs.groupBy("bucket").agg(F.count(key).alias("patients"))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Row counts by value combination; rows with a null in any counted column are left out."""
    return df.na.drop(subset=cols).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def label_counts_rollup(df: DataFrame, cohort: str = "cohort", label: str = "label") -> DataFrame:
    """Label counts per cohort with the pooled count (null cohort) in the same job."""
    grouped = df.groupBy(label, cohort).agg(F.count(F.lit(1)).alias("n"))
    # the roll-up runs on one row per (label, cohort)
    pooled = grouped.groupingSets([[F.col(label), F.col(cohort)], [F.col(label)]], F.col(label), F.col(cohort))
    return pooled.agg(F.grouping(cohort).cast("int").alias("pooled"), F.sum("n").alias("n"))


def indicator_sum(df: DataFrame, cols: list[str], out: str = "total") -> DataFrame:
    return df.agg(reduce(lambda a, b: a + b, [F.sum(F.col(f"`{c}`")) for c in cols]).cast("bigint").alias(out))


def class_counts(df: DataFrame, by: str, label: str = "label") -> DataFrame:
    return df.groupBy(by).agg(
        F.sum(F.col(label)).cast("bigint").alias("positives"),
        F.sum(1 - F.col(label)).cast("bigint").alias("negatives"),
    )


def pool(frames: list[DataFrame]) -> DataFrame:
    """Union by name; duplicates stay and a missing column becomes null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def values_not_in(df: DataFrame, col: str, allowed: list[str]) -> DataFrame:
    """Set difference of the values present and a list; null is a value."""
    listed = df.sparkSession.createDataFrame([(v,) for v in allowed], f"{col} string")
    return df.select(col).distinct().exceptAll(listed.distinct()).distinct()


def label_correlation(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Pearson correlation of every feature with the label, all in one aggregate."""
    row = df.agg(*[F.corr(F.col(f"`{c}`").cast("double"), F.col(label).cast("double")).alias(f"c{i}")
                   for i, c in enumerate(features)])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"c{i}").alias("corr"))
                      for i, c in enumerate(features)])
    return row.select(F.inline(pairs))


def low_correlation(df: DataFrame, features: list[str], label: str, threshold: float = 0.012) -> DataFrame:
    """Features whose absolute correlation with the label is under the threshold."""
    return label_correlation(df, features, label).where(F.abs("corr") < threshold)


def drop_low_correlation(df: DataFrame, features: list[str], label: str, threshold: float = 0.012) -> DataFrame:
    """Drop those features. The list collected is at most one name per column."""
    weak = [r["feature"] for r in low_correlation(df, features, label, threshold).collect()]
    return df.drop(*weak)


def correlation_pairs(df: DataFrame, features: list[str]) -> DataFrame:
    """Correlation matrix as (row_feature, col_feature, corr); each pair uses the rows where both are present.

    One aggregate finds the column means; then each task turns its Arrow batches
    into matrix products of the centred columns, and only d x d sums are
    shuffled. Centring keeps the sums accurate over many rows.
    """
    numeric = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(features)])
    names = numeric.columns
    first = numeric.agg(*[F.avg(c) for c in names]).first()
    centre = np.array([0.0 if v is None else v for v in first])
    parts = ("n", "sx", "sy", "sxx", "syy", "sxy")

    def sums(batches):
        total = None
        for pdf in batches:
            x = pdf.to_numpy(dtype=float) - centre
            here = ~np.isnan(x)
            x = np.where(here, x, 0.0)
            m, sq = here.astype(float), x * x
            step = np.stack([m.T @ m, x.T @ m, m.T @ x, sq.T @ m, m.T @ sq, x.T @ x])
            total = step if total is None else total + step
        if total is not None:
            i, j = np.indices(total.shape[1:])
            yield pd.DataFrame({"i": i.ravel().astype("int32"), "j": j.ravel().astype("int32"),
                                **{p: t.ravel() for p, t in zip(parts, total)}})

    schema = "i int, j int, " + ", ".join(f"{p} double" for p in parts)
    t = numeric.mapInPandas(sums, schema).groupBy("i", "j").agg(*[F.sum(p).alias(p) for p in parts])
    n, sx, sy, sxx, syy, sxy = (F.col(p) for p in parts)
    spread = F.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy))
    labels = F.array(*[F.lit(c) for c in features])
    return t.select(labels[F.col("i")].alias("row_feature"), labels[F.col("j")].alias("col_feature"),
                    ((n * sxy - sx * sy) / F.nullif(spread, F.lit(0.0))).alias("corr"))
