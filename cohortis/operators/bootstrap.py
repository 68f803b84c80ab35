"""Bootstrap intervals of AUC, accuracy, specificity, sensitivity and precision.

Replicates are a grouping key, so all of them run in one job. Two forms:

* ``exact_replicates`` draws n rows with replacement per replicate (B * n draws);
* ``poisson_replicates`` gives each row a Poisson(1) weight instead. The weights
  of c equal rows add up to Poisson(c), so one draw per distinct
  (group, score, label) cell is enough, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortis.functions.keyed import keyed_hash, keyed_index
from cohortis.operators.evaluate import REPORT_THRESHOLD, score_cells
from cohortis.operators.ranking import row_numbers, running_totals

METRICS = ("auc", "accuracy", "specificity", "sensitivity", "precision")
REPLICATES = 1000
CHUNK = 100  # replicates drawn together in one task
CELLS_IN_TASK = 20_000  # distinct scores of one group held in one task


def _metrics_from_cells(cells: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Replicate metrics from weighted (score, pos, neg) cells; one-class replicates are skipped."""
    run = running_totals(cells, keys, "score", ["pos", "neg"], descending=False)
    hit = F.col("score") >= threshold
    wins = F.sum(F.col("pos").cast("double") * (F.col("cum_neg") - F.col("neg") / 2.0))
    sums = run.groupBy(*keys).agg(
        wins.alias("wins"), F.sum("pos").cast("double").alias("p"), F.sum("neg").cast("double").alias("q"),
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).cast("double").alias("tp"),
        F.sum(F.when(hit, F.col("neg")).otherwise(0)).cast("double").alias("fp"),
    ).where("p > 0 and q > 0")
    predicted = F.col("tp") + F.col("fp")
    return sums.select(
        *keys,
        (F.col("wins") / (F.col("p") * F.col("q"))).alias("auc"),
        ((F.col("tp") + F.col("q") - F.col("fp")) / (F.col("p") + F.col("q"))).alias("accuracy"),
        ((F.col("q") - F.col("fp")) / F.col("q")).alias("specificity"),
        (F.col("tp") / F.col("p")).alias("sensitivity"),
        F.when(predicted > 0, F.col("tp") / predicted).otherwise(0.0).alias("precision"),
    )


def exact_replicates(
    df: DataFrame,
    key: str,
    n_replicates: int = REPLICATES,
    seed: int = 42,
    threshold: float = REPORT_THRESHOLD,
) -> DataFrame:
    """(rep, metrics): B * n keyed draws joined to numbered rows, then reduced to cells per replicate."""
    spark = df.sparkSession
    rows = row_numbers(df.select(key, "label", "score"), [], key)
    n = df.count()
    draws = spark.range(n_replicates * n).select(
        F.floor(F.col("id") / F.lit(max(n, 1))).cast("int").alias("rep"), F.pmod("id", F.lit(max(n, 1))).alias("k")
    )
    picked = draws.select("rep", keyed_index(F.lit(n), seed, "boot", "rep", "k").alias("row_no"))
    cells = picked.join(rows, "row_no").groupBy("rep", "score").agg(
        F.count(F.when(F.col("label") == 1, 1)).alias("pos"), F.count(F.when(F.col("label") != 1, 1)).alias("neg")
    )
    return _metrics_from_cells(cells, ["rep"], threshold)


def _draw(seed: int, count: int, size: int) -> np.ndarray:
    return np.random.default_rng(int(seed)).poisson(int(count), size)


def poisson_replicates(
    df: DataFrame,
    keys: Sequence[str] = ("model", "cohort"),
    n_replicates: int = REPLICATES,
    seed: int = 42,
    threshold: float = REPORT_THRESHOLD,
    resolution: int | None = None,
    cells_in_task: int = CELLS_IN_TASK,
) -> DataFrame:
    """(keys, rep, metrics) with Poisson weights per cell.

    Draws are seeded by cell and replicate chunk, so they do not depend on
    partitioning. Groups with few distinct scores finish a chunk of replicates
    inside one task; otherwise the weighted cells go through ``running_totals``.
    """
    keys = list(keys)
    cells = score_cells(df, keys, resolution).persist()
    biggest = cells.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    n_chunks = -(-n_replicates // CHUNK)
    chunked = cells.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))))
    seeded = chunked.withColumns({
        "s_pos": keyed_hash(seed, "boot-pos", *keys, "score", "chunk"),
        "s_neg": keyed_hash(seed, "boot-neg", *keys, "score", "chunk"),
    })
    key_fields = [df.schema[k] for k in keys]

    def width(chunk: int) -> int:
        return min(CHUNK, n_replicates - chunk * CHUNK)

    if biggest <= cells_in_task:
        schema = T.StructType([*key_fields, T.StructField("rep", T.IntegerType()),
                               *[T.StructField(m, T.DoubleType()) for m in METRICS]])

        def finish(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("score")
            chunk = int(pdf["chunk"].iloc[0])
            size = width(chunk)
            pos = np.stack([_draw(s, c, size) for s, c in zip(pdf["s_pos"], pdf["pos"])]).astype(float)
            neg = np.stack([_draw(s, c, size) for s, c in zip(pdf["s_neg"], pdf["neg"])]).astype(float)
            p, q = pos.sum(0), neg.sum(0)
            wins = (pos * (np.cumsum(neg, 0) - neg / 2)).sum(0)
            hit = (pdf["score"].to_numpy() >= threshold)[:, None]
            tp, fp = (pos * hit).sum(0), (neg * hit).sum(0)
            with np.errstate(divide="ignore", invalid="ignore"):
                out = pd.DataFrame({
                    **{k: pdf[k].iloc[0] for k in keys},
                    "rep": np.arange(size, dtype=np.int32) + chunk * CHUNK,
                    "auc": wins / (p * q), "accuracy": (tp + q - fp) / (p + q), "specificity": (q - fp) / q,
                    "sensitivity": tp / p, "precision": np.where(tp + fp > 0, tp / (tp + fp), 0.0),
                })
            return out[(p > 0) & (q > 0)]

        return seeded.groupBy(*keys, "chunk").applyInPandas(finish, schema)

    schema = T.StructType([*key_fields, T.StructField("score", T.DoubleType()), T.StructField("rep", T.IntegerType()),
                           T.StructField("pos", T.LongType()), T.StructField("neg", T.LongType())])

    def weigh(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                size = width(row.chunk)
                yield pd.DataFrame({
                    **{k: getattr(row, k) for k in keys}, "score": row.score,
                    "rep": np.arange(size, dtype=np.int32) + row.chunk * CHUNK,
                    "pos": _draw(row.s_pos, row.pos, size), "neg": _draw(row.s_neg, row.neg, size),
                })

    return _metrics_from_cells(seeded.mapInPandas(weigh, schema), [*keys, "rep"], threshold)


def intervals(
    replicates: DataFrame, keys: Sequence[str] = (), low: float = 0.05, high: float = 0.95
) -> DataFrame:
    """Mean, median and two order statistics per metric over the kept replicates.

    The positions are int(low * m) and int(high * m), zero-based, of the sorted
    values. A group holds at most one value per replicate.
    """
    long = replicates.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])))
    packed = long.groupBy(*keys, "metric").agg(
        F.avg("value").alias("mean"), F.median("value").alias("median"),
        F.sort_array(F.collect_list("value")).alias("v"), F.count("value").cast("int").alias("replicates"),
    )

    def at(q: float):
        return F.element_at("v", F.floor(F.lit(q) * F.col("replicates")).cast("int") + 1)

    return packed.select(*keys, "metric", "mean", "median", at(low).alias("p05"), at(high).alias("p95"), "replicates")
