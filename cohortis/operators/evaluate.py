"""Evaluation of scores: confusion counts, threshold sweeps, ROC, AUC, log loss.

All operators take a prediction table with 0/1 ``label`` and ``score`` columns
and the grouping ``keys`` (for example model and cohort), and reduce it to
counts before anything ordered or per-threshold happens.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cohortis.operators.ranking import running_totals

KEYS = ("model", "cohort")
SWEEP = [i / 20 for i in range(21)]
REPORT_THRESHOLD = 0.35
LOG_FLOOR = -100.0


def _ratio(num: Column, den: Column) -> Column:
    return num / F.nullif(den, F.lit(0))


def confusion_counts(df: DataFrame, keys: Sequence[str] = KEYS, threshold: float = 0.5) -> DataFrame:
    """tp, fn, tn, fp per group; a score equal to the threshold is positive."""
    hit, pos = F.col("score") >= threshold, F.col("label") == 1
    cells = {"tp": hit & pos, "fn": ~hit & pos, "tn": ~hit & ~pos, "fp": hit & ~pos}
    return df.groupBy(*keys).agg(*[F.count(F.when(t, 1)).alias(n) for n, t in cells.items()])


def derived_metrics(counts: DataFrame) -> DataFrame:
    """Sensitivity, specificity, accuracy, weighted accuracy; null where undefined."""
    tp, fn, tn, fp = (F.col(c) for c in ("tp", "fn", "tn", "fp"))
    return counts.withColumns({
        "sensitivity": _ratio(tp, tp + fn),
        "specificity": _ratio(tn, tn + fp),
        "accuracy": _ratio(tp + tn, tp + fn + tn + fp),
        "weighted_accuracy": _ratio(tn, tn + fp) * 0.5 + _ratio(tp, tp + fn) * 0.5,
    })


def threshold_metrics(df: DataFrame, keys: Sequence[str] = KEYS, threshold: float = 0.5) -> DataFrame:
    return derived_metrics(confusion_counts(df, keys, threshold))


def threshold_sweep(
    df: DataFrame, keys: Sequence[str] = KEYS, thresholds: Sequence[float] = SWEEP
) -> DataFrame:
    """Confusion counts and metrics at each threshold.

    A row is first reduced to the number of thresholds it reaches, so the data
    shuffle as (threshold count + 1) x 2 cells per group; the expansion by
    threshold runs on those cells.
    """
    ts = sorted(thresholds)
    reached = sum((F.coalesce((F.col("score") >= t).cast("int"), F.lit(0)) for t in ts[1:]),
                  F.coalesce((F.col("score") >= ts[0]).cast("int"), F.lit(0)))
    cells = df.groupBy(*keys, reached.alias("__r")).agg(
        F.count(F.when(F.col("label") == 1, 1)).alias("__p"), F.count(F.when(F.col("label") != 1, 1)).alias("__q")
    )
    wide = cells.select("*", F.posexplode(F.array(*[F.lit(float(t)) for t in ts])).alias("__i", "threshold"))
    hit = F.col("__r") > F.col("__i")
    counts = wide.groupBy(*keys, "threshold").agg(
        F.sum(F.when(hit, F.col("__p")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, 0).otherwise(F.col("__p"))).alias("fn"),
        F.sum(F.when(hit, 0).otherwise(F.col("__q"))).alias("tn"),
        F.sum(F.when(hit, F.col("__q")).otherwise(0)).alias("fp"),
    )
    return derived_metrics(counts)


def best_threshold(sweep: DataFrame, keys: Sequence[str] = KEYS, metric: str = "weighted_accuracy") -> DataFrame:
    """The lowest threshold with the highest metric in each group."""
    w = W.partitionBy(*keys).orderBy(F.desc_nulls_last(metric), F.asc("threshold"))
    return sweep.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def threshold_series(sweep: DataFrame, keys: Sequence[str] = KEYS, leave_out: int = 2) -> DataFrame:
    """The (threshold, weighted accuracy) series without its last points."""
    w = W.partitionBy(*keys).orderBy(F.desc("threshold"))
    return (
        sweep.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") > leave_out)
        .select(*keys, "threshold", "weighted_accuracy")
    )


def score_cells(df: DataFrame, keys: Sequence[str] = KEYS, resolution: int | None = None) -> DataFrame:
    """Positives and negatives per distinct score; ``resolution`` rounds scores down to 1/resolution."""
    score = F.col("score").cast("double")
    if resolution:
        score = F.floor(score * resolution) / F.lit(float(resolution))
    return df.where(F.col("score").isNotNull()).groupBy(*keys, score.alias("score")).agg(
        F.count(F.when(F.col("label") == 1, 1)).alias("pos"), F.count(F.when(F.col("label") != 1, 1)).alias("neg")
    )


def roc_curve(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    drop_collinear: bool = True,
    resolution: int | None = None,
    cells_per_task: int | None = None,
) -> DataFrame:
    """(threshold, fpr, tpr), highest threshold first, with the origin at threshold infinity.

    A point is kept when the step to it and the step after it have different
    counts, or when it is first or last.
    """
    keys = list(keys)
    run = running_totals(score_cells(df, keys, resolution), keys, "score", ["pos", "neg"],
                         cells_per_task=cells_per_task)
    points = run
    if drop_collinear:
        first, last = F.col("prev_pos").isNull(), F.col("next_pos").isNull()
        bend = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
        points = run.where(first | last | bend)
    curve = points.select(
        *keys, F.col("score").alias("threshold"),
        _ratio(F.col("cum_neg"), F.col("all_neg")).alias("fpr"), _ratio(F.col("cum_pos"), F.col("all_pos")).alias("tpr"),
    )
    start = run.where(F.col("prev_pos").isNull()).select(
        *keys, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return curve.unionByName(start)


def auc_trapezoid(
    df: DataFrame, keys: Sequence[str] = KEYS, resolution: int | None = None, cells_per_task: int | None = None
) -> DataFrame:
    """Area under the ROC curve by the trapezoid rule; null for a one-class group."""
    keys = list(keys)
    run = running_totals(score_cells(df, keys, resolution), keys, "score", ["pos", "neg"],
                         cells_per_task=cells_per_task)
    # width of the step times mean height, on fractions
    height = (F.col("cum_pos") + F.col("cum_pos") - F.col("pos")) / 2.0 / F.nullif(F.col("all_pos"), F.lit(0))
    width = F.col("neg") / F.nullif(F.col("all_neg"), F.lit(0))
    return run.groupBy(*keys).agg(F.sum(width * height).alias("auc"))


def auc_rank(
    df: DataFrame, keys: Sequence[str] = KEYS, resolution: int | None = None, cells_per_task: int | None = None
) -> DataFrame:
    """AUC as the probability that a positive outranks a negative, ties counting half."""
    keys = list(keys)
    run = running_totals(score_cells(df, keys, resolution), keys, "score", ["pos", "neg"], descending=False,
                         cells_per_task=cells_per_task)
    wins = F.col("pos").cast("double") * (F.col("cum_neg") - F.col("neg") / 2.0)
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return run.groupBy(*keys).agg((F.sum(wins) / F.nullif(pairs, F.lit(0.0))).alias("auc"))


def row_loss(label: str = "label", score: str = "score") -> Column:
    """Binary cross-entropy of a row, logarithms floored at -100."""
    def floored(c: Column) -> Column:
        return F.when(c > 0, F.greatest(F.log(c), F.lit(LOG_FLOOR))).otherwise(F.lit(LOG_FLOOR))

    y, p = F.col(label), F.col(score)
    return -(y * floored(p) + (1 - y) * floored(1 - p))


def log_loss(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(row_loss()).alias("log_loss"))


def log_loss_batched(df: DataFrame, keys: Sequence[str] = KEYS, batch: str = "batch_id") -> DataFrame:
    """Mean over batches of the mean loss inside a batch."""
    per_batch = df.groupBy(*keys, batch).agg(F.avg(row_loss()).alias("__l"))
    return per_batch.groupBy(*keys).agg(F.avg("__l").alias("log_loss"))


def weighted_log_loss(df: DataFrame, weights: dict[int, float], keys: Sequence[str] = KEYS) -> DataFrame:
    """Class-weighted mean loss: sum(w * loss) / sum(w)."""
    w = None
    for label, weight in weights.items():
        w = F.when(F.col("label") == label, weight) if w is None else w.when(F.col("label") == label, weight)
    w = w.otherwise(1.0)
    return df.groupBy(*keys).agg((F.sum(w * row_loss()) / F.sum(w)).alias("log_loss"))


def fixed_threshold_report(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Accuracy, sensitivity, specificity at the report threshold."""
    return threshold_metrics(df, keys, REPORT_THRESHOLD).select(*keys, "accuracy", "sensitivity", "specificity")


def epoch_metrics(
    df: DataFrame, epoch: str = "epoch", every: int = 5, threshold: float = 0.5, batch: str = "batch_id"
) -> DataFrame:
    """Training log: loss, metrics at 0.5 and AUC of every n-th epoch."""
    logged = df.where(F.col(epoch) % every == 0)
    metrics = threshold_metrics(logged, [epoch], threshold)
    return metrics.join(log_loss_batched(logged, [epoch], batch), epoch).join(auc_rank(logged, [epoch]), epoch)


def best_epoch(log: DataFrame, keys: Sequence[str] = ("model",), metric: str = "auc") -> DataFrame:
    """The first epoch whose metric is highest."""
    w = W.partitionBy(*keys).orderBy(F.desc_nulls_last(metric), F.asc("epoch"))
    return log.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def external_validation(df: DataFrame, keys: Sequence[str] = KEYS, threshold: float = 0.5) -> DataFrame:
    """Metrics and AUC of each model on each cohort, from one pass to score cells.

    Confusion counts come from the cells, so the predictions are read once.
    """
    keys = list(keys)
    run = running_totals(score_cells(df, keys), keys, "score", ["pos", "neg"], descending=False)
    hit = F.col("score") >= threshold
    wins = F.col("pos").cast("double") * (F.col("cum_neg") - F.col("neg") / 2.0)
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    counts = run.groupBy(*keys).agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, 0).otherwise(F.col("pos"))).alias("fn"),
        F.sum(F.when(hit, 0).otherwise(F.col("neg"))).alias("tn"),
        F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        (F.sum(wins) / F.nullif(pairs, F.lit(0.0))).alias("auc"),
    )
    return derived_metrics(counts)
