"""Grid search by balanced accuracy over given folds, and choices on fold-score tables."""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

FOLD_SCHEMA = "candidate int, params string, fold int, score double"
ROWS_SIDE_BY_SIDE = 4_000_000  # training rows of the fits that run at the same time


class BalancedAccuracyEvaluator(Evaluator):
    """Mean recall over the classes present, from one aggregate by label."""

    def __init__(self, label: str = "label", prediction: str = "prediction"):
        super().__init__()
        self.label, self.prediction = label, prediction

    def _evaluate(self, dataset: DataFrame) -> float:
        hit = (F.col(self.prediction) == F.col(self.label)).cast("double")
        recalls = dataset.groupBy(self.label).agg(F.avg(hit).alias("recall"))
        value = recalls.agg(F.avg("recall")).first()[0]
        return float("nan") if value is None else value

    def isLargerBetter(self) -> bool:
        return True


def assemble(df: DataFrame, features: Sequence[str], label: str, keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., features vector, label double)."""
    # the assembler wants plain names
    plain = {c: f"f{i}" for i, c in enumerate(features)}
    named = df.select(*[F.col(f"`{c}`") for c in keep], F.col(label).cast("double").alias("label"),
                      *[F.col(f"`{c}`").cast("double").alias(n) for c, n in plain.items()])
    out = VectorAssembler(inputCols=list(plain.values()), outputCol="features").transform(named)
    return out.drop(*plain.values())


def fits_at_once(rows: int, candidates: int, parallelism: int) -> int:
    """How many candidates to fit side by side on ``rows`` training rows.

    Each fit caches its own copy of the rows. Small fits leave cores idle alone; of a large table one copy already
    fills the cluster, and several would push one another to disk, to be read again in every iteration.
    """
    return max(1, min(parallelism, candidates, ROWS_SIDE_BY_SIDE // max(1, rows)))


def _score_candidates(
    df: DataFrame, candidates: list[tuple[Estimator, dict]], fold: str, folds: int, evaluator: Evaluator, parallelism: int
) -> list[tuple[int, int, float]]:
    """(candidate, fold, score), each candidate fitted on the fold's other rows.

    Training and held-out rows of a fold are plain filters on the fold column, cached once for all its candidates.
    """
    results = []
    for i in range(folds):
        train = df.where(F.col(fold) != i).persist()
        held_out = df.where(F.col(fold) == i).persist()

        def run(c: int, train=train, held_out=held_out) -> float:
            estimator, params = candidates[c]
            return evaluator.evaluate(estimator.fit(train, params).transform(held_out))

        with ThreadPool(fits_at_once(train.count(), len(candidates), parallelism)) as pool:
            results += [(c, i, float(score)) for c, score in enumerate(pool.map(run, range(len(candidates)), 1))]
        train.unpersist()
        held_out.unpersist()
    return results


def grid_search(
    df: DataFrame, estimator: Estimator, settings: list[dict], fold: str = "fold", folds: int = 5,
    evaluator: Evaluator | None = None, parallelism: int = 4,
) -> tuple[Model, DataFrame]:
    """Best model, refitted on all rows, and the (candidate, params, fold, score) table.

    The candidates of a fold are fitted side by side while their rows are few (``fits_at_once``).
    """
    maps = [{estimator.getParam(k): v for k, v in s.items()} for s in settings]
    scores = _score_candidates(df, [(estimator, m) for m in maps], fold, folds, evaluator or BalancedAccuracyEvaluator(),
                               parallelism)
    results = [(c, str(settings[c]), i, score) for c, i, score in scores]
    means = {c: sum(s for cc, _, _, s in results if cc == c) / folds for c in range(len(maps))}
    best = max(sorted(means), key=lambda c: means[c])
    return estimator.fit(df, maps[best]), df.sparkSession.createDataFrame(results, FOLD_SCHEMA)


def select_best(fold_scores: DataFrame, keys: Sequence[str] = ("candidate",)) -> DataFrame:
    """The candidate with the highest mean score; the lowest on a tie. One row per candidate is ranked."""
    means = fold_scores.groupBy(*keys).agg(F.round(F.avg("score"), 12).alias("mean_score"))
    w = W.partitionBy(F.lit(1)).orderBy(F.desc_nulls_last("mean_score"), *keys)
    return means.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def bake_off(fold_scores: DataFrame, key: str = "model") -> DataFrame:
    """Mean and spread of the fold scores per model, with its place."""
    means = fold_scores.groupBy(key).agg(F.round(F.avg("score"), 12).alias("mean_score"),
                                         F.stddev_pop("score").alias("std_score"))
    w = W.partitionBy(F.lit(1)).orderBy(F.desc("mean_score"), key)
    return means.withColumn("place", F.row_number().over(w))


def cross_validate(
    df: DataFrame, models: dict[str, Estimator], fold: str = "fold", folds: int = 5, evaluator: Evaluator | None = None
) -> DataFrame:
    """(model, fold, score) of several estimators, for ``bake_off``.

    A fold's rows are cached once for all estimators. Nothing is fitted on all rows: no such model is returned.
    """
    names = list(models)
    scores = _score_candidates(df, [(models[n], {}) for n in names], fold, folds, evaluator or BalancedAccuracyEvaluator(), 1)
    spark: SparkSession = df.sparkSession
    return spark.createDataFrame([(names[c], i, s) for c, i, s in scores], "model string, fold int, score double")
