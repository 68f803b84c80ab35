"""Linear discriminant analysis from class moments: one pass over the rows, a closed-form solution of d numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortis.functions.dense import matrix

SUMS = "label double, i int, j int, n double, sx double, sy double, sxy double"


def class_moments(df: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    """(label, i, j, n, mean_i, cov): population moments of the feature vectors of each class.

    Tasks turn their Arrow batches into matrix products of centred rows, so d x d sums of a class leave a task. Rows
    without a label are left out.
    """
    centre = df.select(Summarizer.mean(F.col(features)).alias("m")).first()["m"]
    if centre is None:
        return df.sparkSession.createDataFrame([], "label double, i int, j int, n double, mean_i double, cov double")
    middle = centre.toArray()
    rows = df.where(F.col(label).isNotNull()).select(
        F.col(label).cast("double").alias("label"), vector_to_array(F.col(features)).alias("x"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[float, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            labels, x = batch.column(0).to_numpy(), matrix(batch.column(1)) - middle
            for y in np.unique(labels):
                part = x[labels == y]
                now = totals.setdefault(float(y), [0.0, 0.0, 0.0])
                totals[float(y)] = [now[0] + len(part), now[1] + part.sum(0), now[2] + part.T @ part]
        for y, (n, sx, sxy) in totals.items():
            i, j = (a.ravel().astype(np.int32) for a in np.indices(sxy.shape))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), y)), pa.array(i), pa.array(j), pa.array(np.full(len(i), float(n))),
                 pa.array(sx[i]), pa.array(sx[j]), pa.array(sxy.ravel())],
                names=["label", "i", "j", "n", "sx", "sy", "sxy"])

    added = rows.mapInArrow(sums, SUMS).groupBy("label", "i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxy")])
    offsets = F.array(*[F.lit(float(v)) for v in middle])
    return added.select("label", "i", "j", "n", (offsets[F.col("i")] + F.col("sx") / F.col("n")).alias("mean_i"),
                        ((F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.col("n")).alias("cov"))


class _DiscriminantParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol):
    def __init__(self):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", probabilityCol="probability")


class LinearDiscriminant(_DiscriminantParams, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Two classes of normal vectors with one covariance; the classes' shares are the prior."""

    def __init__(self, featuresCol: str = "features", labelCol: str = "label"):
        super().__init__()
        self._set(featuresCol=featuresCol, labelCol=labelCol)

    def _fit(self, dataset: DataFrame) -> LinearDiscriminantModel:
        rows = class_moments(dataset, self.getFeaturesCol(), self.getLabelCol()).collect()  # d x d numbers a class
        classes = sorted({r["label"] for r in rows})
        if classes != [0.0, 1.0]:
            raise ValueError(f"needs rows of the classes 0 and 1, not {classes}")
        d = 1 + max(r["i"] for r in rows)
        n, means, scatter = np.zeros(2), np.zeros((2, d)), np.zeros((d, d))
        for r in rows:
            c = int(r["label"])
            n[c], means[c, r["i"]] = r["n"], r["mean_i"]
            scatter[r["i"], r["j"]] += r["n"] * r["cov"]
        pooled = scatter / n.sum()
        # Least squares: constant and repeated features leave the covariance singular.
        slopes = np.linalg.lstsq(pooled, means[1] - means[0], rcond=1e-10)[0]
        intercept = np.log(n[1] / n[0]) - 0.5 * float((means[0] + means[1]) @ slopes)
        model = LinearDiscriminantModel(slopes.tolist(), float(intercept))
        return self._copyValues(model)


class LinearDiscriminantModel(_DiscriminantParams, Model, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``probability`` and ``prediction``."""

    coefficients = Param(Params._dummy(), "coefficients", "weight of each feature", TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "log odds at the origin", TypeConverters.toFloat)

    def __init__(self, coefficients: list[float] | None = None, intercept: float = 0.0):
        super().__init__()
        self._set(coefficients=coefficients or [], intercept=intercept)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        weights = F.array(*[F.lit(w) for w in self.getOrDefault(self.coefficients)])
        products = F.zip_with(vector_to_array(F.col(self.getFeaturesCol())), weights, lambda x, w: x * w)
        margin = F.aggregate(products, F.lit(self.getOrDefault(self.intercept)), lambda a, v: a + v)
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("__margin")))
        scored = dataset.withColumn("__margin", margin).withColumn(self.getProbabilityCol(), array_to_vector(F.array(1 - p, p)))
        return scored.withColumn(self.getPredictionCol(), (F.col("__margin") > 0).cast("double")).drop("__margin")
