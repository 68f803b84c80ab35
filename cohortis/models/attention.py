"""The attention classifier: the attention block as a pipeline stage before Spark's multilayer perceptron.

    theta, phi, g   scalar affine maps of each feature
    A_ij            softmax over j of theta_i * phi_j
    z               w * (A g) + v + x
    score           perceptron(standardised z)

The stage has no state but the numbers of its maps, so a fitted pipeline can be saved and read again. The maps are
drawn from a seed; of several draws the one with the best validation AUC is kept. Scoring runs in Arrow batches, the
perceptron is trained by Spark over all partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortis.functions.dense import TILE, softmax_maps, vector_function
from cohortis.models.classifiers import positive_score
from cohortis.operators.evaluate import auc_rank
from cohortis.operators.interact import BN_EPS, Projections, attention_output

MAPS = ("theta", "phi", "g", "out")


class AttentionOutput(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the attention block's output, a vector, for the vector in ``inputCol``."""

    theta = Param(Params._dummy(), "theta", "slope and offset of theta", TypeConverters.toListFloat)
    phi = Param(Params._dummy(), "phi", "slope and offset of phi", TypeConverters.toListFloat)
    g = Param(Params._dummy(), "g", "slope and offset of g", TypeConverters.toListFloat)
    out = Param(Params._dummy(), "out", "slope and offset of the output map", TypeConverters.toListFloat)
    subSample = Param(Params._dummy(), "subSample", "halve phi and g by max pooling", TypeConverters.toBoolean)

    def __init__(self, inputCol: str = "features", outputCol: str = "attended", projections: Projections = Projections(),
                 subSample: bool = False):
        super().__init__()
        self._setDefault(subSample=False, **{n: [1.0, 0.0] for n in MAPS})
        self._set(inputCol=inputCol, outputCol=outputCol, subSample=subSample,
                  **{n: list(map(float, getattr(projections, n))) for n in MAPS})

    @property
    def projections(self) -> Projections:
        """The maps, for ``mean_attention_table``."""
        return Projections(*[tuple(self.getOrDefault(n)) for n in MAPS])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        x = vector_to_array(F.col(self.getInputCol()))
        z = attention_output(x, self.projections, self.getOrDefault(self.subSample))
        return dataset.withColumn(self.getOutputCol(), array_to_vector(z))


def drawn_projections(seed: int) -> Projections:
    """Slopes and offsets of the four maps, uniform as Glorot's rule has it for one input and output."""
    limit = np.sqrt(6.0 / 2.0)
    return Projections(*[tuple(p) for p in np.random.default_rng(seed).uniform(-limit, limit, (4, 2)).tolist()])


def attention_pipeline(
    n_features: int, projections: Projections, hidden: int = 300, iterations: int = 40, features: str = "features",
    label: str = "label", seed: int = 42, sub_sample: bool = False,
) -> Pipeline:
    """Attention block, standardisation and perceptron as one unfitted pipeline."""
    return Pipeline(stages=[
        AttentionOutput(features, "attended", projections, sub_sample),
        StandardScaler(inputCol="attended", outputCol="normed", withMean=True, withStd=True),
        MultilayerPerceptronClassifier(featuresCol="normed", labelCol=label, layers=[n_features, hidden, 2],
                                       maxIter=iterations, blockSize=64, seed=seed),
    ])


@dataclass(frozen=True)
class AttentionClassifier:
    """Settings of a fit. Defaults follow the study: 300 hidden units, 40 rounds."""

    features: str = "features"
    label: str = "label"
    hidden: int = 300
    iterations: int = 40
    draws: Sequence[int] = (42, 43, 44)
    sub_sample: bool = False

    def fit(self, df: DataFrame, validation: DataFrame) -> tuple[PipelineModel, list[dict]]:
        """The pipeline of the draw with the best AUC on ``validation`` (the first, on a tie), and every draw's AUC."""
        n = df.select(F.size(vector_to_array(F.col(self.features))).alias("n")).first()["n"]
        train, seen = df.persist(), validation.persist()
        best, best_auc, history = None, float("-inf"), []
        for seed in self.draws:
            pipeline = attention_pipeline(n, drawn_projections(seed), self.hidden, self.iterations, self.features,
                                          self.label, seed, self.sub_sample)
            model = pipeline.fit(train)
            scored = positive_score(model, seen).select(
                F.lit("v").alias("model"), F.col(self.label).alias("label"), "score")
            auc = auc_rank(scored, ["model"]).first()["auc"]
            history.append({"seed": seed, "auc": auc})
            if best is None or (auc is not None and auc > best_auc):
                best, best_auc = model, float("-inf") if auc is None else auc
        train.unpersist()
        seen.unpersist()
        return best, history


def score_batch(p: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The network in evaluation mode: stored statistics, no dropout."""
    out = np.empty(len(x))
    for i in range(0, len(x), TILE):
        t = x[i:i + TILE]
        theta, phi, g = (t * p[n][0] + p[n][1] for n in ("theta", "phi", "g"))
        y = np.einsum("bij,bj->bi", softmax_maps(theta, phi), g)
        u = p["out"][0] * y + p["out"][1]
        z = (u - p["mean1"]) / np.sqrt(p["var1"] + BN_EPS) * p["bn1"][0] + p["bn1"][1] + t
        h = (z @ p["w1"].T + p["b1"] - p["mean"]) / np.sqrt(p["var"] + BN_EPS) * p["bn"][0] + p["bn"][1]
        out[i:i + TILE] = 1.0 / (1.0 + np.exp(-(np.maximum(h, 0) @ p["w2"] + p["b2"][0])))
    return out


@dataclass
class AttentionNetwork:
    """A network whose parameters are given, for scoring in batches."""

    params: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def from_parts(p: Projections, w1, b1, w2, b2, mean, var) -> "AttentionNetwork":
        hidden = len(np.asarray(w1))
        given = {"theta": p.theta, "phi": p.phi, "g": p.g, "out": p.out, "w1": w1, "b1": b1, "w2": w2, "b2": [b2],
                 "mean": mean, "var": var, "mean1": [0.0], "var1": [1.0], "bn1": [1.0, 0.0],
                 "bn": [np.ones(hidden), np.zeros(hidden)]}
        return AttentionNetwork({name: np.array(values, float) for name, values in given.items()})

    @property
    def projections(self) -> Projections:
        """The scalar maps, for ``mean_attention_table``."""
        return Projections(*[tuple(map(float, self.params[n])) for n in MAPS])

    def score(self, df: DataFrame, features: str = "x", out: str = "score") -> DataFrame:
        params = self.params
        run = vector_function(lambda x: score_batch(params, x), "double")
        return df.withColumn(out, run(F.col(features)))
