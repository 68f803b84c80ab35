"""Feature-interaction (attention) operators on array columns.

One row's features attend to each other: row i of the map is the softmax over j
of theta_i * phi_j. The d x d work of a row is done on Arrow batches; the mean map
over many rows sums maps inside each task, so d x d numbers leave a task instead
of d x d per row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortis.functions import arrays as A
from cohortis.functions.dense import TILE, attend, max_pool, softmax_maps, stack, vector_function

BN_EPS = 1e-5
LN_EPS = 1e-12


@dataclass(frozen=True)
class Projections:
    """Scalar affine maps of the one-channel block: theta, phi, g and the output map."""

    theta: tuple[float, float] = (1.0, 0.0)
    phi: tuple[float, float] = (1.0, 0.0)
    g: tuple[float, float] = (1.0, 0.0)
    out: tuple[float, float] = (1.0, 0.0)


def _affine(x: np.ndarray, p: tuple[float, float]) -> np.ndarray:
    return x * p[0] + p[1]


def attention_map(x: Column, p: Projections, sub_sample: bool = False, causal: bool = False) -> Column:
    """Map of each row: array (i) of softmax over j of theta_i * phi_j."""
    def maps(m: np.ndarray) -> np.ndarray:
        theta, phi = _affine(m, p.theta), _affine(m, p.phi)
        phi = max_pool(phi) if sub_sample else phi
        out = np.empty((len(m), theta.shape[1], phi.shape[1]))
        for i in range(0, len(m), TILE):
            out[i:i + TILE] = softmax_maps(theta[i:i + TILE], phi[i:i + TILE], causal)
        return out

    return vector_function(maps, "array<array<double>>")(x)


def interaction_map(x: Column, causal: bool = False) -> Column:
    """The map without learned projections."""
    return attention_map(x, Projections(), causal=causal)


def outer_attention(x: Column) -> Column:
    """softmax(x_i * x_j) applied to x: one number per i. The map itself is not kept."""
    return vector_function(lambda m: attend(m, m, m))(x)


def attention_output(x: Column, p: Projections, sub_sample: bool = False) -> Column:
    """Residual output z = W(A g) + x."""
    def block(m: np.ndarray) -> np.ndarray:
        g, phi = _affine(m, p.g), _affine(m, p.phi)
        if sub_sample:
            g, phi = max_pool(g), max_pool(phi)
        return _affine(attend(_affine(m, p.theta), phi, g), p.out) + m

    return vector_function(block)(x)


def mean_attention_table(
    df: DataFrame, x: str, p: Projections = Projections(), names: Sequence[str] | None = None,
    first: int | None = None, key: str | None = None,
) -> DataFrame:
    """(row_feature, col_feature, weight): the attention map averaged over rows.

    ``first`` with ``key`` restricts the mean to the first rows in key order, as
    when only the first batch is inspected; the default is every row.
    """
    source = df if first is None else df.orderBy(key).limit(first)
    a, b = p.theta
    c, d = p.phi

    def sums(batches):
        total, rows = None, 0
        for pdf in batches:
            if not len(pdf):
                continue
            m = stack(pdf["x"])
            for i in range(0, len(m), TILE):
                t = m[i:i + TILE]
                part = softmax_maps(a * t + b, c * t + d).sum(0)
                total = part if total is None else total + part
            rows += len(m)
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel().astype("int32"), "j": j.ravel().astype("int32"),
                                "s": total.ravel(), "n": rows})

    parts = source.select(F.col(x).alias("x")).mapInPandas(sums, "i int, j int, s double, n bigint")
    table = parts.groupBy("i", "j").agg((F.sum("s") / F.sum("n")).alias("weight"))
    if names is None:
        return table.select(F.col("i").alias("row_feature"), F.col("j").alias("col_feature"), "weight")
    labels = F.array(*[F.lit(n) for n in names])
    return table.select(labels[F.col("i")].alias("row_feature"), labels[F.col("j")].alias("col_feature"), "weight")


@dataclass(frozen=True)
class BatchStats:
    mean: tuple[float, ...]
    var: tuple[float, ...]

    def apply(self, x: Column, eps: float = BN_EPS) -> Column:
        """(x - mean) / sqrt(var + eps) per position, with unit weight and zero bias."""
        shift = F.array(*[F.lit(float(m)) for m in self.mean])
        scale = F.array(*[F.lit(1.0 / math.sqrt(v + eps)) for v in self.var])
        return F.zip_with(F.zip_with(x, shift, lambda a, m: a - m), scale, lambda a, s: a * s)


def batch_stats(df: DataFrame, x: str) -> BatchStats:
    """Mean and population variance per position, in one aggregate; 2 x d numbers come back."""
    row = df.select(Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(F.col(x))).alias("s")).select(
        vector_to_array("s.mean").alias("m"), vector_to_array("s.variance").alias("v"), "s.count").first()
    n = row["count"]
    return BatchStats(tuple(row["m"]), tuple(v * (n - 1) / n for v in row["v"]))


def batch_norm(df: DataFrame, x: str, out: str | None = None, stats: BatchStats | None = None) -> DataFrame:
    """Batch normalisation over the whole frame, or with stored statistics at scoring."""
    return df.withColumn(out or x, (stats or batch_stats(df, x)).apply(F.col(x)))


def layer_norm(x: Column, eps: float = LN_EPS) -> Column:
    return A.standardise(x, eps)


def _feed_forward(x: np.ndarray, weights, bias) -> np.ndarray:
    return np.maximum(x @ np.asarray(weights).T + bias, 0.0) + x


def feed_forward_block(df: DataFrame, x: str, weights, bias, stats: BatchStats | None = None) -> DataFrame:
    """BN(relu(W x + b) + x)."""
    layer = vector_function(lambda m: _feed_forward(m, weights, bias))
    return batch_norm(df.withColumn(x, layer(F.col(x))), x, stats=stats)


@dataclass(frozen=True)
class AttentionWeights:
    """(weights, bias) of the q, k, v and final linear layers."""

    q: tuple
    k: tuple
    v: tuple
    final: tuple


def _attention(x: np.ndarray, w: AttentionWeights) -> np.ndarray:
    """final(attend(q(x), k(x), v(x))) + x for a batch."""
    q, k, v = (x @ np.asarray(m).T + c for m, c in (w.q, w.k, w.v))
    return attend(q, k, v) @ np.asarray(w.final[0]).T + w.final[1] + x


def attention_block(df: DataFrame, x: str, w: AttentionWeights, stats: BatchStats | None = None) -> DataFrame:
    """BN(final(attend(q(x), k(x), v(x))) + x): one Arrow pass, then normalisation."""
    layer = vector_function(lambda m: _attention(m, w))
    return batch_norm(df.withColumn(x, layer(F.col(x))), x, stats=stats)


@dataclass(frozen=True)
class StackWeights:
    """Encoder/decoder stack: embedding, per-layer attention and feed-forward weights, head, stored statistics."""

    embed: tuple
    encoder: tuple[tuple[AttentionWeights, tuple], ...]
    decoder: tuple[tuple[AttentionWeights, tuple], ...]
    head: tuple
    stats: BatchStats


def encoder_score(df: DataFrame, x: str, w: StackWeights, out: str = "score") -> DataFrame:
    """Score of the encoder/decoder stack with stored normalisation statistics, in one Arrow pass.

    Every decoder layer reads the encoder output, so only the last one counts.
    """
    mean, scale = np.array(w.stats.mean), 1.0 / np.sqrt(np.array(w.stats.var) + BN_EPS)

    def run(src: np.ndarray) -> np.ndarray:
        h = (attend(src, src, src) @ np.asarray(w.embed[0]).T + w.embed[1] - mean) * scale
        for attention, (weights, bias) in [*w.encoder, w.decoder[-1]]:
            h = (_attention(h, attention) - mean) * scale
            h = (_feed_forward(h, weights, bias) - mean) * scale
        return 1.0 / (1.0 + np.exp(-(h @ np.asarray(w.head[0]) + w.head[1])))

    return df.withColumn(out, vector_function(run, "double")(F.col(x)))


def position_encode(x: Column, pos: Column, d_model: int) -> Column:
    """x * sqrt(d) plus the sinusoid of its position; even places sine, odd places cosine."""
    def wave(v: Column, i: Column) -> Column:
        angle = pos.cast("double") / F.pow(F.lit(10000.0), F.lit(2.0) * i / F.lit(float(d_model)))
        return v * F.lit(math.sqrt(d_model)) + F.when(i % 2 == 0, F.sin(angle)).otherwise(F.cos(angle))

    return F.transform(x, wave)
