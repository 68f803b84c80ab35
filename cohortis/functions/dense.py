"""Dense layers and attention maps as Arrow-batched column functions.

A batch of equal-length vectors is one NumPy matrix without copying: the values
of the Arrow list array, reshaped. Array lambdas on the JVM do the same work
element by element, outside generated code, about fifty times slower.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

TILE = 256
MAP_VALUES = 1 << 20  # numbers of maps that a task holds and hands over at a time


def stack(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(float)


def matrix(col: pa.Array) -> np.ndarray:
    """Rows of a list array as a matrix; vectors must be present and of one length."""
    if col.null_count:
        raise ValueError("vectors must not be null")
    values = col.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    if len(values) % len(col):
        raise ValueError("vectors must have one length")
    return values.reshape(len(col), -1)


def lists(m: np.ndarray) -> pa.Array:
    """A matrix as a list array."""
    offsets = np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(m).ravel()))


def nested(t: np.ndarray) -> pa.Array:
    """(rows, i, j) as a list of lists."""
    rows, i, j = t.shape
    inner = lists(t.reshape(rows * i, j))
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * i), inner)


def vector_function(fn: Callable[..., np.ndarray], kind: str = "array<double>"):
    """Column function from a function of matrices; empty batches give empty results.

    A map has width x width numbers a row, so maps leave a task in pieces of a batch, about MAP_VALUES numbers each.
    """
    pack = {"array<double>": lists, "array<array<double>>": nested, "double": pa.array}[kind]
    empty = {"array<double>": pa.list_(pa.float64()), "array<array<double>>": pa.list_(pa.list_(pa.float64())),
             "double": pa.float64()}[kind]

    def one(x: pa.Array) -> pa.Array:
        return pack(fn(matrix(x))) if len(x) else pa.array([], empty)

    if kind != "array<array<double>>":
        return F.arrow_udf(one, kind)

    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            if not len(x):
                yield one(x)
                continue
            m = matrix(x)
            step = max(1, MAP_VALUES // max(1, m.shape[1]) ** 2)
            for i in range(0, len(m), step):
                yield pack(fn(m[i:i + step]))

    return F.arrow_udf(pieces, kind)


def dense(weights, bias, activation: str | None = None):
    """Column function x -> act(W x + b) for W of shape (out, in)."""
    w, b = np.asarray(weights, float), np.asarray(bias, float)

    def layer(x: np.ndarray) -> np.ndarray:
        h = x @ w.T + b
        return np.maximum(h, 0.0) if activation == "relu" else h

    return vector_function(layer)


def logit_head(weights, bias: float):
    """Column function x -> sigmoid(w . x + b)."""
    w = np.asarray(weights, float)
    return vector_function(lambda x: 1.0 / (1.0 + np.exp(-(x @ w + bias))), "double")


def softmax_maps(theta: np.ndarray, phi: np.ndarray, causal: bool = False) -> np.ndarray:
    """Softmax over j of theta_i * phi_j for a batch, shape (rows, i, j)."""
    s = theta[:, :, None] * phi[:, None, :]
    if causal:
        s[:, np.arange(s.shape[1])[:, None] < np.arange(s.shape[2])] = -np.inf
    s -= s.max(2, keepdims=True)
    np.exp(s, out=s)
    s /= s.sum(2, keepdims=True)
    return s


def attend(q: np.ndarray, k: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Maps applied to v, in tiles so that one tile of maps is held at a time."""
    out = np.empty_like(q)
    for i in range(0, len(q), TILE):
        t = slice(i, i + TILE)
        out[t] = np.einsum("bij,bj->bi", softmax_maps(q[t], k[t]), v[t])
    return out


def max_pool(x: np.ndarray, width: int = 2) -> np.ndarray:
    """Maximum of runs of ``width`` neighbours; an incomplete tail is left out."""
    n = x.shape[1] // width
    return x[:, :n * width].reshape(len(x), n, width).max(2)
