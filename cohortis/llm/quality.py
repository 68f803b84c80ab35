"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 20_000  # labelled rows that a model is fitted on, about
TREES, DEPTH, BINS = 60, 4, 64
RATE, RIDGE, MIN_ROWS = 0.2, 1.0, 20

STATISTICS = (
    "log_bytes", "log_words", "bytes_per_word", "upper", "digits", "spaces", "lines", "beyond_ascii", "stops", "commas",
    "bars", "exclamations", "symbols", "distinct_words", "repeated_next", "top_word", "words_per_stop", "words_per_line",
)
# Byte classes whose shares are statistics, in the order of STATISTICS[3:13].
CLASSES = (
    bytes(range(65, 91)), bytes(range(48, 58)), b" \t", b"\n", bytes(range(128, 256)), b".?", b",;:", b"|", b"!",
    b"#$%&*+/<=>@\\^_`{}~",
)


def statistics(texts: list[str | None]) -> np.ndarray:
    """One row of document statistics for each text; all zero for a null, empty or blank one."""
    table = np.zeros((len(texts), len(STATISTICS)))
    classes = np.zeros(256, np.int64)
    for i, members in enumerate(CLASSES):
        classes[list(members)] = i + 1
    for row, text in zip(table, texts):
        raw = (text or "").encode()
        words = raw.split()
        if not words:
            continue
        size, n = len(raw), len(words)
        by_class = np.bincount(classes, weights=np.bincount(np.frombuffer(raw, np.uint8), minlength=256),
                               minlength=len(CLASSES) + 1)[1:]
        counts = Counter(words)
        row[:3] = np.log1p(size), np.log1p(n), sum(map(len, words)) / n
        row[3:13] = by_class / size
        row[13:] = (len(counts) / n, sum(map(eq, words, words[1:])) / n, max(counts.values()) / n,
                    n / (1 + by_class[5]), n / (1 + by_class[3]))
    return table


@dataclass
class Trees:
    """Boosted trees of one depth, flattened: node i of a tree has the children 2 i + 1 and 2 i + 2."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # trees x inner nodes; greater values go right
    value: np.ndarray  # trees x leaves
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row: all rows go down one tree at a time, level by level."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += value[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS,
              rate: float = RATE, ridge: float = RIDGE, min_rows: int = MIN_ROWS) -> Trees:
    """Gradient boosting of the logistic loss on binned columns.

    A level's gradients and Hessians are added up by (node, column, bin) in one count each; a node splits at the bin
    with the largest gain. Without both labels the trees are empty and every score is the share of label 1, shrunk to
    one half.
    """
    share = (y.sum() + 0.5) / (len(y) + 1)
    inner, leaves = 2**depth - 1, 2**depth
    if not 0 < y.sum() < len(y):
        trees = 0
    model = Trees(float(np.log(share / (1 - share))), np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf),
                  np.zeros((trees, leaves)), depth)
    if not trees:
        return model
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
    columns = x.shape[1]
    flat = binned + np.arange(columns) * bins
    allowed = np.arange(bins)[None, :] < np.array([len(c) for c in cuts])[:, None]
    score = np.full(len(y), model.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        gradient, hessian = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            at = ((node - first)[:, None] * (columns * bins) + flat).ravel()
            shape = (width, columns, bins)
            g, h, n = (np.bincount(at, np.repeat(w, columns), width * columns * bins).reshape(shape).cumsum(axis=2)
                       for w in (gradient, hessian, np.ones(len(y))))
            g_all, h_all, n_all = (v[:, :, -1:] for v in (g, h, n))
            gain = g**2 / (h + ridge) + (g_all - g)**2 / (h_all - h + ridge) - g_all**2 / (h_all + ridge)
            gain[(n < min_rows) | (n_all - n < min_rows) | ~allowed[None]] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                column, edge = divmod(int(best[k]), bins)
                if gain[k, column, edge] > 1e-9:
                    model.feature[t, first + k] = column
                    model.cut[t, first + k] = cuts[column][edge]
            node = 2 * node + 1 + (x[np.arange(len(y)), model.feature[t, node]] > model.cut[t, node])
        leaf = node - inner
        g, h = np.bincount(leaf, gradient, leaves), np.bincount(leaf, hessian, leaves)
        model.value[t] = -rate * g / (h + ridge)
        score += model.value[t][leaf]
    return model


def _arrow_statistics(batch: pa.RecordBatch) -> np.ndarray:
    return statistics(batch.column(1).to_pylist())


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, text: str = "text",
                key: str = "doc_id", label: str = "quality") -> Trees:
    """Fits on labelled documents, at most about ``sample_rows`` of them, chosen by a hash of their ids.

    ``labels`` (key, label 0/1) must hold the rows to learn from only. Null ids and labels are left out; an id with
    several labels counts once, by their mean. Of rows that repeat an id the one with the smallest statistics counts, so
    one row for each id of the sample (a fixed number of doubles) is all that reaches the driver. Without labelled documents every score is one half.
    """
    clean = (labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("id"))
             .agg((F.avg(label) >= 0.5).cast("int").alias("y")))
    n = clean.count()
    if n > sample_rows:
        span = 1 << 30
        clean = clean.filter(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(span)) < int(span * sample_rows / n))
    source = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(clean), "id")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.array(list(_arrow_statistics(batch)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), rows, batch.column(2)], names=["id", "x", "y"])

    sample = source.mapInArrow(scan, "id long, x array<double>, y int").groupBy("id", "y").agg(F.min("x").alias("x"))
    rows = sorted(sample.collect(), key=lambda r: r["id"])
    x = np.array([r["x"] for r in rows]).reshape(-1, len(STATISTICS))
    return fit_trees(x, np.array([r["y"] for r in rows], np.float64))


def score_quality(docs: DataFrame, model: Trees, text: str = "text", out: str = "score",
                  keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``out``, the probability of good quality of each whole text.

    A null, empty or blank text is scored by its statistics, all zero. A column named ``out`` is replaced; the text
    alone decides the score. Each task scores its own rows with the flattened trees, some tens of kilobytes.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c != out]
    source = docs.select(F.lit(0).alias("__none"), F.col(f"`{text}`").alias("__text"), *[F.col(f"`{c}`") for c in kept])
    schema = source.select(*[F.col(f"`{c}`") for c in kept], F.lit(0.0).alias(out)).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(shared.value.score(_arrow_statistics(batch)))
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], scores], names=schema.names)

    return source.mapInArrow(scan, schema)
