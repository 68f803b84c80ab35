"""Periodic runs of words: recursive frequency splitting, then a scan of lags in the segments that survive."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_LENGTH = 24  # words of the shortest run
MIN_PERIODS = 3  # periods of the shortest run
GRAM = 8  # words compared at a probe, at most
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def segments(ids: np.ndarray, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[tuple[int, int]]:
    """(start, stop) of the stretches of ``ids`` that may hold a run.

    A run of ``min_periods`` periods holds each of its words that often, and lies within one segment. So a word that
    occurs less often in its segment is in no run and splits the segment there. Parts shorter than a run go; the others
    are counted again on their own, until every word of every segment occurs often enough in it.
    """
    at = np.arange(len(ids))
    label, parts = np.zeros(len(ids), np.int64), [(0, len(ids))] if len(ids) >= min_length else []
    words = int(ids.max()) + 1 if len(ids) else 1
    while parts:
        if len(parts) == 1:
            often = np.bincount(ids[at], minlength=words)[ids[at]] >= min_periods
        else:
            _, inverse, counts = np.unique(label * words + ids[at], return_inverse=True, return_counts=True)
            often = counts[inverse] >= min_periods
        if often.all():
            return parts
        at, label = at[often], label[often]
        cuts = np.flatnonzero((np.diff(at) != 1) | (np.diff(label) != 0)) + 1
        edges = np.concatenate([[0], cuts, [len(at)]])
        sizes = np.diff(edges)
        long = sizes >= min_length
        parts = [(int(at[a]), int(at[a]) + int(n)) for a, n in zip(edges[:-1][long], sizes[long])]
        at = at[np.repeat(long, sizes)]
        label = np.repeat(np.arange(len(parts)), sizes[long])
    return []


def _equal_upto(a: np.ndarray, b: np.ndarray) -> int:
    """The number of leading places at which ``a`` and ``b`` (of one length) are equal."""
    at, step = 0, 64
    while at < len(a):
        apart = np.flatnonzero(a[at:at + step] != b[at:at + step])
        if len(apart):
            return at + int(apart[0])
        at, step = at + step, 4 * step
    return len(a)


def lag_scan(x: np.ndarray, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of ``x``, their smallest periods only.

    A run of period q holds ``m(q) = max(min_length, min_periods q) - q`` places in a row at which the word equals the
    one q places on. So it is enough to compare a few words (a hash of them) at every ``m(q) - grams + 1`` th place:
    all lags together take about n log n probes. A hit is extended to both sides word by word. Lags go upwards, a
    doubling at a time; hits inside a known run at a multiple of its period lead to the same run and are passed over.
    Two periods of one stretch of two or more of the larger have a common divisor that is a period, too, so a stretch
    found before at a smaller lag is that lag's run.
    """
    n = len(x)
    lags = np.arange(1, n // min_periods + 1)
    least = np.maximum(min_length, min_periods * lags) - lags
    lags, least = lags[lags + least <= n], least[lags + least <= n]
    if not len(lags):
        return []
    gram = int(min(GRAM, least.min()))
    mixed = (x.astype(np.uint64) + np.uint64(1)) * SPREAD
    mixed ^= mixed >> np.uint64(29)
    hashes = np.zeros(n - gram + 1, np.uint64)
    for i in range(gram):
        hashes = hashes * SPREAD + mixed[i:n - gram + 1 + i]
    found: list[tuple[int, int, int]] = []
    stretches: set[tuple[int, int]] = set()
    low = 1
    while low <= len(lags):
        q, step = lags[low - 1:2 * low - 1], least[low - 1:2 * low - 1] - gram + 1
        probes = (n - gram - q) // step + 1
        owner = np.repeat(np.arange(len(q)), probes)
        first = np.cumsum(probes) - probes
        place, lag = (np.arange(len(owner)) - first[owner]) * step[owner], q[owner]
        hit = hashes[place] == hashes[place + lag]
        place, lag = place[hit], lag[hit]
        if found:  # the runs that start last before the place; a run that hides behind others is only scanned again
            starts, lengths, periods = np.array(sorted(found)).T
            nearest = np.searchsorted(starts, place, side="right") - 1
            known = np.zeros(len(place), bool)
            for back in range(3):
                i = np.maximum(nearest - back, 0)
                known |= (place >= starts[i]) & (place + lag + gram <= starts[i] + lengths[i]) & (lag % periods[i] == 0)
            place, lag = place[~known], lag[~known]
        reached = (0, 0)  # lag, and the place up to which its last stretch goes
        for p, d in zip(place.tolist(), lag.tolist()):
            if reached[0] == d and p < reached[1]:
                continue
            if any(s <= p and p + d + gram <= s + length and d % period == 0 for s, length, period in found[-8:]):
                continue
            right = p + _equal_upto(x[p:n - d], x[p + d:])
            left = p - _equal_upto(x[:p][::-1], x[d:p + d][::-1])
            reached = (d, right)
            if right - left >= max(min_length, min_periods * d) - d and (left, right + d) not in stretches:
                stretches.add((left, right + d))
                found.append((left, right + d - left, d))
        low *= 2
    return found


def runs_of(words: list[bytes], min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of ``words``, by start, then period."""
    if len(words) < min_length:
        return []
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    found = []
    for start, stop in segments(ids, min_length, min_periods):
        found += [(start + s, length, q) for s, length, q in lag_scan(ids[start:stop], min_length, min_periods)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS, text: str = "text") -> DataFrame:
    """``docs`` with ``runs``, an array of (start, length, period), and ``text`` with each run cut to its first period.

    Words are the runs of bytes other than space and ASCII control spaces, numbered from 0. A run is a stretch of words
    that equals itself moved by its smallest period, has ``min_length`` words and ``min_periods`` periods or more, and
    that no neighbouring word extends. Runs are ordered by start, then period. The new text joins by one space the
    words that lie in no run after its first period, so a text without runs only loses its odd spaces.

    Each document is on its own: there is no shuffle, and a batch holds what its texts take. A null text stays null and
    has no runs; an empty one or one of spaces becomes empty. Repeated rows have equal results. A column named ``runs``
    is replaced; an empty table gives none.
    """
    if min_periods < 2 or min_length < min_periods:
        raise ValueError("runs need two periods or more, and as many words")
    kept = [c for c in docs.columns if c not in ("runs", text)]
    source = docs.select(F.struct(F.lit(0).alias("__row"), *[F.col(f"`{c}`") for c in kept]).alias("row"),
                         F.col(text).cast("string").alias("text"))
    schema = T.StructType([source.schema["row"], T.StructField("text", T.StringType()),
                           T.StructField("runs", T.ArrayType(RUN))])
    run_type = pa.list_(pa.struct([(n, pa.int64()) for n in RUN.names]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = [], []
            for value in batch.column(1).cast(pa.binary()).to_pylist():
                words = [] if value is None else value.split()
                runs = runs_of(words, min_length, min_periods)
                if runs:
                    stays = np.ones(len(words), bool)
                    for start, length, period in runs:
                        stays[start + period:start + length] = False
                    words = [w for w, stay in zip(words, stays.tolist()) if stay]
                texts.append(None if value is None else b" ".join(words))
                spans.append([dict(zip(RUN.names, r)) for r in runs])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.binary()).view(pa.string()), pa.array(spans, run_type)],
                names=schema.names)

    done = source.mapInArrow(scan, schema)
    return done.select(*[F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c)
                         for c in docs.columns if c != "runs"], "runs")
