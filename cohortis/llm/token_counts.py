"""Token counts by a map-side two-tier lookup of pre-token lengths."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_ENTRIES = 65_536  # most entries of the broadcast table
TABLE_BYTES = 64  # longest pre-token in it: the table stays under 5 MB
TASK_ENTRIES = 4_096  # frequent pre-tokens that one task reports
TASK_KEYS = 200_000  # pre-tokens that a task counts at a time
CACHE_ENTRIES = 200_000  # pre-tokens that a worker remembers
MARK = "\u2581"  # how the model writes a space


def frequent_pretokens(docs: DataFrame, text: str) -> list[str]:
    """The most frequent space-separated pre-tokens of all texts, at most TABLE_ENTRIES.

    Each task counts its own texts (halving its counters whenever they pass TASK_KEYS, as lossy counting does) and
    reports its TASK_ENTRIES most frequent; only those reports are added up. The list decides speed alone, never a
    result.
    """
    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                counts.update(value.split(" "))
                if len(counts) > TASK_KEYS:
                    counts = Counter(dict(counts.most_common(TASK_KEYS // 2)))
        top = [(w, c) for w, c in counts.most_common(TASK_ENTRIES) if w and len(w.encode()) <= TABLE_BYTES]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()),
                                          pa.array([c for _, c in top], pa.int64())], names=["word", "n"])

    reports = docs.select(F.col(text)).filter(F.col(text).isNotNull()).mapInArrow(report, "word string, n long")
    top = reports.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(TABLE_ENTRIES)
    return [r["word"] for r in top.collect()]


class LengthTable:
    """Pre-token lengths in a compact form: one joined string and one byte a length; a dict once in a worker."""

    def __init__(self, words: list[str], lengths: list[int]):
        pairs = [(w, n) for w, n in zip(words, lengths) if "\0" not in w and n < 256]
        self.joined = "\0".join(w for w, _ in pairs)
        self.lengths = np.array([n for _, n in pairs], np.uint8)

    def lookup(self) -> dict[str, int]:
        return dict(zip(self.joined.split("\0"), self.lengths.tolist())) if len(self.lengths) else {}


def count_tokens(docs: DataFrame, model: bytes, text: str = "text", out: str = "n_tokens",
                 keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``out``, the tokens of the whole text under a sentencepiece BPE model (no begin or end tokens).

    Such a model's pieces hold space marks only at their start, so a text of words with single spaces between them
    is encoded word by word: the count is the sum of the words' counts. Frequent words are looked up in a broadcast
    table of bounded size, others in a bounded cache of the worker, misses are encoded by the library. A text with
    leading, trailing or double spaces, or with the mark's own character, is encoded whole: there pieces of several
    marks may reach over words. No pre-token is shuffled; texts stay in their task. ``model``
    (the model file's bytes, a file of fixed size) is broadcast.

    A null or empty text has 0 tokens. Very long texts are counted whole. A column named ``out`` is replaced; others
    pass through.
    """
    import sentencepiece

    spark: SparkSession = docs.sparkSession
    encoder = sentencepiece.SentencePieceProcessor(model_proto=model)
    if any(MARK in encoder.id_to_piece(i).lstrip(MARK) for i in range(encoder.vocab_size())):
        raise ValueError("pieces of this model cross word boundaries; its texts can't be counted word by word")
    words = frequent_pretokens(docs, text)
    lengths = [len(ids) for ids in encoder.encode(words, num_threads=1)] if words else []
    shared = spark.sparkContext.broadcast((model, LengthTable(words, lengths)))
    kept = [c for c in (docs.columns if keep is None else keep) if c != out]
    source = docs.select(F.col(f"`{text}`").alias("__text"), *[F.col(f"`{c}`") for c in kept])
    names = [*kept, out]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        proto, table = shared.value
        library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        known, cache = table.lookup(), {}

        def length(value: str | None) -> int:
            if not value:
                return 0
            parts = value.split(" ")
            if "" in parts or MARK in value:
                return len(library.encode(value))
            total, missed = 0, []
            for part in parts:
                n = known.get(part) or cache.get(part)
                if n is None:
                    missed.append(part)
                else:
                    total += n
            if missed:
                new = dict.fromkeys(missed)
                for part, ids in zip(new, library.encode(list(new), num_threads=1)):
                    new[part] = len(ids)
                total += sum(map(new.get, missed))
                if len(cache) + len(new) > CACHE_ENTRIES:
                    cache.clear()
                cache.update((w, n) for w, n in new.items() if len(w) <= TABLE_BYTES)
            return total

        for batch in batches:
            counts = pa.array([length(v) for v in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], counts], names=names)

    schema = source.drop("__text").select("*", F.lit(0).cast("long").alias(out)).schema
    return source.mapInArrow(count, schema)
