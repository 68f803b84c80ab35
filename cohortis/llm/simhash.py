"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortis.llm.common import Scratch, components, running_total

SEED = 42
FLUSH = 1 << 18  # shingle hashes turned into bits at a time


def shingle_hashes(text: str | None, width: int, chunk: int = FLUSH) -> Iterator[np.ndarray]:
    """XXH64 of the ``width``-word shingles of the lower-cased text, in pieces of at most ``chunk``."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII space characters only
    if not words:
        return
    hashed = xxhash.xxh64_intdigest
    if len(words) <= width:
        yield np.array([hashed(b" ".join(words), SEED)], np.uint64)
        return
    last = len(words) - width + 1
    for start in range(0, last, chunk):
        stop = min(start + chunk, last)
        rows = zip(*[words[start + i:stop + i] for i in range(width)])
        yield np.fromiter((hashed(b" ".join(r), SEED) for r in rows), np.uint64, stop - start)


def fingerprints(texts: list[str | None], width: int) -> np.ndarray:
    """64-bit SimHash of each text: a bit is set if more than half of the shingle hashes have it."""
    ones = np.zeros((len(texts), 64), np.int64)
    totals = np.zeros(len(texts), np.int64)
    held: list[np.ndarray] = []
    owners: list[int] = []

    def flush() -> None:
        if not held:
            return
        starts = np.concatenate([[0], np.cumsum([len(h) for h in held])[:-1]])
        bits = np.unpackbits(np.concatenate(held).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        np.add.at(ones, owners, np.add.reduceat(bits, starts, axis=0, dtype=np.int64))
        held.clear()
        owners.clear()

    pending = 0
    for i, text in enumerate(texts):
        for hashes in shingle_hashes(text, width):
            held.append(hashes)
            owners.append(i)
            totals[i] += len(hashes)
            pending += len(hashes)
            if pending >= FLUSH:
                flush()
                pending = 0
    flush()
    packed = np.packbits(ones * 2 > totals[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view(np.int64).reshape(-1)


def with_fingerprint(docs: DataFrame, width: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp long): the fingerprint's 64 bits as a signed long."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array(fingerprints(batch.column(1).to_pylist(), width), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], names=["id", "fp"])

    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text))
    return source.mapInArrow(scan, "id long, fp long")


def segments(distance: int) -> tuple[list[tuple[int, int]], list[int]]:
    """((shift, bits) of each segment, radius searched in it) for fingerprints within ``distance`` bits.

    With m segments and distance = m a + b, two fingerprints agree within a bits in one of the first b + 1 segments or
    within a - 1 bits in one of the others: else they would differ in more than ``distance`` bits. The number of
    segments keeps every radius at 1 at most, with segments as wide as that allows.
    """
    m = max(1, (distance + 2) // 2)
    widths = [64 // m + (i < 64 % m) for i in range(m)]
    shifts = [sum(widths[:i]) for i in range(m)]
    a, b = divmod(distance, m)
    radii = [a if i <= b else a - 1 for i in range(m)]
    return list(zip(shifts, widths)), radii


def near_pairs(prints: DataFrame, distance: int) -> DataFrame:
    """(a, b), a < b: node ids of distinct fingerprints (node, fp) within ``distance`` bits.

    Multi-index hashing: each fingerprint's segments are table entries; the small Hamming ball around each of its
    segments is looked up in the same segment's table by an equi-join, and matches are verified on all 64 bits in the
    join itself, so the join puts out links alone. A segment's ball has 1 + bits entries at radius 1: the probes are a
    fixed number for each fingerprint. Every probe finds a pair in both directions; one is kept. Values that many
    distinct fingerprints share are split by the join's skew handling; neither side is ever broadcast.
    """
    entries, probes = [], []
    for i, ((shift, bits), radius) in enumerate(zip(*segments(distance))):
        if radius < 0:
            continue
        value = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1).cast("long"))
        flips = [0, *[_signed(1 << j) for j in range(bits)]] if radius else [0]
        entries.append(F.struct(F.lit(i).alias("t"), value.alias("v")))
        probes.extend(F.struct(F.lit(i).alias("t"), value.bitwiseXOR(F.lit(f).cast("long")).alias("v")) for f in flips)
    table = prints.select(F.col("node").alias("a"), F.col("fp").alias("fa"), F.explode(F.array(*entries)).alias("e"))
    probe = prints.select(F.col("node").alias("b"), F.col("fp").alias("fb"), F.explode(F.array(*probes)).alias("e"))
    table = table.select("a", "fa", F.col("e.t").alias("t"), F.col("e.v").alias("v"))
    probe = probe.select("b", "fb", F.col("e.t").alias("t"), F.col("e.v").alias("v"))
    close = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= distance
    # Spark takes the probes to be as small as the fingerprints they are made from and would broadcast them.
    met = table.hint("merge").join(probe.hint("merge"), (table.t == probe.t) & (table.v == probe.v) & (F.col("a") < F.col("b")) & close)
    return met.select("a", "b").distinct()


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def simhash_groups(docs: DataFrame, width: int = 3, distance: int = 3, text: str = "text",
                   key: str = "doc_id") -> DataFrame:
    """(key, fp, fingerprint, component_id) for every row of ``docs``.

    Rows with one fingerprint are one node, the smallest id among them, before anything is compared; nodes within
    ``distance`` bits are linked, and ``component_id`` is the smallest id that links reach. Null, empty and blank texts
    have fingerprint 0 and are linked like any other. Rows with a null id are linked like any other too, and links lead
    through them; a component in which no row has an id has a null ``component_id``. Rows that repeat an id keep a row
    each, and their fingerprints' nodes become one component if the id is the smallest of both.
    """
    rows, labels = _labelled(docs, width, distance, text, key)
    named = F.when(~F.col("nameless"), F.col("component")).alias("component_id")
    return (rows.join(labels, rows.fp == labels.f, "left")
            .select(F.col("id").alias(key), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), named))


def _labelled(docs: DataFrame, width: int, distance: int, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(id, fp) of each row, and (f, component, nameless) of each fingerprint.

    A fingerprint that only rows without an id have is a node with a number above all ids, so a component's smallest
    node is an id if it holds one; ``nameless`` marks the others. The numbers go on from the largest id.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.write("rows", with_fingerprint(docs, width, text, key))
    prints = scratch.write("prints", rows.groupBy("fp").agg(F.min("id").alias("node")))
    nodes, bare = prints.filter("node is not null"), prints.filter("node is null")
    top = None
    if not bare.isEmpty():
        top = rows.agg(F.max("id")).first()[0] or 0
        numbered = running_total(scratch, "bare", bare.select("fp", F.lit(1).alias("one")), ["fp"], "one", "at")
        nodes = nodes.union(numbered.select("fp", F.lit(top) + 1 + F.col("at")))
        nodes = scratch.write("nodes", nodes)
    pairs = scratch.write("pairs", near_pairs(nodes, distance))
    linked = components(scratch, pairs).withColumnRenamed("node", "n")
    component = F.coalesce("component", "node")
    nameless = F.lit(False) if top is None else component > top
    labels = nodes.join(linked, nodes.node == linked.n, "left").select(
        F.col("fp").alias("f"), component.alias("component"), nameless.alias("nameless"))
    return rows, labels


def drop_near_duplicates(docs: DataFrame, width: int = 3, distance: int = 3, text: str = "text",
                         key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component; one row of a component without any id.

    Rows that repeat an id are one document: those with one text are reduced to one row. A row with a null id goes if
    its component holds an id; of a component without ids the row with the smallest hash of its text stays.
    """
    rows, labels = _labelled(docs, width, distance, text, key)
    groups = rows.join(labels, rows.fp == labels.f, "left")
    losers = groups.filter(F.col("id") != F.col("component")).select(F.col("id").alias("__id")).distinct()
    kept = docs.join(losers.hint("shuffle_hash"), F.col(key) == F.col("__id"), "left_anti")
    repeated = groups.groupBy(F.col("id").alias("__id")).count().filter("count > 1 and __id is not null").select("__id")
    if not repeated.isEmpty():
        again = F.col(key) == F.col("__id")
        kept = kept.join(repeated, again, "left_anti").unionByName(
            kept.join(repeated, again, "left_semi").dropDuplicates([key, text]))
    if rows.filter("id is null").isEmpty():
        return kept
    return kept.filter(F.col(key).isNotNull()).unionByName(_one_of_each(docs, labels, width, text, key))


def _one_of_each(docs: DataFrame, labels: DataFrame, width: int, text: str, key: str) -> DataFrame:
    """One row of each component without ids, from the rows of ``docs`` without an id."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array(fingerprints(batch.column(0).field(text).to_pylist(), width), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], names=["row", "fp"])

    source = docs.filter(F.col(key).isNull()).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema = source.select("row", F.lit(0).cast("long").alias("fp")).schema
    bare = source.mapInArrow(scan, schema).join(labels.filter("nameless"), F.col("fp") == F.col("f"))
    first = bare.groupBy("component").agg(F.min_by("row", F.xxhash64(F.col("row").getField(text))).alias("row"))
    return first.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
