"""Exact dedup: an extendible-hash index in the shared folder, whose owner tasks compare the bytes of equal keys."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortis.llm.common import Scratch

KEY_BITS = 64
STEP_BITS = 12  # depth by which a count looks ahead, so one brings 4096 numbers at most for each bucket that it splits
MIN_CAPACITY = 4096  # entries of a bucket, at least
MAX_BUCKETS = 4096  # about; beyond MIN_CAPACITY times this many entries buckets hold more
OWNER_BYTES = 64 << 20  # text of an owner task's buckets, about
MAX_OWNERS = 20_000
SEEN_BYTES = 64 << 20  # text that a task keeps to recognise its own copies


def key_of(text: bytes) -> int:
    """The 64-bit key of a text, signed."""
    key = xxhash.xxh64_intdigest(text)
    return key - (1 << 64) if key >> 63 else key


def _entries(rows: DataFrame, lower: bool, key=key_of, seen_bytes: int = SEEN_BYTES) -> DataFrame:
    """``rows`` (row, id, rid, text) with entry, and key, sha and text on the rows that open an entry, else null.

    An entry stands for the copies of one text in a task, named by the rid of the first. The texts that a task has seen
    are compared whole; beyond ``seen_bytes`` of them it forgets all and opens new entries, which only costs space.
    """
    schema = T.StructType([*rows.schema.fields[:3], T.StructField("entry", T.LongType()), T.StructField("key", T.LongType()),
                           T.StructField("sha", T.StringType()), T.StructField("text", T.StringType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        held = 0
        for batch in batches:
            texts = pc.ascii_lower(batch.column(3)) if lower else batch.column(3)
            texts = pc.fill_null(texts, "").cast(pa.binary())
            entries, keys, shas, heads = [], [], [], []
            for rid, value in zip(batch.column(2).to_pylist(), texts.to_pylist()):
                entry = seen.get(value)
                opens = entry is None
                if opens:
                    if held > seen_bytes:
                        seen, held = {}, 0
                    seen[value] = entry = rid
                    held += len(value)
                entries.append(entry)
                keys.append(key(value) if opens else None)
                shas.append(hashlib.sha256(value).hexdigest() if opens else None)
                heads.append(opens)
            texts = pc.if_else(pa.array(heads, pa.bool_()), texts, pa.scalar(None, pa.binary())).view(pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(entries, pa.int64()), pa.array(keys, pa.int64()), pa.array(shas, pa.string()),
                 texts], names=schema.names)

    return rows.mapInArrow(scan, schema)


def directory(heads: DataFrame, capacity: int | None = None) -> list[tuple[int, int, int, int]]:
    """The index's buckets as (lowest key, depth, entries, bytes), by key; a bucket reaches up to the next one's key.

    Starting from one bucket of depth 0, each bucket over ``capacity`` entries is split by its next key bit, and the
    directory doubles whenever that makes the deepest bucket deeper. Directory cells that point to one bucket are one
    row here. Counts look STEP_BITS ahead, so several doublings need one pass over the keys. A bucket of one key
    cannot be split: it stays as it is, and its owner reads it as a chain.
    """
    total = heads.count()
    capacity = capacity or max(MIN_CAPACITY, -(-total // MAX_BUCKETS))
    buckets: list[tuple[int, int, int, int]] = []
    pending, depth = [0], 0  # key prefixes to be split, and their length in bits
    while pending:
        ahead = min(depth + STEP_BITS, KEY_BITS)
        cell = F.shiftright("key", KEY_BITS - ahead)
        part = heads if not depth else heads.filter(F.shiftright("key", KEY_BITS - depth).isin(pending))
        found = part.groupBy(cell.alias("cell")).agg(
            F.count("*"), F.sum("size"), (F.min("key") == F.max("key"))).collect()
        counts = {c: (n, size, one) for c, n, size, one in found}
        cells = sorted(counts)
        sums = np.concatenate([[0], np.cumsum([counts[c][0] for c in cells])]).astype(np.int64)
        deeper: list[int] = []
        stack = [(p, depth) for p in reversed(pending)]
        while stack:
            prefix, bits = stack.pop()
            a, b = (bisect_left(cells, p << (ahead - bits)) for p in (prefix, prefix + 1)) if bits else (0, len(cells))
            n = int(sums[b] - sums[a])
            whole = n <= capacity or (b - a == 1 and counts[cells[a]][2])
            if not whole and bits < ahead:
                # The first bit is the sign, so the half of depth 1 with the lower keys has prefix -1.
                stack += [(0, 1), (-1, 1)] if not bits else [(2 * prefix + 1, bits + 1), (2 * prefix, bits + 1)]
            elif not whole and ahead < KEY_BITS:
                deeper.append(prefix)
            else:
                low = prefix << (KEY_BITS - bits) if bits else -(1 << 63)
                buckets.append((low, bits, n, sum(counts[c][1] for c in cells[a:b])))
        pending, depth = deeper, ahead
    return sorted(buckets)


def _owners(buckets: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, int]:
    """The owner task of each bucket, consecutive buckets up to a share of all bytes, and their number."""
    sizes = np.array([b[3] for b in buckets], np.int64)
    share = max(OWNER_BYTES, int(sizes.sum()) // MAX_OWNERS)
    owners = (np.cumsum(sizes) - sizes) // share
    _, owners = np.unique(owners, return_inverse=True)
    return owners, int(owners.max()) + 1


def build_index(heads: DataFrame, scratch: Scratch, capacity: int | None = None) -> DataFrame:
    """The index's pages in the shared folder: (bucket, key, entry, leader) for each of ``heads`` (entry, key, text).

    ``leader`` is the smallest entry of the same text. Owner tasks hold consecutive buckets, thus a range of keys, read
    it in key order and chain the different texts of one key: each entry is compared byte by byte with the chain. Only
    one key's chain is in memory; equal texts of a task are one entry already, so copies weigh one row a task.
    """
    buckets = directory(heads.select("key", F.octet_length("text").cast("long").alias("size")), capacity)
    owners, n = _owners(buckets)
    shared = heads.sparkSession.sparkContext.broadcast((np.array([b[0] for b in buckets], np.int64), owners.astype(np.int32)))

    @F.pandas_udf("struct<bucket: int, owner: int>")
    def place(keys: pd.Series) -> pd.DataFrame:
        lows, owner = shared.value
        bucket = np.searchsorted(lows, keys.to_numpy(), side="right") - 1
        return pd.DataFrame({"bucket": bucket.astype(np.int32), "owner": owner[bucket]})

    placed = heads.select("key", "entry", "text", place("key").alias("at"))
    owned = placed.select("at.bucket", "key", "entry", "text", "at.owner").repartitionById(n, "owner")
    ordered = owned.drop("owner").sortWithinPartitions("key", "entry")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, texts = None, {}
        for batch in batches:
            leaders = []
            for key, entry, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(),
                                        batch.column(3).cast(pa.binary()).to_pylist()):
                if key != last:
                    last, texts = key, {}
                leaders.append(texts.setdefault(text, entry))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(leaders, pa.int64())], names=["bucket", "key", "entry", "leader"])

    return scratch.write("pages", ordered.mapInArrow(chain, "bucket int, key long, entry long, leader long"))


def exact_groups(docs: DataFrame, lower: bool = True, text: str = "text", key: str = "doc_id",
                 keep: list[str] | None = None, capacity: int | None = None, hash_key=key_of) -> DataFrame:
    """The columns ``keep`` (``key`` alone, if not given) of each row, with keep_id, group_size, kept and text_sha256.

    Texts are equal if their bytes are, after lower-casing A-Z if ``lower``. ``keep_id`` is the largest id among the
    rows of one text, ``kept`` marks the one row that stays and ``text_sha256`` is the hash of the text compared.

    A task opens one entry for each of its texts, the index names equal entries, and rows find their group through
    their entry: a text that a third of all rows hold is one entry a task, and no join has a key with more rows than a
    task's share. A null text counts as empty. Null ids rank below all others; of rows with one id and text one stays,
    the same in each evaluation of the result. Columns of the result's names are replaced; no rows give none.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    made = ("keep_id", "group_size", "kept", "text_sha256")
    kept = [c for c in (keep if keep is not None else [key]) if c not in made]
    rows = docs.select(
        F.struct(F.lit(0).alias("__row"), *[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{key}`").alias("id"),
        F.monotonically_increasing_id().alias("rid"), F.col(f"`{text}`").cast("string").alias("text"))
    entries = scratch.write("entries", _entries(rows, lower, hash_key))
    heads = entries.filter("key is not null")
    pages = build_index(heads.select("key", "entry", "text"), scratch, capacity)
    stats = entries.groupBy("entry").agg(
        F.count("*").alias("n"), F.max(F.struct("id", F.negative("rid").alias("rid"))).alias("top"), F.max("sha").alias("sha"))
    named = scratch.write("named", pages.join(stats, "entry").select("entry", "leader", "n", "top", "sha"))
    groups = named.groupBy("leader").agg(F.sum("n").alias("group_size"), F.max("top").alias("best"))
    found = named.join(groups, "leader").select("entry", "group_size", "best", "sha")
    done = entries.select("row", "rid", "entry").join(found, "entry")
    return done.select(
        *[F.col(f"row.`{c}`").alias(c) for c in kept], F.col("best.id").alias("keep_id"), "group_size",
        (F.negative("rid") == F.col("best.rid")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, lower: bool = True, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each group of equal texts, the one of the largest id; see ``exact_groups``."""
    numbered = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                           F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    groups = exact_groups(numbered, lower, "text", "id", keep=["doc"])
    return groups.filter("kept").select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
