"""Shortest-pack-first packing of token sequences over the length histogram."""

from __future__ import annotations

import os
import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cohortis.llm.common import Scratch

CAPACITY = 2048
CACHE_ENTRIES = 1_200_000  # pre-tokens that a worker remembers, about
CACHE_LETTERS = 24  # letters of one, if they were equally long
NEW_WORDS = 100  # words of one library call
GROUP_LETTERS = 4_000_000  # text encoded at a time
SLICE_ROWS = 64  # texts turned into Python strings at a time
ROWS_PER_SALT = 1_000_000  # pieces of one length that a task ranks, about


OPENING = "\u0120\u010a"  # how byte-level vocabularies write a space and a newline
OTHER_SPACE = re.compile(r"[^\S \n]")
ASCII_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"  # what OTHER_SPACE finds in ASCII


class WordTable:
    """Words and their ids, by number: ids of word n are ``ids[ends[n]:ends[n + 1]]``."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.ids, self.ends, self.letters = array("I"), array("q", [0]), 0

    def add(self, words: list[str], raw: bytes, sizes: np.ndarray) -> None:
        """Adds new words whose ids, ``sizes`` of them each, follow one another in ``raw``."""
        n = len(self.numbers)
        self.numbers.update(zip(words, range(n, n + len(words))))
        self.ends.frombytes((len(self.ids) + np.cumsum(sizes, dtype=np.int64)).tobytes())
        self.ids.frombytes(raw)
        self.letters += sum(map(len, words))

    def gather(self, numbers: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The ids of consecutive texts of ``counts`` words each, given the numbers of their words."""
        ends = np.frombuffer(self.ends, np.int64)  # no copy: the table may be much larger than the texts
        starts = ends[numbers]
        sizes = ends[numbers + 1] - starts
        upto = np.concatenate([[0], np.cumsum(sizes)])
        places = np.repeat(starts - upto[:-1], sizes) + np.arange(upto[-1])
        raw = np.frombuffer(self.ids, np.uint32)[places].astype("<u4").tobytes()
        cuts = (4 * upto[np.concatenate([[0], np.cumsum(counts)])]).tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


class CachedEncoder:
    """ids of texts as little-endian uint32 bytes, equal to the library's ids for each whole text.

    Byte-level pre-tokens never reach over a single space or newline between two visible characters, so such a text is
    encoded word by word (a word with the space or newline before it): new words go through the library, many in one
    call, and the words of a batch of texts are told apart once and their ids gathered from the word table. Texts with other white
    space next to a space or newline, or with a special token's string, are encoded whole. A full table is begun anew.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(tokenizer_json)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that start with a space or newline
        self.opens[[i for token, i in vocabulary.items() if token[0] in OPENING]] = True
        self.table = WordTable()

    def _library(self, texts: list[str]) -> list[bytes]:
        done = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in (e.ids for e in done)]

    def _add_new(self, words: list[str]) -> None:
        """Encodes words that have a space before them or start with a newline, cut at the ids that start with either."""
        units = [w if w[0] == "\n" else " " + w for w in words]
        ids = np.array(self.library.encode_batch_fast(["".join(units)], add_special_tokens=False)[0].ids, "<u4")
        starts = np.flatnonzero(self.opens[ids])
        if len(starts) == len(units):
            self.table.add(words, ids.tobytes(), np.diff(np.append(starts, len(ids))))
        else:
            self._add_raw(words, self._library(units))

    def _add_raw(self, words: list[str], raw: list[bytes]) -> None:
        self.table.add(words, b"".join(raw), np.array(list(map(len, raw)), np.int64) // 4)

    def _numbers(self, words: list[str], learn) -> np.ndarray:
        """The numbers of different words; ``learn`` puts lists of new ones into the table."""
        numbers = list(map(self.table.numbers.get, words))
        gaps = [i for i, n in enumerate(numbers) if n is None]
        first = len(self.table.numbers)
        for at in range(0, len(gaps), NEW_WORDS):
            learn([words[i] for i in gaps[at:at + NEW_WORDS]])
        for n, i in enumerate(gaps, first):
            numbers[i] = n
        return np.array(numbers, np.int64)

    def _add_first(self, words: list[str]) -> None:
        """Encodes words that open a text, marked by a space before them that no other word has."""
        self._add_raw(words, self._library([w[1:] for w in words]))

    def _splits(self, text: str) -> bool:
        """Every space and newline stands between two visible characters, and no special token's string is there."""
        if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[0].isspace() or text[-1].isspace():
            return False
        if text.isascii() and not any(c in text for c in ASCII_SPACE):
            return not any(s in text for s in self.specials)
        if OTHER_SPACE.search(text) and any(w[0].isspace() or w[-1].isspace() for w in re.split("[ \n]", text)):
            return False
        return not any(s in text for s in self.specials)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        if len(self.table.numbers) > CACHE_ENTRIES or self.table.letters > CACHE_ENTRIES * CACHE_LETTERS:
            self.table = WordTable()
        done, firsts, rests, split = [b""] * len(texts), [], [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self._splits(text):
                done[i] = self._library([text])[0]
                continue
            first, gap, rest = text.replace("\n", " \n").partition(" ")
            firsts.append(" " + first)
            rests.append(rest if gap else None)
            split.append(i)
        if split:
            parts = pc.split_pattern(pa.array(rests, pa.string()), " ")
            coded = parts.flatten().dictionary_encode()
            numbers = self._numbers(coded.dictionary.to_pylist(), self._add_new)[coded.indices.to_numpy()]
            opening, places = np.unique(np.array(firsts, object), return_inverse=True)
            sizes = pc.fill_null(pc.list_value_length(parts), 0).to_numpy().astype(np.int64)
            numbers = np.insert(numbers, np.cumsum(sizes) - sizes, self._numbers(opening.tolist(), self._add_first)[places])
            for i, raw in zip(split, self.table.gather(numbers, sizes + 1)):
                done[i] = raw
        return done

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def texts_of(column: pa.Array) -> Iterator[str]:
    """The strings of a column, SLICE_ROWS in Python at a time; null is empty."""
    for at in range(0, len(column), SLICE_ROWS):
        for value in column.slice(at, SLICE_ROWS).to_pylist():
            yield value or ""


def text_groups(texts: Iterable[str], letters: int) -> Iterator[list[str]]:
    """Consecutive texts, so many that a group has about ``letters`` letters."""
    group, held = [], 0
    for text in texts:
        group.append(text)
        held += len(text)
        if held >= letters:
            yield group
            group, held = [], 0
    if group:
        yield group


ENCODERS: dict[str, CachedEncoder] = {}  # of a worker process, so that its next task finds the words known


def token_pieces(docs: DataFrame, tokenizer_json: str, end_id: int = 1, capacity: int = CAPACITY, text: str = "text",
                 key: str = "doc_id") -> DataFrame:
    """(key, start, length, doc_tokens, ids) for each piece of each document.

    A document's ids are the library's for its whole text, then ``end_id``; they are cut into pieces of ``capacity``
    ids and a shorter last one. ``ids`` holds little-endian uint32 values. A null text counts as empty and has one
    piece, the end id alone. Rows that repeat an id have their own pieces. The tokenizer (a file of fixed size) is
    broadcast; each task encodes its own texts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    end = np.array([end_id], "<u4").tobytes()
    source = docs.select(F.col(key).alias(key), F.col(text).alias("__text"))
    schema = T.StructType([source.schema[0], *[T.StructField(n, T.LongType()) for n in ("start", "length", "doc_tokens")],
                           T.StructField("ids", T.BinaryType())])
    step, most = 4 * capacity, 4 << 20

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if shared.value not in ENCODERS:
            ENCODERS.clear()
            ENCODERS[shared.value] = CachedEncoder(shared.value)
        encoder = ENCODERS[shared.value]
        for batch in batches:
            owner, start, total, ids, size = [], [], [], [], 0

            def flush(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                columns = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(start, pa.int64()),
                           pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(total, pa.int64()),
                           pa.array(ids, pa.binary())]
                return pa.RecordBatch.from_arrays(columns, names=schema.names)

            groups = text_groups(texts_of(batch.column(1)), GROUP_LETTERS)
            for i, raw in enumerate(chain.from_iterable(map(encoder.encode_all, groups))):
                whole = raw + end
                for at in range(0, len(whole), step):
                    owner.append(i)
                    start.append(at // 4)
                    total.append(len(whole) // 4)
                    ids.append(whole[at:at + step])
                    size += step
                    if size >= most:
                        yield flush()
                        owner, start, total, ids, size = [], [], [], [], 0
            yield flush()

    return source.mapInArrow(scan, schema)


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Shortest-pack-first: (lengths of a pack, number of such packs).

    Lengths are placed longest first; all pieces of a length go, as many at a time as there are packs of a pattern,
    into the packs with most room left, which thereby become packs of a longer pattern, or open new packs. The work
    and the number of patterns depend on the capacity, not on the number of pieces.
    """
    by_room: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]
    for length in range(capacity, 0, -1):
        left = histogram.get(length, 0)
        room = capacity
        while left:
            while room >= length and not by_room[room]:
                room -= 1
            if room < length:
                # New packs hold one piece of this length first; the rest of it may join them.
                times = capacity // length
                full, rest = divmod(left, times)
                for n, packs in ((times, full), (rest, 1 if rest else 0)):
                    if packs:
                        at = by_room[capacity - n * length]
                        pattern = (length,) * n
                        at[pattern] = at.get(pattern, 0) + packs
                break
            pattern, packs = next(iter(by_room[room].items()))
            used = min(packs, left)
            if used == packs:
                del by_room[room][pattern]
            else:
                by_room[room][pattern] = packs - used
            longer = by_room[room - length]
            longer[(*pattern, length)] = longer.get((*pattern, length), 0) + used
            left -= used
    return [(pattern, packs) for at in by_room for pattern, packs in at.items()]


def placements(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: (first ranks, first sequence ids, offsets) of the runs of its pieces, in rank order."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for pattern, packs in patterns:
        offset = 0
        for length in pattern:
            rank = used.get(length, 0)
            runs.setdefault(length, []).append((rank, first, offset))
            used[length] = rank + packs
            offset += length
        first += packs
    return {length: tuple(np.array(c, np.int64) for c in zip(*r)) for length, r in runs.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length", seed: int = 3) -> DataFrame:
    """``pieces`` with sequence_id (gapless from 0) and offset in it; columns of these names are replaced.

    Pieces are counted by length, the histogram (``capacity`` numbers) is packed on the driver, and each piece finds
    its place by its rank among the pieces of its length: ranks come from salted counts, so a length that a third of
    the pieces share is ranked by many tasks. The table of places has at most one run for each pattern and position;
    it is broadcast, its size bounded by the capacity. Pass narrow rows; ids need not travel. Rows of null or
    non-positive length, or beyond the capacity, raise an error: cut them first. No rows give no rows.
    """
    scratch = Scratch(pieces.sparkSession, "pack")
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    packed = pieces.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(length).cast("int").alias("size"))
    rows = scratch.write("rows", packed.withColumn("rid", F.monotonically_increasing_id()))
    valid = F.when(F.col("size").between(1, capacity), F.col("size")).otherwise(0).alias("valid")
    histogram = {r["valid"]: r["count"] for r in rows.groupBy(valid).count().collect()}
    if 0 in histogram:
        raise ValueError(f"piece lengths must lie in 1 to {capacity}")
    places = pieces.sparkSession.sparkContext.broadcast(placements(pack_histogram(histogram, capacity)))
    salts = max(64, -(-sum(histogram.values()) // ROWS_PER_SALT))
    salted = rows.withColumn("key", F.xxhash64(F.lit(seed), "rid")).withColumn("salt", F.pmod("key", F.lit(salts)))
    before = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy("size", "salt").count().select(
        "size", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("size", "salt").orderBy("key", "rid")) - 1
    ranked = salted.withColumn("at", within).join(bases, ["size", "salt"]).select(
        "row", "size", (F.col("base") + F.col("at")).alias("rank"))
    schema = ranked.select("row", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ranks = (batch.column(i).to_numpy() for i in (1, 2))
            sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            for size in np.unique(sizes):
                mine = np.flatnonzero(sizes == size)
                lows, firsts, offsets = places.value[int(size)]
                run = np.searchsorted(lows, ranks[mine], side="right") - 1
                sequence[mine] = firsts[run] + ranks[mine] - lows[run]
                offset[mine] = offsets[run]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sequence), pa.array(offset)], names=schema.names)

    return ranked.mapInArrow(place, schema).select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "sequence_id", "offset")
