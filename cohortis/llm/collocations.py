"""Phrase collocations: tasks count phrases in a HAT-trie, whose spilled subtrees are merged per prefix partition."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortis.llm.common import Scratch

ID_BITS = 21  # of a word's number within a task; three fit in a key
ID_MASK = (1 << ID_BITS) - 1
BURST = 4096  # phrases of a hash container, at most
MAX_PHRASES = 750_000  # of a task's trie; half of them are spilled beyond
RUN_PHRASES = 1 << 16  # of a run, about
SLICE = 2 << 20  # bytes of text that a task splits into words at a time
SIEVE_BITS = 1 << 27  # of a sieve: 16 MB, whatever the corpus
CRC_STEP = 1_000_003
PREFIX_PARTS = 16  # parts of the phrases that begin with one word
RANK_PARTS = 64  # of a language's candidates, each ranked on its own first
BREAKS = b".,;:!?\n\x0b\x0c\r"
NO_LANG = "und"

_TABLE = bytes(ord(".") if b in BREAKS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


class TrieNode:
    """A trie node over the word whose number lies at bit ``shift`` of the keys below it.

    Each child is a hash container, a dict from keys to counts for a range of words, or a node over the next word. A
    container that grows over BURST bursts into smaller ranges, and a word that has as many phrases alone into a node
    one level down. The depth is that of a phrase at most.
    """

    __slots__ = ("shift", "lows", "children")

    def __init__(self, shift: int, container: dict[int, int]):
        self.shift = shift
        self.lows = [0]  # the least word of each child
        self.children: list[dict[int, int] | TrieNode] = [container]

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Adds counts to phrases; ``keys`` are in order."""
        words = keys >> self.shift & ID_MASK
        cuts = [*np.searchsorted(words, self.lows).tolist(), len(keys)]
        for i in range(len(self.children) - 1, -1, -1):  # backwards: a split inserts behind its child
            a, b = cuts[i], cuts[i + 1]
            if a == b:
                continue
            child = self.children[i]
            if isinstance(child, TrieNode):
                child.add(keys[a:b], counts[a:b])
                continue
            get = child.get
            for key, n in zip(keys[a:b].tolist(), counts[a:b].tolist()):
                child[key] = get(key, 0) + n
            if len(child) > BURST:
                self._burst(i)

    def _burst(self, i: int) -> None:
        held = self.children[i]
        keys = np.sort(np.fromiter(held, np.int64, len(held)))
        counts = np.fromiter(map(held.__getitem__, keys.tolist()), np.int64, len(keys))
        words, firsts = np.unique(keys >> self.shift & ID_MASK, return_index=True)
        sizes = np.diff(np.append(firsts, len(keys)))
        share, large = firsts // (BURST // 2 or 1), sizes > BURST
        opens = np.append(True, (share[1:] != share[:-1]) | large[1:] | large[:-1])
        cuts = [*firsts[opens].tolist(), len(keys)]
        lows: list[int] = []
        children: list[dict[int, int] | TrieNode] = []
        low, after = self.lows[i], self.lows[i + 1] if i + 1 < len(self.lows) else ID_MASK + 1
        for word, alone, a, b in zip(words[opens].tolist(), large[opens].tolist(), cuts, cuts[1:]):
            part = dict(zip(keys[a:b].tolist(), counts[a:b].tolist()))
            if not alone:
                lows.append(word if low is None else low)
                children.append(part)
                low = None
                continue
            # A node is for one word; the other words of the range keep containers of their own.
            if low is not None and low < word:
                lows.append(low)
                children.append({})
            node = TrieNode(self.shift - ID_BITS, part)
            node._burst(0)
            lows.append(word)
            children.append(node)
            low = word + 1
        if low is not None and low < after:
            lows.append(low)
            children.append({})
        self.lows[i:i + 1] = lows
        self.children[i:i + 1] = children


def size_of(child: dict[int, int] | TrieNode) -> int:
    return sum(map(size_of, child.children)) if isinstance(child, TrieNode) else len(child)


def containers_of(child: dict[int, int] | TrieNode) -> Iterator[dict[int, int]]:
    if isinstance(child, TrieNode):
        for below in child.children:
            yield from containers_of(below)
    else:
        yield child


class Numbers(dict):
    """Numbers of the words of one language, given out at first sight; 0 is a break."""

    def __init__(self, lang: bytes, counter: PhraseCounter):
        super().__init__({b".": 0})
        self.counter, self.lang, self.crc = counter, lang, zlib.crc32(lang + b"\t")

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.counter.words)
        self.counter.words.append(word)
        self.counter.langs.append(self.lang)
        self.counter.crcs.append(zlib.crc32(word, self.crc))
        return n


class PhraseCounter:
    """Counts of the phrases of ``width`` words in a task's texts, given out in sorted runs."""

    def __init__(self, width: int, sieve: np.ndarray | None, lean: int = MAX_PHRASES):
        self.width, self.sieve, self.lean = width, sieve, lean
        self.top = ID_BITS * (width - 1)
        self._clear()

    def _clear(self) -> None:
        self.numbers: dict[bytes, Numbers] = {}
        self.words, self.langs, self.crcs = [b""], [b""], array("q", [0])
        self.root = TrieNode(self.top, {})
        self.held = 0

    def _passes(self, crcs: np.ndarray) -> np.ndarray:
        slot = (crcs ^ crcs >> 26) & (8 * len(self.sieve) - 1)
        return self.sieve[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 == 1

    def add(self, lang: bytes, blob: bytes) -> Iterator[pa.RecordBatch]:
        """Counts the phrases of ``blob``, a text with its breaks made full stops; gives out runs if too many are held."""
        tokens = blob.replace(b".", b" . ").split()
        if not tokens:
            return
        if len(self.words) + len(tokens) > ID_MASK and len(self.words) > 1:
            yield from self.spill(0)
            self._clear()
        if lang not in self.numbers:
            self.numbers[lang] = Numbers(lang, self)
        ids = np.fromiter(map(self.numbers[lang].__getitem__, tokens), np.int64, len(tokens))
        crcs = np.array(self.crcs)
        heads = ids[:max(0, len(ids) - self.width + 1)]
        keys, good = heads.copy(), heads > 0
        for i in range(1, self.width):
            after = ids[i:len(heads) + i]
            keys = keys << ID_BITS | after
            good &= after > 0
        if self.sieve is not None:
            if self.width == 2:
                fits = self._passes(crcs[ids])
            else:
                fits = self._passes(crcs[ids[:-1]] * CRC_STEP + crcs[ids[1:]])
            good &= fits[:len(heads)] & fits[1:len(heads) + 1]
        keys, counts = np.unique(keys[good], return_counts=True)
        self.root.add(keys, counts)
        self.held = size_of(self.root)
        if self.held > self.lean:
            yield from self.spill(self.lean // 2)

    def spill(self, upto: int) -> Iterator[pa.RecordBatch]:
        """Takes the largest subtrees out until ``upto`` phrases are left; each is a sorted run."""
        words, langs = pa.array(self.words, pa.binary()), pa.array(self.langs, pa.binary())
        in_order = pc.sort_indices(pa.table([langs, words], ["lang", "word"]), [("lang", "ascending"), ("word", "ascending")])
        ranks = np.empty(len(words), np.int64)
        ranks[in_order.to_numpy()] = np.arange(len(words))
        crcs = np.array(self.crcs)
        out, run, n = set(), [], 0
        for i in sorted(range(len(self.root.children)), key=lambda i: -size_of(self.root.children[i])):
            if self.held <= upto:
                break
            self.held -= size_of(self.root.children[i])
            out.add(i)
            for held in containers_of(self.root.children[i]):
                run.append(held)
                n += len(held)
                if n >= RUN_PHRASES:
                    yield self._run(run, ranks, words, langs, crcs)
                    run, n = [], 0
        if n:
            yield self._run(run, ranks, words, langs, crcs)
        lows, children = self.root.lows, [{} if i in out else child for i, child in enumerate(self.root.children)]
        left = [i for i in range(len(children)) if i == 0 or children[i] or children[i - 1]]
        self.root.lows, self.root.children = [lows[i] for i in left], [children[i] for i in left]

    def _run(self, held: list[dict[int, int]], ranks: np.ndarray, words: pa.Array, langs: pa.Array,
             crcs: np.ndarray) -> pa.RecordBatch:
        n = sum(map(len, held))
        keys = np.fromiter(chain.from_iterable(held), np.int64, n)
        counts = np.fromiter(chain.from_iterable(d.values() for d in held), np.int64, n)
        ids = [keys >> (self.top - ID_BITS * i) & ID_MASK for i in range(self.width)]
        order = np.lexsort([ranks[c] for c in reversed(ids)])
        ids = [c[order] for c in ids]
        prefix = crcs[ids[0]] * PREFIX_PARTS + (crcs[ids[1]] % PREFIX_PARTS if self.width > 1 else 0)
        parts = [words.take(pa.array(c)) for c in ids]
        joined = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary()))
        # Texts are cut at ASCII bytes only, so words are as valid as the texts are.
        return pa.RecordBatch.from_arrays(
            [pa.array(prefix), langs.take(pa.array(ids[0])).view(pa.string()), joined.view(pa.string()),
             pa.array(counts[order])], names=["prefix", "lang", "phrase", "n"])


def slices(blob: bytes, width: int, size: int = SLICE) -> Iterator[bytes]:
    """``blob`` in parts of about ``size`` bytes that hold each phrase of ``width`` words once.

    Parts end at full stops; where none is near, at a space, and the next part begins with the last words of this one.
    """
    at, carry = 0, b""
    while at < len(blob):
        end = len(blob) if len(blob) - at <= size else blob.find(b".", at + size, at + 2 * size) + 1
        if not end:
            gap = re.compile(rb"[. ]").search(blob, at + 2 * size)
            end = gap.end() if gap else len(blob)
        part = carry + blob[at:end]
        yield part
        cut = blob[end - 1:end] != b"." and width > 1
        carry = b" ".join([*part.replace(b".", b" . ").split()[1 - width:], b""]) if cut else b""
        at = end


def count_phrases(docs: DataFrame, width: int, sieve: np.ndarray | None = None, text: str = "text", lang: str = "lang",
                  lean: int = MAX_PHRASES) -> DataFrame:
    """(lang, phrase, n): how often each phrase of ``width`` words (3 at most) occurs in each language.

    With a ``sieve`` phrases are left out that hold a word (of two), or two words in a row (of three), that the sieve
    does not know. A task's trie keeps ``lean`` phrases at most and gives out its largest subtrees as sorted runs; runs
    are dealt to partitions by their prefix, the first word and a part of the second, and added up there. A task sends
    a phrase a few times at most, however often it occurs.
    """
    if not 1 <= width <= 3:
        raise ValueError("phrases have 1 to 3 words")
    shared = docs.sparkSession.sparkContext.broadcast(sieve)
    source = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(NO_LANG)).alias("lang"),
                         F.col(f"`{text}`").cast("string").alias("text")).filter("text <> ''")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PhraseCounter(width, shared.value, lean)
        for batch in batches:
            langs = batch.column(0).cast(pa.binary()).dictionary_encode()
            texts = batch.column(1).cast(pa.binary())
            for i, name in enumerate(langs.dictionary.to_pylist()):
                mine = texts.filter(pc.equal(langs.indices, i))
                blob = b".".join(mine.to_pylist()).translate(_TABLE)
                for part in slices(blob, width):
                    yield from counter.add(name, part)
        yield from counter.spill(0)

    runs = source.mapInArrow(scan, "prefix long, lang string, phrase string, n long")
    return runs.repartition("prefix").groupBy("prefix", "lang", "phrase").agg(F.sum("n").alias("n")).drop("prefix")


def crc_of(lang: Column, word: Column) -> Column:
    return F.crc32(F.concat(lang, F.lit("\t"), word).cast("binary"))


def make_sieve(phrases: DataFrame, width: int, bits: int = SIEVE_BITS) -> np.ndarray:
    """A table of ``bits`` bits that holds every one of ``phrases`` (lang, phrase) of one or two words, and few others.

    Its size does not depend on the corpus: with more phrases it lets more others through, which costs time alone.
    """
    crc = crc_of(F.col("lang"), F.substring_index("phrase", " ", 1))
    if width == 2:
        crc = crc * CRC_STEP + crc_of(F.col("lang"), F.substring_index("phrase", " ", -1))
    slot = phrases.select(crc.alias("crc")).select(
        F.col("crc").bitwiseXOR(F.shiftright("crc", 26)).bitwiseAND(F.lit(bits - 1)).alias("slot"))
    cells = slot.groupBy(F.shiftright("slot", 5).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot & 31 as int))")).alias("held")).toArrow()
    table = np.zeros(bits // 32, np.uint32)
    table[cells["at"].to_numpy()] = cells["held"].to_numpy().astype(np.uint32)
    return table.astype("<u4").view(np.uint8)


def collocations(docs: DataFrame, max_words: int = 3, min_count: int = 10, cover: int = 50, top: int = 2000,
                 text: str = "text", lang: str = "lang") -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n and score.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and pieces into words at spaces and tabs.
    A phrase is two to ``max_words`` (2 or 3) words in a row within a piece; one that occurs ``a >= min_count`` times
    is a candidate. For a cut into parts that occur l and r times its score is ``floor(1000000 a a / (l r))``; the cut
    of the lowest score counts, then the one that comes first. A candidate goes if a longer candidate holds its words
    in a row and occurs ``cover`` percent as often or more. Ranks are by score, then a, then the phrase's bytes; n
    counts all words of the language.

    Phrases are counted one width after the other. What a candidate is made of occurs at least as often as it does, so
    the rarer words and pairs are kept out of the next count by a sieve of fixed size; counts are exact. Products are
    decimals of 38 digits: counts up to 10^13 fit, beyond it Spark raises an error.

    A null text counts as empty, a null language as ``und`` (together with rows that say so). Repeated rows count each
    time. Other columns are not read. No rows, or no candidates, give an empty result.
    """
    if max_words not in (2, 3):
        raise ValueError("phrases have 2 or 3 words")
    scratch = Scratch(docs.sparkSession, "phrases")
    words = scratch.write("words", count_phrases(docs, 1, None, text, lang))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    words = words.filter(F.col("n") >= min_count)
    counts = {1: words}
    for width in range(2, max_words + 1):
        sieve = make_sieve(counts[width - 1], width - 1)
        found = count_phrases(docs, width, sieve, text, lang).filter(F.col("n") >= min_count)
        counts[width] = scratch.write(f"width{width}", found)
    scored = None
    for width in range(2, max_words + 1):
        cuts = counts[width].withColumnRenamed("n", "a")
        for k in range(1, width):
            for side, n, size in (("l", k, k), ("r", k - width, width - k)):
                part = counts[size].select("lang", F.col("phrase").alias(f"{side}_part"), F.col("n").alias(f"{side}{k}"))
                cuts = cuts.withColumn(f"{side}_part", F.substring_index("phrase", " ", n)).join(
                    part, ["lang", f"{side}_part"]).drop(f"{side}_part")
        best = F.array_min(F.array(*[
            F.struct(_score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"),
                     F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, width)]))
        # The lowest cut is at hand as a struct: score, then k.
        cuts = cuts.select("lang", "phrase", "a", F.lit(width).alias("width"), best.alias("cut"))
        scored = cuts if scored is None else scored.unionByName(cuts)
    if max_words == 3:
        longer = counts[3].select("lang", F.explode(F.array(
            F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2))).alias("phrase"), "n")
        longest = longer.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
        scored = scored.join(longest, ["lang", "phrase"], "left").filter(
            F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * cover))
    best_first = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # The best of each of a language's parts first, so that its ranks are given to a bounded number of rows.
    parted = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn(
        "part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    in_part = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best_first))
    front = parted.withColumn("place", in_part).filter(F.col("place") <= top)
    ranked = front.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best_first)))
    return ranked.filter(F.col("rank") <= top).join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)), exactly."""
    a, left, right = (c.cast("decimal(13,0)") for c in (a, left, right))
    return F.call_function("div", a * a * F.lit(1_000_000).cast("decimal(7,0)"), left * right)
