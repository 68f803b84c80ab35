import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from cohortis.llm import collocations, exact_dedup, periodic
from cohortis.llm.common import Scratch
from conftest import SF, TEXTS


# Collocations

def phrase_texts(seed, n=300):
    rng = random.Random(seed)
    words = ["a", "B", "the", "of", "new", "york", "city", "tübingen", "ß", "x\x1fy", "😀", "it's"]
    fixed = ["new york city", "of the", "tübingen ß", "Upon a time"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < .3 else rng.choice(words) for _ in range(rng.randint(0, 40))]
        text = "".join(p + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "! "]) for p in parts)
        rows.append((rng.choice(["en", "en", "en", "de", None, "und", ""]), rng.choice([text, text, text, None, ""])))
    return rows


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("seed,lean,burst", [(1, 1_000_000, 4096), (2, 20, 2), (3, 200, 8)])
def test_collocations_equal_brute_force(spark, monkeypatch, seed, lean, burst):
    rows = phrase_texts(seed)
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("phrase", F.lit(1)).withColumn("n", F.lit("x"))
    monkeypatch.setattr(collocations, "BURST", burst)
    monkeypatch.setattr(collocations.count_phrases, "__defaults__", (None, "text", "lang", lean))
    got = rows_of(collocations.collocations(df.repartition(3)))
    assert got == sorted(brute.collocations(rows)) and len(got) > 20


def test_trie_spills_and_bursts_keep_counts():
    rng = np.random.default_rng(5)
    counter = collocations.PhraseCounter(3, None, lean=3000)
    blob = b" ".join(b"." if w == 0 else b"w%d" % w for w in rng.zipf(1.3, 30_000) % 60)
    runs, nodes, old = [], 0, collocations.BURST
    collocations.BURST = 16
    try:
        for part in collocations.slices(blob, 3, 5_000):
            runs += counter.add(b"en", part)
            nodes += sum(isinstance(c, collocations.TrieNode) for c in counter.root.children)
        assert nodes and len(runs) > 3
        runs += counter.spill(0)
    finally:
        collocations.BURST = old
    got = {}
    for run in runs:
        phrases = run.column(2).to_pylist()
        assert phrases == sorted(phrases, key=lambda p: p.split(" "))
        for p, n in zip(phrases, run.column(3).to_pylist()):
            got[p] = got.get(p, 0) + n
    want = {}
    for piece in blob.split(b"."):
        w = piece.decode().split()
        for i in range(len(w) - 2):
            want[" ".join(w[i:i + 3])] = want.get(" ".join(w[i:i + 3]), 0) + 1
    assert got == want


@pytest.mark.parametrize("width", [1, 2, 3])
def test_slices_hold_each_phrase_once(width):
    words = [b"w%d" % i for i in range(5_000)]  # no full stop anywhere
    grams = []
    for part in collocations.slices(b" ".join(words), width, 100):
        part = part.split()
        grams += [tuple(part[i:i + width]) for i in range(len(part) - width + 1)]
    assert grams == [tuple(words[i:i + width]) for i in range(len(words) - width + 1)]


def test_a_full_sieve_changes_no_count(spark):
    rows = phrase_texts(7)
    df = spark.createDataFrame(rows, "lang string, text string")
    full = np.full(64, 255, np.uint8)
    free = {tuple(r) for r in collocations.count_phrases(df, 2).collect()}
    assert {tuple(r) for r in collocations.count_phrases(df, 2, full).collect()} == free
    known = [r for r in collocations.count_phrases(df, 1).collect() if r["n"] >= 40]
    sieve = collocations.make_sieve(spark.createDataFrame(known), 1)
    words = {(r["lang"], r["phrase"]) for r in known}
    sieved = {tuple(r) for r in collocations.count_phrases(df, 2, sieve).collect()}
    assert sieved == {r for r in free if all((r[0], w) in words for w in r[1].split(" "))} and 0 < len(sieved) < len(free)


def test_collocations_of_odd_and_empty_tables(texts, no_texts):
    got = rows_of(collocations.collocations(texts.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en"))))
    want = brute.collocations([("en" if i is not None and i % 2 == 0 else None, t) for i, t, _ in TEXTS])
    assert got == sorted(want) and got
    assert collocations.collocations(no_texts).count() == 0


def test_large_counts_do_not_overflow(spark):
    df = spark.createDataFrame([(9_999_999_999_999, 9_999_999_999_999, 10**13 - 1)], "a long, l long, r long")
    assert df.select(collocations._score(*map(F.col, "alr"))).first()[0] == 1_000_000


# Exact dedup

def test_exact_groups_of_odd_texts(texts, no_texts):
    got = exact_dedup.exact_groups(texts, keep=["doc_id", "text", "size"]).collect()
    want = brute.exact_groups([(i, t) for i, t, _ in TEXTS])
    assert sorted(map(str, ((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got))) == sorted(map(str, want))
    kept = [r for r in got if r["kept"]]
    assert len({r["text_sha256"] for r in kept}) == len(kept) == len({r["text_sha256"] for r in got})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)
    left = exact_dedup.drop_exact_duplicates(texts)
    assert left.columns == texts.columns and left.count() == len(kept)
    assert exact_dedup.exact_groups(no_texts).count() == 0


@pytest.mark.parametrize("capacity,seen,bits", [(None, 1 << 20, 64), (3, 50, 64), (2, 0, 5), (1, 0, 0)])
def test_exact_groups_split_buckets_and_chain_collisions(spark, monkeypatch, capacity, seen, bits):
    rng = random.Random(bits)
    rows = [(i, rng.choice(["hot copy", "Hot Copy", "t%d" % rng.randrange(400), "x" * rng.randrange(30)])) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    monkeypatch.setattr(exact_dedup._entries, "__defaults__", (exact_dedup.key_of, seen))

    def short_key(text):
        return exact_dedup.key_of(text) >> (64 - bits) if bits else 7

    got = exact_dedup.exact_groups(df, capacity=capacity, hash_key=short_key).collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got} == set(brute.exact_groups(rows))
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)


def test_without_lower_casing(spark):
    df = spark.createDataFrame([(1, "A"), (2, "a"), (3, "A"), (4, "Ä"), (5, "ä")], "doc_id long, text string")
    assert {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_groups(df, lower=False).collect()} == {1: 3, 2: 2, 3: 3, 4: 4, 5: 5}
    assert {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_groups(df).collect()} == {1: 3, 2: 3, 3: 3, 4: 4, 5: 5}


def test_directory_covers_all_keys_and_splits_overfull_buckets(spark):
    rng = np.random.default_rng(3)
    dense = rng.integers(0, 1000, 300) + (1 << 40)  # many keys with one long prefix
    keys = [int(k) for k in np.concatenate([rng.integers(-2**63, 2**63 - 1, 2000), dense, np.full(500, -5), [2**63 - 1, -2**63]])]
    heads = spark.createDataFrame([(k, 10) for k in keys], "key long, size long")
    buckets = exact_dedup.directory(heads, capacity=20)
    lows = [b[0] for b in buckets]
    assert lows[0] == -(1 << 63) and lows == sorted(set(lows)) and sum(b[2] for b in buckets) == len(keys)
    for (low, depth, n, size), high in zip(buckets, [*lows[1:], 1 << 63]):
        inside = [k for k in keys if low <= k < high]
        assert len(inside) == n and size == 10 * n and high - low == 1 << (64 - depth)
        assert n <= 20 or len(set(inside)) == 1


def test_index_pages_name_leaders(spark):
    heads = spark.createDataFrame([(1, 10, "b"), (1, 11, "a"), (1, 12, "b"), (2, 13, "a")], "key long, entry long, text string")
    pages = exact_dedup.build_index(heads, Scratch(spark, "test"), capacity=1).collect()
    assert {r["entry"]: r["leader"] for r in pages} == {10: 10, 11: 11, 12: 10, 13: 13}


# Periodic runs

def run_words(rng):
    k, words = rng.choice([1, 2, 3, 5, 20, 200]), []
    for _ in range(rng.randint(0, 10)):
        unit = [str(rng.randrange(k)) for _ in range(rng.randint(1, 30))]
        words += (unit * rng.randint(1, 12))[:rng.randint(1, 200)] if rng.random() < .6 else unit
        if words and rng.random() < .2:
            words[rng.randrange(len(words))] = "odd"
    return words


@pytest.mark.parametrize("min_length,min_periods", [(24, 3), (4, 2), (2, 2), (10, 3), (30, 5)])
def test_runs_equal_brute_force(min_length, min_periods):
    rng = random.Random(min_length)
    for _ in range(400):
        words = run_words(rng)
        want = brute.periodic_runs(words, min_length, min_periods)
        assert periodic.runs_of([w.encode() for w in words], min_length, min_periods) == want


def test_segments_hold_frequent_words_only():
    ids = np.array([9] + [0, 1] * 14 + [8] + [2] * 23 + [9, 9] + [0] * 30)
    assert periodic.segments(ids) == [(1, 29), (55, 85)]
    assert periodic.segments(np.arange(100)) == [] and periodic.segments(np.array([], np.int64)) == []


def test_long_texts_need_no_square_of_their_length():
    words = [b"%d" % (i % 70_001) for i in range(300_000)]
    assert periodic.runs_of(words) == [(0, 300_000, 70_001)]
    assert periodic.runs_of([b"a"] * 300_000) == [(0, 300_000, 1)]


def test_collapse_odd_texts(texts, no_texts):
    got = {r["doc_id"]: r for r in periodic.collapse_runs(texts.withColumn("start", F.lit(1))).collect()}
    assert got[14]["text"] == "x" and [tuple(r) for r in got[14]["runs"]] == [(0, 5000, 1)]
    assert got[15]["text"] == "same line of six words here" and [tuple(r) for r in got[15]["runs"]] == [(0, 54, 6)]
    assert got[4]["text"] is None and got[4]["runs"] == [] and got[3]["text"] == got[5]["text"] == ""
    assert got[11]["text"] == "tab and vertical \u3000 wide é ﬁ 😀 end" and got[15]["size"] == 1
    assert [tuple(r) for r in got[6]["runs"]] == [(0, 60_000, 701)]
    assert periodic.collapse_runs(no_texts).count() == 0
    with pytest.raises(ValueError):
        periodic.collapse_runs(texts, min_periods=1)


def test_run_query_equals_brute_force(spark, documents):
    got = queries()["op13_periodic_runs"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(brute.run_digests(r["doc_id"], r["text"]) for r in documents.collect())
    assert sum(r["n_runs"] > 0 for r in got) >= 10


def test_planting_of_odd_rows(spark):
    from cohortis.llm.queries import with_planted_runs
    rows = [(i, " ".join(f"w{j}" for j in range(i))) for i in range(60)] + [(None, "a b"), (500, None), (501, "")]
    got = {r["doc_id"]: r["text"] for r in with_planted_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert (got[i] or "").split() == (brute.plant(i, t.split()) if t else [])
