import zlib
from collections import defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from __spark_entry__ import queries
from cohortis.llm import mixing, packing
from conftest import SF, TEXTS, vocabulary


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=30))
def test_packs_hold_every_piece_once(histogram):
    patterns = packing.pack_histogram(histogram, 64)
    used = defaultdict(int)
    for pattern, packs in patterns:
        assert sum(pattern) <= 64 and packs > 0
        for length in pattern:
            used[length] += packs
    assert dict(used) == histogram
    for length, (lows, firsts, offsets) in packing.placements(patterns).items():
        assert lows[0] == 0 and (np.diff(lows) > 0).all() and len(lows) == len(firsts) == len(offsets)


@pytest.mark.parametrize("entries", [900_000, 300])
def test_encoder_equals_the_library(documents, monkeypatch, entries):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    monkeypatch.setattr(packing, "CACHE_ENTRIES", entries)
    library = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        encoder = packing.CachedEncoder(f.read())
    texts = [t for _, t, _ in TEXTS if t] + [r["text"] for r in documents.collect()] + [
        " a", "a ", "a  b", "a \nb", "a\n b", "\n\n a", "it's we'll 12 345 'tis", "a\u3000 b", "<|endoftext|>x", "a\u00a0 b", "  ",
        "a b.c. d.", "x y.\nZ", "x y.\n\nZ w", "a 1.\n2 3,", "a b..", "a 's. t's.", "a é.\né, b", "a ́. b", "a b.\n. c",
        "q r\r\ns t", "a b\n,c d.\n", "a \u0120b c\tb", ". . .", "a\n\u2028 b c"]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def check_packing(rows, texts, library):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, text in texts.items():
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            piece = ids[at:at + r["length"]]
            assert (r["start"], r["ids_crc32"], r["doc_tokens"]) == (at, zlib.crc32(piece.tobytes()), len(ids))
            at += r["length"]
        assert at == len(ids)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    return sum(r["length"] for r in rows) / (packing.CAPACITY * len(by_sequence))


def test_packing_query(spark, documents):
    from tokenizers import Tokenizer

    rows = queries()["op5_packing"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert check_packing(rows, texts, Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))) > 0.97


def test_odd_texts_are_packed(spark, texts, no_texts):
    with open(vocabulary("byte_bpe_50k.json"), encoding="utf-8") as f:
        tokenizer = f.read()
    pieces = packing.token_pieces(texts, tokenizer)
    lengths = {r["doc_id"]: r["doc_tokens"] for r in pieces.collect()}
    assert lengths[3] == lengths[4] == 1 and lengths[6] > 100_000
    got = packing.pack(pieces.withColumnRenamed("start", "offset").drop("ids")).collect()
    assert len(got) == pieces.count() and len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
    assert packing.pack(packing.token_pieces(no_texts, tokenizer)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 2049)], "id int, length long"))


def test_ranks_spread_over_salts(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_SALT", 7)
    df = spark.range(3000).selectExpr("id", "case when id % 3 = 0 then 700 else 1 + id % 97 end as length").repartition(5)
    got = packing.pack(df, 1024).collect()
    spans = defaultdict(list)
    for r in got:
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in spans.values():
        pieces.sort()
        assert all(a[0] + a[1] == b[0] for a, b in zip(pieces, pieces[1:])) and pieces[-1][0] + pieces[-1][1] <= 1024
    assert len(got) == 3000 and sorted(r["id"] for r in got) == list(range(3000))


# Mixing

@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=2), st.integers(0, 500), min_size=1, max_size=7))
def test_brute_targets_are_feasible(sizes):
    targets = brute.mix_targets(sizes, [5, 2, 1])
    assert all(targets[s] <= 2 * sizes[s] + 1e-9 for s in sizes)
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()), abs=1e-6)


def source_totals(rows):
    sizes, taken, targets = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        targets[r["source"]] = r["target"]
    return dict(sizes), dict(taken), targets


@pytest.mark.parametrize("share,most", [(1.5, 2.0), (0.4, 2.0), (3.0, 2.0), (1.0, 1.0), (2.2, 5.0)])
def test_plan_meets_targets(spark, documents, share, most):
    rows = mixing.mix_plan(documents, [5, 2, 1], share, most).collect()
    sizes, taken, targets = source_totals(rows)
    want = brute.mix_targets(sizes, [5, 2, 1], share, most)
    for s in sizes:
        assert targets[s] == pytest.approx(want[s], rel=1e-12) and all(r["source_size"] == sizes[s] for r in rows if r["source"] == s)
        smallest = min((r["size"] for r in rows if r["source"] == s and r["size"]), default=0)
        assert abs(taken[s] - targets[s]) <= 0.02 * targets[s] + smallest / 2 + 1  # sources of forty documents
    assert all(0 <= r["copies"] <= -(-most // 1) for r in rows)


def test_plan_is_repeatable_and_keeps_odd_rows(texts, no_texts):
    plan = lambda df: sorted(map(str, mixing.mix_plan(df, [5, 2, 1]).collect()))
    first = plan(texts)
    assert first == plan(texts.repartition(7)) and len(first) == len(TEXTS)
    sizes, taken, targets = source_totals(mixing.mix_plan(texts, [5, 2, 1]).collect())
    assert targets == pytest.approx(brute.mix_targets(sizes, [5, 2, 1])) and None in sizes
    assert mixing.mix_plan(no_texts, [5, 2, 1]).count() == 0 and mixing.mix_documents(no_texts, [1]).count() == 0


def test_mixed_documents_follow_the_plan(texts):
    copies = defaultdict(int)
    for r in mixing.mix_plan(texts, [5, 2, 1]).collect():
        copies[r["doc_id"]] += r["copies"]
    mixed = mixing.mix_documents(texts, [5, 2, 1])
    got = defaultdict(int)
    for r in mixed.collect():
        got[r["doc_id"]] += 1
    assert mixed.columns == texts.columns and dict(got) == {k: v for k, v in copies.items() if v}


def test_mixing_query(spark, documents):
    rows = queries()["op10_mixing"](spark, SF).collect()
    sizes = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in documents.collect()}
    assert {r["doc_id"]: r["size"] for r in rows} == sizes and all(r["taken"] <= 2 * r["size"] for r in rows)


def test_a_document_larger_than_the_remainder_stops_nothing(spark):
    rng = np.random.default_rng(5)
    rows = [(f"{s}-{i}", s, int(n)) for s in "abcdef" for i, n in enumerate([*rng.integers(20, 500, 200), 120_000])]
    docs = spark.createDataFrame(rows, "doc_id string, source string, n int").selectExpr(
        "doc_id", "source", "repeat('w ', n) as text").repartition(4)
    plan = mixing.mix_plan(docs, [1], 0.25, 2.0).collect()
    sizes, taken, targets = source_totals(plan)
    assert len(plan) == len(rows) and all(r["copies"] <= 1 for r in plan)
    assert all(abs(taken[s] - targets[s]) <= 0.001 * targets[s] for s in sizes)
    words = defaultdict(int)
    for r in mixing.mix_documents(docs, [1], 0.25, 2.0).selectExpr("source", "(length(text) / 2)::long as n").collect():
        words[r["source"]] += r["n"]
    assert dict(words) == taken


@pytest.mark.parametrize("share", [0.25, 1.5, 3.0])
@pytest.mark.parametrize("large_share", [2000, 20])
def test_targets_are_met_beside_a_very_long_document(spark, monkeypatch, share, large_share):
    monkeypatch.setattr(mixing, "LARGE_SHARE", large_share)
    rng = np.random.default_rng(5)
    rows = [(f"{s}-{i}", s, int(n)) for s in "abcdef" for i, n in enumerate([*rng.integers(20, 500, 200), 120_000])]
    docs = spark.createDataFrame(rows, "doc_id string, source string, n int").selectExpr(
        "doc_id", "source", "repeat('w ', n) as text").repartition(4)
    plan = mixing.mix_plan(docs, [5, 2, 1], share).collect()
    sizes, taken, targets = source_totals(plan)
    assert len(plan) == len(rows) and all(0 <= r["copies"] <= 2 for r in plan)
    assert targets == pytest.approx(brute.mix_targets(sizes, [5, 2, 1], share))
    slack = 0.002 if large_share == 2000 else 0.02
    assert all(abs(taken[s] - targets[s]) <= slack * targets[s] for s in sizes)
    assert sorted(map(str, plan)) == sorted(map(str, mixing.mix_plan(docs.repartition(7), [5, 2, 1], share).collect()))


def test_mixing_query_equals_its_sql_with_few_large_documents(spark, monkeypatch):
    import oracle
    from cohortis.llm import sql

    monkeypatch.setattr(mixing, "LARGE_SHARE", 50)
    monkeypatch.setattr(sql, "LARGE_SHARE", 50)
    got = queries()["op10_mixing"](spark, SF)
    assert oracle.compare("op10_mixing", got, oracle.connect(SF), sql.mixing([5, 2, 1])) == []


def test_texts_become_strings_in_slices(monkeypatch):
    held = []

    class Column:
        def __init__(self, values):
            self.values = values

        def __len__(self):
            return len(self.values)

        def slice(self, at, n):
            held.append(n)
            return pa.array(self.values[at:at + n], pa.string())

    values = [None if i % 7 == 0 else f"text {i}" for i in range(150)]
    assert list(packing.texts_of(Column(values))) == [v or "" for v in values]
    assert held == [packing.SLICE_ROWS] * 3
    assert list(packing.texts_of(pa.array(values)[5:9])) == [v or "" for v in values[5:9]]
