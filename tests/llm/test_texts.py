from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from cohortis.llm import line_dedup, quality, simhash, token_counts
from conftest import LONG, SF, TEXTS, vocabulary


# SimHash

def test_fingerprints_equal_brute_force():
    texts = [t for _, t, _ in TEXTS if t != LONG and (t is None or len(t) < 20_000)]
    got = [int(f) & (2**64 - 1) for f in simhash.fingerprints(texts, 3)]
    assert got == [brute.fingerprint(t) for t in texts]


def test_long_texts_are_hashed_in_chunks(monkeypatch):
    whole = simhash.fingerprints([LONG, "a b c d"], 3)
    monkeypatch.setattr(simhash, "FLUSH", 1000)
    monkeypatch.setattr(simhash.shingle_hashes, "__defaults__", (777,))
    assert simhash.fingerprints([LONG, "a b c d"], 3).tolist() == whole.tolist()


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 4, 6])
def test_near_pairs_equal_brute_force(spark, distance):
    rng = np.random.default_rng(distance)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64) * np.uint64(2)
    prints = set(base.tolist())
    for p in base.tolist():
        for _ in range(6):
            for b in rng.choice(64, rng.integers(1, 8), replace=False):
                p ^= 1 << int(b)
            prints.add(p)
    rows = [(i, p - 2**64 if p >= 2**63 else p) for i, p in enumerate(sorted(prints))]
    df = spark.createDataFrame(rows, "node long, fp long")
    want = {(a, b) for a, p in rows for b, q in rows if a < b and ((p ^ q) & (2**64 - 1)).bit_count() <= distance}
    assert {tuple(r) for r in simhash.near_pairs(df, distance).collect()} == want


def test_probes_are_never_broadcast(spark):
    df = spark.range(50).select(F.col("id").alias("node"), F.xxhash64("id").alias("fp"))
    plan = simhash.near_pairs(df, 3)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_groups_and_survivors(texts, no_texts):
    got = simhash.simhash_groups(texts).collect()
    assert len(got) == len(TEXTS)
    rows = {i: t for i, t, _ in TEXTS if i is not None and i not in (6, 7)}
    want = brute.simhash(list(rows.items()))
    for r in got:
        if r["doc_id"] in rows:
            assert (r["fingerprint"], r["component_id"]) == want[r["doc_id"]]
    assert {r["component_id"] for r in got if r["doc_id"] in (3, 4, 5)} == {3}
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [12]
    kept = simhash.drop_near_duplicates(texts)
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert kept.columns == texts.columns and ids.count(8) == 1 and not {None, 2, 4, 5, 9} & set(ids)
    assert simhash.simhash_groups(no_texts).count() == 0 and simhash.drop_near_duplicates(no_texts).count() == 0


def test_rows_without_an_id_are_linked(spark):
    words = [f"w{i}" for i in range(4000)]
    chain = [" ".join([*words, *(["tail"] * n)]) for n in (0, 6, 12, 18, 24)]
    rows = [(7, chain[0], "a"), (None, chain[1], "b"), (3, chain[2], "c"), (None, "nobody has an id here", "d"),
            (None, "nobody has an id here", "e"), (None, "Nobody has an ID here", "f"), (None, "alone", "g"), (50, "else", "h"),
            (None, None, "i")]
    named = [(100 + i if r[0] is None else r[0], r[1]) for i, r in enumerate(rows)]
    want = brute.simhash(named)
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.simhash_groups(df).collect())
    ids = {r[0] for r in rows if r[0] is not None}
    assert got == Counter((i if i in ids else None, want[i][0], want[i][1] if want[i][1] in ids else None) for i, _ in named)
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    stays = {(r["doc_id"], (r["text"] or "").lower()) for r in kept.collect()}
    assert stays == {(i if i in ids else None, (t or "").lower()) for i, t in named if want[i][1] == i}
    assert kept.count() == len({c for _, c in want.values()})


def test_simhash_query(spark, documents):
    want = brute.simhash([(r["doc_id"], r["text"]) for r in documents.collect()])
    got = queries()["op4_simhash"](spark, SF).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == want


# Line dedup

def lines_of(rng, n, kinds):
    return "\n".join(" ".join(["w%d" % k] * (k % 4)) for k in rng.integers(0, kinds, n))


@pytest.mark.parametrize("min_words,kinds", [(1, 12), (3, 8), (5, 6), (9, 5)])
def test_line_dedup_equals_brute_force(spark, min_words, kinds):
    rng = np.random.default_rng(min_words)
    rows = [(int(i), lines_of(rng, rng.integers(1, 30), kinds)) for i in rng.permutation(60)] + [(100, None), (101, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = line_dedup.dedup_lines(df, min_words).collect()
    assert {r["doc_id"]: r["text"] for r in got} == brute.dedup_lines(rows, min_words)
    for r in got:
        assert r["n_lines"] == (0 if r["doc_id"] == 100 else dict(rows)[r["doc_id"]].count("\n") + 1)
        assert (r["n_removed"] > 0) == bool(r["first_docs"])


def test_line_dedup_edges(texts, no_texts):
    got = line_dedup.dedup_lines(texts.withColumnRenamed("size", "n_lines")).collect()
    assert len(got) == len(TEXTS)
    by = {r["doc_id"]: r for r in got if r["doc_id"] != 8}
    assert by[1]["text"] == TEXTS[0][1] and by[2]["text"] == "" and by[2]["first_docs"] == [1] and by[2]["n_removed"] == 2
    assert by[3]["text"] == "" and by[4]["text"] is None and by[5]["text"] == " \n\t " and by[6]["text"] == LONG
    assert by[15]["text"] == "same line of six words here" and by[12]["text"] == "no id at all"
    assert by[None]["text"] == "no id at all"  # four words are not worth deleting
    assert by[13]["text"] == TEXTS[14][1] and by[1]["rid"] == "x"
    assert line_dedup.dedup_lines(no_texts).count() == 0


def test_line_dedup_query(spark, documents):
    want = brute.dedup_lines([(r["doc_id"], r["text"]) for r in documents.collect()])
    got = queries()["op7_line_dedup"](spark, SF).collect()
    assert {r["doc_id"]: r["text"] for r in got} == want


# Token counts

def test_token_counts_equal_the_library(spark, texts, no_texts, documents):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as f:
        model = f.read()
    df = texts.unionByName(documents, allowMissingColumns=True).withColumnRenamed("size", "n_tokens")
    got = token_counts.count_tokens(df, model).collect()
    assert len(got) == df.count() and set(got[0].asDict()) == set(df.columns)
    assert all(r["n_tokens"] == len(library.encode(r["text"] or "")) for r in got)
    assert token_counts.count_tokens(no_texts, model).count() == 0


def test_misses_and_full_caches(spark, documents, monkeypatch):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    with open(path, "rb") as f:
        model = f.read()
    monkeypatch.setattr(token_counts, "TABLE_ENTRIES", 5)
    monkeypatch.setattr(token_counts, "CACHE_ENTRIES", 50)
    monkeypatch.setattr(token_counts, "TASK_KEYS", 300)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = token_counts.count_tokens(documents.limit(60), model).collect()
    assert all(r["n_tokens"] == len(library.encode(r["text"])) for r in got)


def test_texts_that_hold_the_space_mark(spark):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as f:
        model = f.read()
    texts = ["a ▁ ▁ b", "load ▁ ▂ ▁ ▁ ▃ end", "name: ▁▁▁ ▁▁▁ date", "x ▁▁ ▁▁ ▁▁ y", "▁", "a▁b c", "plain words"]
    got = token_counts.count_tokens(spark.createDataFrame([(t,) for t in texts], "text string"), model, keep=["text"])
    assert {r["text"]: r["n_tokens"] for r in got.collect()} == {t: len(library.encode(t)) for t in texts}


def test_token_count_query(spark):
    got = queries()["op9_token_counts"](spark, SF)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert got.filter((F.col("n_tokens") > 4096) != F.col("over_limit")).count() == 0


# Quality

def test_trees_learn_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    model = quality.fit_trees(x[:3000], y[:3000])
    score = model.score(x[3000:])
    assert ((score > 0.5) == y[3000:]).mean() > 0.97 and 0 < score.min() and score.max() < 1

    def walk(row):
        total = model.base
        for feature, cut, value in zip(model.feature, model.cut, model.value):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > cut[node])
            total += value[node - len(feature)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose([walk(r) for r in x[:50]], model.score(x[:50]))


def test_trees_without_both_labels():
    assert quality.fit_trees(np.zeros((0, 3)), np.zeros(0)).score(np.ones((2, 3))).tolist() == [0.5, 0.5]
    assert quality.fit_trees(np.zeros((9, 3)), np.ones(9)).score(np.ones((1, 3)))[0] > 0.9


def test_statistics_of_odd_texts():
    got = quality.statistics([t for _, t, _ in TEXTS])
    assert np.isfinite(got).all() and not got[2:5].any() and got[5, 1] == pytest.approx(np.log1p(60_000))


def test_scores_depend_on_text_alone(spark, texts, no_texts, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels = labels.union(labels).unionByName(spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int"),
                                              allowMissingColumns=True)
    model = quality.fit_quality(documents, labels)
    got = quality.score_quality(texts, model).collect()
    assert set(got[0].asDict()) == set(texts.columns) and len(got) == len(TEXTS)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (3, 4, 5)}) == 1
    assert quality.score_quality(no_texts, model).count() == 0
    assert quality.fit_quality(documents, labels.limit(0)).score(np.zeros((1, 18)))[0] == 0.5


def test_a_repeated_id_is_one_row_of_the_sample(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("if(id < 2900, 7, id) as doc_id", "concat('text ', id) as text").repartition(4)
    labels = spark.createDataFrame([(7, 1), (2950, 0), (2960, 1)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit_trees", lambda x, y: seen.append((x.shape, y.tolist())))
    quality.fit_quality(docs, labels)
    assert seen == [((3, len(quality.STATISTICS)), [1, 0, 1])]


def test_quality_on_held_out_rows(spark):
    sf = SF.replace("0.001", "0.1")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in queries()["op3_quality"](spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    hits = [r["predicted"] == labels[r["doc_id"]] for r in got]
    good = [r["predicted"] for r in got if labels[r["doc_id"]] == 1]
    assert len(hits) > 500 and np.mean(hits) > 0.95 and np.mean(good) > 0.98
