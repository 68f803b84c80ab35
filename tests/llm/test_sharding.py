import zlib
from collections import defaultdict

import numpy as np
import pytest

from __spark_entry__ import queries
from cohortis.llm.sharding import communication_matrix, hypergeometric, shuffle_to_shards
from conftest import SF


def test_matrix_has_exact_margins():
    sizes, room = [0, 5, 17, 1, 40], [16, 16, 16, 15]
    m = communication_matrix(sizes, room, 1)
    assert m.sum(axis=1).tolist() == sizes and m.sum(axis=0).tolist() == room and (m >= 0).all()


def test_hypergeometric_follows_its_law():
    rng = np.random.default_rng(3)
    drawn = np.array([hypergeometric(rng, 30, 70, 20) for _ in range(20_000)])
    assert abs(drawn.mean() - 6) < 0.05 and abs(drawn.var() - 20 * 0.3 * 0.7 * 80 / 99) < 0.12
    assert [hypergeometric(rng, 5, 0, 3), hypergeometric(rng, 0, 5, 3), hypergeometric(rng, 4, 4, 8)] == [3, 0, 4]
    large = hypergeometric(rng, 20_000_000_000, 30_000_000_000, 1_000_000)
    assert abs(large - 400_000) < 5_000


def test_every_row_and_column_is_kept(texts):
    got = shuffle_to_shards(texts.withColumnRenamed("size", "slot"), 4).collect()
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert sorted(len(v) for v in by.values()) == [4, 4, 4, 5]
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    key = lambda r: str((r["doc_id"], r["text"], r["source"], r["score"]))
    assert sorted(map(key, got)) == sorted(map(key, texts.collect()))


def test_empty_and_fewer_rows_than_shards(texts, no_texts):
    assert shuffle_to_shards(no_texts, 8).count() == 0
    assert sorted(r["shard"] for r in shuffle_to_shards(texts.limit(3), 8).collect()) == [0, 1, 2]


def test_assignment_is_uniform(spark):
    df = spark.range(4000).repartition(7)
    got = shuffle_to_shards(df, 8, seed=1).collect()
    halves = np.zeros((8, 2))
    for r in got:
        halves[r["shard"], int(r["id"] >= 2000)] += 1
    assert halves.sum(axis=1).tolist() == [500] * 8 and np.abs(halves - 250).max() < 60
    order = [r["id"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"])) if r["shard"] == 0]
    assert abs(np.corrcoef(order, range(500))[0, 1]) < 0.2


def test_query(spark, documents):
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    got = queries()["op1_sharding"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "rows")
    assert pytest.approx(len(texts) / 8, abs=1) == sum(r["shard"] == 0 for r in got)
