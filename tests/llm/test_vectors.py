import brute
import numpy as np
import pytest

from __spark_entry__ import queries
from cohortis.llm import topk, vector_dedup
from conftest import SF


def clustered(n=240, dim=64, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 6, dim))
    rows = [(base[i % len(base)] + rng.standard_normal(dim) * (0.05 + 0.1 * (i % 7))).astype(np.float32) for i in range(n)]
    out = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    out += [(n + k, out[3][1]) for k in range(5)] + [(n + 5, [2 * x for x in out[3][1]])]
    nan, inf = float("nan"), float("inf")
    return out + [(n + 10, None), (n + 11, [0.0] * dim), (n + 12, [nan] * dim), (n + 13, [inf] + [1.0] * (dim - 1)),
                  (n + 14, []), (n + 15, [None] + [1.0] * (dim - 1)), (n + 16, [1.0, 2.0]), (n + 17, [1.0, 2.01]),
                  (n + 18, [1e30, 2e30]), (n + 19, [-1.0])]


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(i, v, "x", 1) for i, v in clustered()]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string, v int").repartition(4)


@pytest.mark.parametrize("pivots,block_rows", [(256, 4096), (4, 16), (1, 7)])
def test_links_equal_brute_force(vectors, pivots, block_rows):
    want = brute.near_vectors(clustered())
    got = vector_dedup.near_vectors(vectors, 0.9, pivots=pivots, block_rows=block_rows).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert sum(n for n, _ in want.values()) > 300


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    o = rng.standard_normal((4000, 64))
    q = o + rng.standard_normal((4000, 64)) * 0.45
    o, q = (x / np.linalg.norm(x, axis=1)[:, None] for x in (o, q))
    code, factor = vector_dedup.encode(o)
    signs = (np.unpackbits(code, axis=1, bitorder="little") * 2.0 - 1) / 8
    estimate = (signs * (q @ vector_dedup.rotation(64).T)).sum(axis=1) / factor
    true = (o * q).sum(axis=1)
    assert abs((estimate - true).mean()) < 0.003
    near = true >= 0.9
    error = (estimate - true)[near] / vector_dedup.error_scale(factor, 64, 0.9)[near]
    assert near.sum() > 500 and error.std() < 1.1 and np.abs(error).max() < vector_dedup.SIGMAS


def test_null_ids_repeated_rows_and_no_rows(spark):
    v, w = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, v), (1, v), (None, v), (None, w), (2, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, vector_dedup.near_vectors(df).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 0, None, True),
                          (2, 0, 2, True)], key=str)
    assert vector_dedup.near_vectors(df.limit(0)).count() == 0
    assert vector_dedup.near_vectors(df.filter("embedding is null")).count() == 1


@pytest.mark.parametrize("range_rows,query_rows", [(8192, 1024), (64, 5)])
def test_top_k_equals_brute_force(spark, range_rows, query_rows):
    rows = clustered(400, 16, 2)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    rows = [(i, v) for i, v in rows if not v or not any(x is not None and abs(x) > 1e20 for x in v)]
    df = df.filter("vec_id not in (%d)" % (400 + 18))
    v = topk.quantise(df, 64.0, "embedding", "vec_id")
    got = topk.top_k(v.filter("id % 20 = 0"), v, 20, range_rows, query_rows).collect()
    assert sorted(map(tuple, got)) == sorted(brute.top_k(rows))


def test_top_k_ties_and_edges(spark):
    df = spark.createDataFrame([(i, [1, 1]) for i in range(70)] + [(100, [-5, 0])], "id long, v array<long>")
    got = topk.top_k(df.filter("id = 20"), df, 3).collect()
    assert sorted(map(tuple, got)) == [(20, 1, 0, 2), (20, 2, 1, 2), (20, 3, 2, 2)]
    assert topk.top_k(df.limit(0), df).count() == 0 and topk.top_k(df, df.limit(0)).count() == 0
    alone = df.filter("id = 100")
    assert topk.top_k(alone, alone).count() == 0
    assert topk.top_k(df.filter("id = 20").union(df.filter("id = 20")), df, 3).count() == 3


def test_search_of_one_range():
    rng = np.random.default_rng(0)
    centres = rng.integers(-60, 60, (20, 32))
    docs = np.repeat(centres, 64, axis=0) + rng.integers(-1, 2, (1280, 32))
    q, d, s = topk.search(centres[:3], np.array([-1, -2, -3]), docs, np.arange(1280), 20)
    full = centres[:3] @ docs.T
    for k in range(3):
        want = np.lexsort((np.arange(1280), -full[k]))[:20]
        assert d[q == k].tolist() == want.tolist() and s[q == k].tolist() == full[k][want].tolist()


def test_queries(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = queries()["op2_vector_dedup"](spark, SF).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == brute.near_vectors(rows)
    assert sorted(map(tuple, queries()["op6_topk"](spark, SF).collect())) == sorted(brute.top_k(rows))


def test_blocks_grow_with_the_table_as_far_as_a_task_may_hold(monkeypatch):
    sizes = [vector_dedup.rows_a_block(n, 64, vector_dedup.BLOCK_ROWS) for n in (1_000, 720_000, 10**8)]
    assert sizes == [4096, 45_000, 62_500]
    v = np.random.default_rng(3).normal(size=(60, 8))
    code, factor = vector_dedup.encode(v / np.linalg.norm(v, axis=1)[:, None])
    block = {"v": v, "code": code, "factor": factor}
    whole = [np.concatenate(x) for x in zip(*vector_dedup.linked_pairs(block, None, 0.5))]
    monkeypatch.setattr(vector_dedup, "HELD_ESTIMATES", 200)  # three rows at a time
    pieces = [np.concatenate(x) for x in zip(*vector_dedup.linked_pairs(block, None, 0.5))]
    assert len(whole[0]) > 0 and all(np.array_equal(a, b) for a, b in zip(whole, pieces))
