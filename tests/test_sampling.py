import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cohortis.operators import neighbours as nn
from cohortis.operators import resample as rs
from cohortis.operators import split as sp
from cohortis.operators.ranking import expand_counts, row_numbers


def cases(spark, n=1000, hot=0.7):
    rng = random.Random(3)
    return spark.createDataFrame([(i, int(rng.random() > hot), float(i)) for i in range(n)], "id long, label int, v double")


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_row_numbers_are_dense_and_ordered(spark):
    df = cases(spark)
    got = row_numbers(df, ["label"], "id")
    want = df.withColumn("row_no", (F.row_number().over(W.partitionBy("label").orderBy("id")) - 1).cast("long"))
    assert same(got.select("id", "row_no"), want.select("id", "row_no"))
    shuffled = row_numbers(df, [], "id", seed=1)
    assert sorted(r["row_no"] for r in shuffled.collect()) == list(range(1000))


def test_split_is_exact_whatever_the_partitioning(spark):
    df = cases(spark)
    a, b = (sp.stratified_split(d, "label", "id") for d in (df.repartition(4), df.repartition(16)))
    assert same(a, b)
    n = Counter(r["label"] for r in df.collect())
    test = Counter(r["label"] for r in a.where("split = 'test'").collect())
    assert test == {k: -(-v // 5) for k, v in n.items()}
    assert not same(a, sp.stratified_split(df, "label", "id", seed=7))


def test_folds_are_balanced_with_tiny_and_null_classes(spark):
    df = cases(spark).unionByName(spark.createDataFrame([(5000, 9, 0.0), (5001, None, 0.0)], "id long, label int, v double"))
    got = sp.stratified_folds(df, "label", "id", 5)
    assert got.count() == 1002
    sizes = Counter((r["label"], r["fold"]) for r in got.collect())
    for label in (0, 1):
        per_fold = [sizes[label, f] for f in range(5)]
        assert max(per_fold) - min(per_fold) <= 1


def test_batches(spark):
    got = Counter(r["batch_id"] for r in sp.batches(cases(spark), "id", seed=3).collect())
    assert sorted(got) == list(range(16)) and [got[i] for i in range(15)] == [64] * 15 and got[15] == 40


def test_expand_counts_in_blocks(spark):
    df = spark.createDataFrame([("a", 25), ("b", 0), ("c", 3)], "k string, n long")
    got = Counter((r["k"], r["i"]) for r in expand_counts(df, "n", "i", block=10).collect())
    assert got == Counter([("a", i) for i in range(25)] + [("c", i) for i in range(3)])


def test_oversample_balances_and_repeats(spark):
    df = cases(spark)
    a, b = (rs.random_oversample(d, "label", "id") for d in (df.repartition(3), df.repartition(13)))
    assert same(a, b)
    counts = Counter(r["label"] for r in a.collect())
    assert counts[0] == counts[1] == max(Counter(r["label"] for r in df.collect()).values())
    assert a.where("copy_no = 0").count() == 1000


def test_weighted_draws_follow_the_weights(spark):
    df = cases(spark, hot=0.5)
    got = Counter(r["label"] for r in rs.weighted_resample(df, "label", "id", {0: 1, 1: 2}, n_draws=6000).collect())
    n = Counter(r["label"] for r in df.collect())
    assert sum(got.values()) == 6000
    assert got[1] / 6000 == pytest.approx(2 * n[1] / (n[0] + 2 * n[1]), abs=0.03)


def brute(rows, k):
    out = {}
    for i, g, x in rows:
        near = sorted((round(float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())), 9), j)
                      for j, h, y in rows if h == g and j != i)[:k]
        out[i] = [j for _, j in near]
    return out


def near_lists(pairs):
    out = {}
    for r in pairs.orderBy("id", "rank").collect():
        out.setdefault(r["id"], []).append(r["neighbour"])
    return out


@pytest.mark.parametrize("kind", ["uniform", "copies", "binary", "dense_clump"])
def test_neighbours_equal_brute_force_with_many_cells_and_blocks(spark, kind):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(240):
        x = rng.normal(size=4)
        if kind == "copies" and i % 3 == 0:
            x = np.ones(4)  # a third of all rows are one vector
        if kind == "binary":
            x = (x > 0).astype(float)
        if kind == "dense_clump" and i % 3 == 0:
            x = np.ones(4) + rng.normal(size=4) * 1e-6
        rows.append((i, i % 2, [float(v) for v in x]))
    df = spark.createDataFrame(rows, "id long, g int, x array<double>")
    got = nn.nearest_in_group(df, "g", "id", "x", 5, points_per_cell=15, block_rows=8)
    assert near_lists(got) == brute(rows, 5)
    asked = df.where("id % 7 = 0")
    part = nn.nearest_in_group(df, "g", "id", "x", 5, asked, points_per_cell=15, block_rows=8)
    assert near_lists(part) == {i: v for i, v in brute(rows, 5).items() if i % 7 == 0}


def test_routed_rows_leave_in_pieces_however_many_blocks_a_query_visits():
    rng = np.random.default_rng(4)
    pivots = rng.normal(size=(300, 3))
    part = pd.DataFrame({"g": 0, "cell": -1, "block": -1, "query": np.arange(200), "v": list(rng.normal(size=(200, 3))),
                         "bound": np.inf})
    here = [(i, 1, 0.0, 100.0) for i in range(300)]  # wide cells: the bounds rule out nothing
    blocks = np.arange(300) % 3 + 1
    pieces = list(nn._routes(part, pivots, here, blocks, 5))
    assert max(map(len, pieces)) <= nn.ROUTED_ROWS < sum(map(len, pieces)) == 200 * blocks.sum()
    rows = pd.concat(pieces)
    assert len(rows.drop_duplicates(["query", "cell", "block"])) == len(rows) and (rows["block"] < blocks[rows["cell"]]).all()
    home = part.assign(cell=7, block=1)
    assert sum(map(len, nn._routes(home, pivots, here, blocks, 5))) == 200 * (blocks.sum() - 1)


def test_queries_are_sent_once_to_a_block_of_many_cells(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, 0, [float(v) for v in rng.normal(size=4)]) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, g int, x array<double>")
    kept, visits = [], []
    checkpoint, visit = nn.reliable_checkpoint, nn._visit
    monkeypatch.setattr(nn, "reliable_checkpoint", lambda d: kept.append(set(d.columns)) or checkpoint(d))
    monkeypatch.setattr(nn, "_visit", lambda asked, blocked, pivots, cells, blocks_of, *a: visits.append(
        (len(pivots), sum(blocks_of.values()))) or visit(asked, blocked, pivots, cells, blocks_of, *a))
    got = nn.nearest_in_group(df, "g", "id", "x", 5, points_per_cell=10, block_rows=80)
    assert near_lists(got) == brute(rows, 5)
    assert visits[0][0] == 24 and visits[0][1] <= 7
    assert not any({"query", "v"} <= columns for columns in kept)  # no table of routes with their vectors


def test_blocks_grow_with_the_table_as_far_as_a_task_may_hold():
    assert [nn.rows_a_block(n, 64, nn.BLOCK_ROWS) for n in (1_000, 720_000, 10**8)] == [8_000, 45_000, 62_500]
    assert nn.rows_a_block(10**8, 4_000, nn.BLOCK_ROWS) == 1_000 and nn.rows_a_block(10**8, 64, 80) == 80


@pytest.mark.parametrize("kind", ["far", "ties", "odd"])
def test_matrix_products_lose_no_neighbour(kind):
    rng = np.random.default_rng(6)
    points = rng.normal(size=(150, 5)) + (1e5 if kind == "far" else 0)
    if kind == "ties":
        points = np.round(points)
    if kind == "odd":
        points[3, 2], points[9, 0] = np.nan, np.inf
    with np.errstate(invalid="ignore"):
        got = nn._best(np.arange(150), points, np.arange(150), points, 4)
        d = np.round(nn._distances(points, points), nn.DIGITS)
    order = np.lexsort((np.broadcast_to(np.arange(150), d.shape), d), axis=1)[:, :4]
    assert (got["neighbour"].to_numpy().reshape(150, 4) == order).all()
    assert np.array_equal(got["distance"].to_numpy().reshape(150, 4), np.take_along_axis(d, order, 1), equal_nan=True)


def test_small_group_has_fewer_neighbours(spark):
    df = spark.createDataFrame([(1, 0, [0.0]), (2, 0, [1.0]), (3, 1, [5.0])], "id long, g int, x array<double>")
    assert near_lists(nn.nearest_in_group(df, "g", "id", "x", 5)) == {1: [2], 2: [1]}


def test_smote_balances_on_segments(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(i >= 60), [float(v) for v in rng.normal(size=3) + 4 * (i >= 60)]) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, label int, x array<double>")
    out = rs.smote(df, "label", "id").collect()
    assert Counter(r["label"] for r in out) == {0: 60, 1: 60}
    x = {i: np.array(v) for i, _, v in rows}
    made = [r for r in out if r["copy_no"] > 0]
    assert len(made) == 40
    for r in made:
        want = x[r["id"]] + r["gap"] * (x[r["neighbour"]] - x[r["id"]])
        assert np.allclose(r["x"], want) and 0 <= r["gap"] < 1 and r["id"] != r["neighbour"]


def test_null_treatment_augment_keeps_types(spark):
    df = spark.createDataFrame([("a", 1.0, 1)], "k string, CBZ double, label int")
    out = rs.null_treatment_augment(df, ["CBZ"], "label")
    assert out.schema == df.schema and sorted(map(tuple, out.collect())) == [("a", 0.0, 0), ("a", 1.0, 1)]


def test_vote_ties_go_to_the_lower_label(spark):
    pairs = spark.createDataFrame([(1, 10), (1, 11)], "id long, neighbour long")
    labels = spark.createDataFrame([(10, 4), (11, 2)], "id long, label int")
    r = nn.vote(pairs, labels, "id", "label").first()
    assert (r["predicted"], r["votes"]) == (2, 1)


@pytest.mark.parametrize("kind", ["uniform", "copies"])
def test_unseen_rows_find_their_neighbours_in_the_other_table(spark, kind):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 4))
    if kind == "copies":
        x[::3] = 1.0  # a third of both tables is one vector
    train = [(i, x[i].tolist()) for i in range(200)]
    # ids overlap with those of the training table, and a null vector takes no part
    asked = [(i - 150, x[i].tolist()) for i in range(200, 300)]
    schema = "id long, x array<double>"
    got = nn.nearest_across(spark.createDataFrame([*asked, (999, None)], schema),
                            spark.createDataFrame([*train, (999, None)], schema), "id", "x", 5,
                            points_per_cell=15, block_rows=8)
    want = {}
    for i, v in asked:
        d = sorted((round(float(np.sqrt(((np.array(v) - np.array(y)) ** 2).sum())), 9), j) for j, y in train)
        want[i] = [j for _, j in d[:5]]
    assert near_lists(got) == want


def test_unseen_rows_with_few_or_no_points(spark):
    schema = "id long, x array<double>"
    asked = spark.createDataFrame([(1, [0.0]), (2, [9.0])], schema)
    points = spark.createDataFrame([(1, [1.0]), (7, [8.0])], schema)
    assert near_lists(nn.nearest_across(asked, points, "id", "x", 5)) == {1: [1, 7], 2: [7, 1]}
    assert nn.nearest_across(asked, points.limit(0), "id", "x", 5).count() == 0
    assert nn.nearest_across(asked.limit(0), points, "id", "x", 5).count() == 0


def clumps(spark, seed=4):
    """Class 0 around the origin, a smaller class 1 that overlaps its edge, keys from 0."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(size=(120, 3)), rng.normal(size=(40, 3)) + [1.5, 0, 0]])
    return spark.createDataFrame([(i, int(i >= 120), v.tolist()) for i, v in enumerate(x)], "id long, g int, x array<double>")


def made_of(df):
    return [r for r in df.collect() if r["copy_no"] > 0]


def on_line(row, points, low, high):
    """Whether the made row is seed + t (neighbour - seed) with low <= t <= high."""
    a, b = np.array(points[row["id"]]), np.array(points[row["neighbour"]])
    t = float(np.dot(np.array(row["x"]) - a, b - a) / np.dot(b - a, b - a))
    return np.allclose(a + t * (b - a), row["x"]) and low - 1e-9 <= t <= high + 1e-9


def test_variants_balance_the_class_and_stay_on_their_lines(spark):
    df = clumps(spark)
    points = {r["id"]: r["x"] for r in df.collect()}
    seeds = {r["id"]: r["danger"] for r in rs.borderline_seeds(df, "g", "id", 1).collect()}
    made = made_of(rs.borderline_smote(df, "g", "id", 1))
    assert len(made) == 80 and all(r["g"] == 1 and r["neighbour"] >= 120 and on_line(r, points, 0, 1) for r in made)
    assert {r["id"] for r in made} <= {i for i, danger in seeds.items() if danger}
    want = {r["id"]: r["n_synthetic"] for r in rs.adaptive_allocation(df, "g", "id", 1).collect() if r["n_synthetic"]}
    made = made_of(rs.adasyn(df, "g", "id", 1))
    assert Counter(r["id"] for r in made) == want and all(on_line(r, points, 0, 1) for r in made)
    assert sorted((r["id"], r["copy_no"]) for r in made) == sorted((i, c + 1) for i, n in want.items() for c in range(n))


def test_margin_seeds_extrapolate_among_their_own(spark):
    df = clumps(spark)
    points = {r["id"]: r["x"] for r in df.collect()}
    scored = rs.svm_margins(df, "g", 1)
    margin = {r["id"]: r["margin"] for r in scored.collect()}
    assert np.mean([margin[i] > 0 for i in range(120, 160)]) > 0.3 > np.mean([margin[i] > 0 for i in range(120)])
    step = {r["id"]: r["step"] for r in rs.margin_seeds(scored, "g", "id", 1, "margin").collect()}
    assert step and all(i >= 120 and margin[i] <= 1 for i in step) and set(step.values()) == {1.0, -0.5}
    made = made_of(rs.svm_smote(df, "g", "id", 1))
    assert len(made) == 80 and {r["id"] for r in made} <= set(step)
    assert all(on_line(r, points, *((0, 1) if step[r["id"]] > 0 else (-0.5, 0))) for r in made)


def test_cells_get_rows_by_sparsity(spark):
    df = clumps(spark).withColumn("cell", (F.col("id") % 3).cast("int"))
    x = {r["id"]: (r["g"], r["cell"], np.array(r["x"])) for r in df.collect()}
    got = {r["cell"]: r for r in rs.cell_allocation(df, "g", 1, "cell", min_share=0.0).collect()}
    sparsity = {}
    for c in range(3):
        own = [v for g, cell, v in x.values() if g and cell == c]
        pairs = [((a - b) ** 2).sum() for i, a in enumerate(own) for b in own[:i]]
        sparsity[c] = np.mean(pairs) / len(own)
        assert got[c]["sparsity"] == pytest.approx(sparsity[c]) and got[c]["minority_rows"] == len(own)
    for c in range(3):
        assert got[c]["n_synthetic"] == round(80 * sparsity[c] / sum(sparsity.values()))
    made = made_of(rs.kmeans_smote(df, "g", "id", 1, cell="cell", min_share=0.0))
    assert Counter(x[r["id"]][1] for r in made) == {c: r["n_synthetic"] for c, r in got.items()}
    assert all(x[r["id"]][1] == x[r["neighbour"]][1] for r in made)
    fitted = made_of(rs.kmeans_smote(df, "g", "id", 1, cells=3))
    assert abs(len(fitted) - 80) <= 3


def test_variants_without_seeds_make_no_rows(spark):
    rows = [(i, 0, [float(i)]) for i in range(20)] + [(100, 1, [500.0])]
    df = spark.createDataFrame(rows, "id long, g int, x array<double>")
    for made in (rs.borderline_smote(df, "g", "id", 1), rs.adasyn(df, "g", "id", 1), rs.kmeans_smote(df, "g", "id", 1, cells=2),
                 rs.borderline_smote(df, "g", "id", 7)):
        assert made.count() == 21
