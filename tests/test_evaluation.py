import random

import pytest
from pyspark.sql import functions as F

from cohortis.operators import bootstrap as bs
from cohortis.operators import evaluate as ev
from cohortis.operators.ranking import running_totals


def predictions(spark, n=400, seed=1, ties=50):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        label = int(rng.random() < 0.4)
        rows.append(("m", "ab"[i % 2], i, label, min(1.0, rng.randrange(ties) / ties + 0.2 * label)))
    return spark.createDataFrame(rows, "model string, cohort string, row_id long, label int, score double")


def brute_auc(rows):
    pos = [r["score"] for r in rows if r["label"] == 1]
    neg = [r["score"] for r in rows if r["label"] == 0]
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


def test_auc_three_ways(spark):
    df = predictions(spark)
    want = {c: brute_auc([r for r in df.collect() if r["cohort"] == c]) for c in "ab"}
    for fn in (ev.auc_rank, ev.auc_trapezoid, ev.external_validation):
        assert {r["cohort"]: r["auc"] for r in fn(df).collect()} == pytest.approx(want)


def test_bucketed_running_totals_equal_plain(spark):
    cells = ev.score_cells(predictions(spark, 2000, ties=500))
    for down in (True, False):
        args = (["model", "cohort"], "score", ["pos", "neg"], down)
        plain = sorted(map(tuple, running_totals(cells, *args).collect()))
        cut = running_totals(cells, *args, cells_per_task=20)
        assert cut.columns == running_totals(cells, *args).columns
        assert sorted(map(tuple, cut.collect()), key=str) == sorted(plain, key=str)


def test_roc_in_buckets_equals_plain(spark):
    df = predictions(spark, 1500, ties=300)
    rows = lambda d: sorted((r["cohort"], r["threshold"], round(r["fpr"], 12), round(r["tpr"], 12)) for r in d.collect())
    assert rows(ev.roc_curve(df)) == rows(ev.roc_curve(df, cells_per_task=15))
    full = rows(ev.roc_curve(df, drop_collinear=False))
    assert set(rows(ev.roc_curve(df))) <= set(full) and len(full) > len(rows(ev.roc_curve(df)))


def test_hot_score_is_one_cell(spark):
    """A third of all rows on one score: the ordered work sees one row for them."""
    df = predictions(spark, 600).withColumn("score", F.when(F.col("row_id") % 3 == 0, 0.5).otherwise(F.col("score")))
    cells = ev.score_cells(df)
    assert cells.where("score = 0.5").count() == 2
    want = {c: brute_auc([r for r in df.collect() if r["cohort"] == c]) for c in "ab"}
    got = ev.auc_rank(df, cells_per_task=7)
    assert {r["cohort"]: r["auc"] for r in got.collect()} == pytest.approx(want)


def test_threshold_edges(spark):
    df = spark.createDataFrame([("m", "a", 1, 0.5), ("m", "a", 0, 0.0), ("m", "b", 1, 1.0)],
                               "model string, cohort string, label int, score double")
    sweep = {(r["cohort"], round(r["threshold"], 2)): r for r in ev.threshold_sweep(df).collect()}
    assert len(sweep) == 42
    zero = sweep["a", 0.0]
    assert (zero["tp"], zero["fp"], zero["fn"], zero["tn"]) == (1, 1, 0, 0)
    assert sweep["a", 0.5]["tp"] == 1 and sweep["a", 0.55]["tp"] == 0
    assert sweep["b", 0.5]["specificity"] is None and sweep["b", 1.0]["sensitivity"] == 1.0
    best = {r["cohort"]: r["threshold"] for r in ev.best_threshold(ev.threshold_sweep(df)).collect()}
    assert best["a"] == 0.05  # lowest of the tied thresholds
    assert ev.threshold_series(ev.threshold_sweep(df)).count() == 38


def test_one_class_group_has_no_auc(spark):
    df = spark.createDataFrame([("m", "b", 1, 1.0)], "model string, cohort string, label int, score double")
    assert ev.auc_rank(df).first()["auc"] is None and ev.auc_trapezoid(df).first()["auc"] is None
    assert ev.threshold_sweep(df.where("label = 0")).count() == 0


def test_log_loss_floor(spark):
    df = spark.createDataFrame([("m", "a", 1, 0.0), ("m", "a", 0, 0.0)],
                               "model string, cohort string, label int, score double")
    assert ev.log_loss(df).first()["log_loss"] == pytest.approx(50.0)


def test_exact_bootstrap_skips_one_class_and_defaults_precision(spark):
    df = spark.createDataFrame([(i, int(i == 0), 0.1) for i in range(6)], "id long, label int, score double")
    reps = bs.exact_replicates(df, "id", 40, 42, threshold=0.35).collect()
    assert 0 < len(reps) < 40
    assert {r["auc"] for r in reps} == {0.5} and {r["precision"] for r in reps} == {0.0}


def test_poisson_paths_agree_and_ignore_partitioning(spark):
    df = predictions(spark, 500)
    rows = lambda d: sorted((r["cohort"], r["rep"], *[round(r[m], 12) for m in bs.METRICS]) for r in d.collect())
    one = rows(bs.poisson_replicates(df, n_replicates=130))
    assert one == rows(bs.poisson_replicates(df.repartition(16), n_replicates=130))
    assert one == rows(bs.poisson_replicates(df, n_replicates=130, cells_in_task=1))
    assert len(one) == 260


def test_poisson_interval_surrounds_the_auc(spark):
    df = predictions(spark, 3000)
    auc = {r["cohort"]: r["auc"] for r in ev.auc_rank(df).collect()}
    ci = bs.intervals(bs.poisson_replicates(df, n_replicates=300), ["model", "cohort"]).where("metric = 'auc'")
    for r in ci.collect():
        assert r["p05"] < auc[r["cohort"]] < r["p95"] and r["replicates"] == 300
        assert r["mean"] == pytest.approx(auc[r["cohort"]], abs=0.01)


def test_interval_positions(spark):
    df = spark.createDataFrame([(i, *[float(i)] * 5) for i in range(20)], "rep int, " + ", ".join(f"{m} double" for m in bs.METRICS))
    r = bs.intervals(df).where("metric = 'auc'").first()
    assert (r["p05"], r["p95"], r["median"], r["mean"]) == (1.0, 19.0, 9.5, 9.5)
