import os
import threading

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from cohortis.functions import arrays as A
from cohortis.functions import dense as D
from cohortis.models import attention as at
from cohortis.models import classifiers as cl
from cohortis.models import encoders as en
from cohortis.models import ensembles as en_ens
from cohortis.models import grids as G
from cohortis.models import tuning as tn
from cohortis.models.discriminant import LinearDiscriminant
from cohortis.operators import evaluate as ev
from cohortis.operators import interact as it
from cohortis.operators import split as sp
from cohortis.plans import cleaning, modelling
from cohortis.session import ensure_checkpoint_dir, spread


@pytest.fixture(scope="module")
def blobs(spark):
    """Two separable classes with a key, a vector and folds."""
    rng = np.random.default_rng(0)
    rows = [(i, i % 2, [float(v) for v in rng.normal(size=4) + 1.5 * (i % 2)]) for i in range(300)]
    df = spark.createDataFrame([(i, float(y), Vectors.dense(x), x) for i, y, x in rows], ["id", "label", "features", "x"])
    return sp.stratified_folds(df, "label", "id", 3).persist()


def auc(scored):
    return ev.auc_rank(scored.withColumn("model", F.lit("m")), ["model"]).first()["auc"]


@pytest.mark.parametrize("sub_sample", [True, False])
@pytest.mark.parametrize("causal", [True, False])
def test_attention_block_shapes(spark, sub_sample, causal):
    df = spark.createDataFrame([([0.0] * 20,), ([0.0] * 20,)], "x array<double>")
    m = df.select(it.attention_map(F.col("x"), it.Projections(), sub_sample, causal and not sub_sample)).first()[0]
    assert len(m) == 20 and {len(row) for row in m} == {10 if sub_sample else 20}
    assert all(sum(row) == pytest.approx(1.0) for row in m)
    z = df.select(it.attention_output(F.col("x"), it.Projections(), sub_sample)).first()[0]
    assert z == [0.0] * 20


def test_maps_leave_a_task_in_pieces(spark):
    x = np.random.default_rng(2).normal(size=(3000, 64))
    maps = D.vector_function(lambda m: D.softmax_maps(m, m), "array<array<double>>")
    pieces = list(maps.func(iter([D.lists(x), D.lists(x[:0]), D.lists(x[:5])])))
    assert sum(map(len, pieces)) == 3005 and max(map(len, pieces)) * 64 * 64 <= D.MAP_VALUES
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:600])], "id long, x array<double>").coalesce(1)
    both = df.select("id", it.interaction_map(F.col("x")).alias("a"), it.interaction_map(F.col("x"), causal=True).alias("b"))
    for row in both.where("id % 100 = 99").collect():
        v = x[row["id"]][None]
        assert np.allclose(row["a"], D.softmax_maps(v, v)[0]) and np.allclose(row["b"], D.softmax_maps(v, v, True)[0])


def test_maps_are_stable_for_large_values(spark):
    df = spark.createDataFrame([([1000.0, -1000.0, 3.0],)], "x array<double>")
    m = df.select(it.interaction_map(F.col("x"))).first()[0]
    assert np.isfinite(m).all()
    assert df.select(A.softmax("x")).first()[0] == [1.0, 0.0, 0.0]


def test_mean_table_with_names_and_first_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 0.0])], "id long, x array<double>")
    got = {(r[0], r[1]): r[2] for r in it.mean_attention_table(df, "x", names=["a", "b"]).collect()}
    maps = D.softmax_maps(np.array([[1.0, 2.0], [0.0, 0.0]]), np.array([[1.0, 2.0], [0.0, 0.0]]))
    assert got == pytest.approx({(n, m): maps.mean(0)[i, j] for i, n in enumerate("ab") for j, m in enumerate("ab")})
    first = {(r[0], r[1]): r[2] for r in it.mean_attention_table(df, "x", first=1, key="id").collect()}
    assert first == pytest.approx({(i, j): maps[0][i, j] for i in range(2) for j in range(2)})


def test_vectors_must_be_present(spark):
    df = spark.createDataFrame([(None,), ([1.0],)], "x array<double>").coalesce(1)
    with pytest.raises(Exception, match="must not be null"):
        df.select(it.outer_attention(F.col("x"))).collect()


def test_attention_pipeline_learns_and_scores_the_same_after_reload(blobs, tmp_path):
    train, held_out = blobs.where("fold <> 0"), blobs.where("fold = 0")
    model, history = at.AttentionClassifier(hidden=8, iterations=30, draws=(1, 2)).fit(train, held_out)
    scored = cl.positive_score(model, held_out)
    assert auc(scored) > 0.85 and auc(scored) == pytest.approx(max(h["auc"] for h in history)) and len(history) == 2
    model.save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    want, got = ({r["id"]: r["score"] for r in cl.positive_score(m, held_out).collect()} for m in (model, again))
    assert got == want and again.stages[0].projections == model.stages[0].projections


def test_attention_stage_equals_the_column_function(blobs):
    p = at.drawn_projections(3)
    stage = at.AttentionOutput(projections=p, subSample=True)
    got = stage.transform(blobs).select(vector_to_array("attended"), it.attention_output(F.col("x"), p, True)).collect()
    assert all(list(a) == pytest.approx(list(b)) for a, b in got)


# ---- fitted encoders

@pytest.fixture(scope="module")
def cohorts(spark):
    train = spark.createDataFrame(
        [("A", 10, 1.0, "x"), ("B", 2, 3.0, "x"), (None, 2, None, "x"), ("B", 30, 5.0, "x")], "c string, k int, v double, w string")
    other = spark.createDataFrame(
        [("A", 2, 7.0, "y"), ("Z", 99, 1.0, "y"), (None, None, None, None)], "c string, k int, v double, w string")
    return train, other


def reloaded(model, path):
    model.write().overwrite().save(str(path))
    return type(model).load(str(path))


def test_one_hot_model_keeps_the_training_categories(cohorts, tmp_path):
    train, other = cohorts
    model = reloaded(en.OneHotColumns(["c", "k"]).fit(train), tmp_path / "m")
    got = model.transform(other)
    assert got.columns == ["v", "w", "c_A", "c_B", "k_2", "k_10", "k_30"]
    assert [tuple(r)[2:] for r in got.collect()] == [(1, 0, 1, 0, 0), (0, 0, 0, 0, 0), (0, 0, 0, 0, 0)]
    assert en.OneHotColumns(["c", "w"], dropFirst=True).fit(train).transform(other).columns == ["k", "v", "c_B"]


def test_one_hot_refuses_too_many_categories(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError, match="more than 10"):
        en.OneHotColumns(["c"], maxCategories=10).fit(df)
    assert len(en.OneHotColumns(["c"], maxCategories=50).fit(df).transform(df).columns) == 50


def test_scalers_use_the_training_numbers(cohorts, tmp_path):
    train, other = cohorts
    for stage, want in ((en.MinMaxColumns(["v"]), [1.5, 0.0, None]),
                        (en.ZScoreColumns(["v"]), [4 / np.sqrt(8 / 3), -2 / np.sqrt(8 / 3), None])):
        got = [r["v"] for r in reloaded(stage.fit(train), tmp_path / type(stage).__name__).transform(other).collect()]
        assert got == [pytest.approx(w) if w is not None else None for w in want]


@pytest.mark.parametrize("stage", [en.MinMaxColumns, en.ZScoreColumns])
def test_scalers_of_constant_and_absent_columns_give_null(cohorts, stage, tmp_path):
    train, other = cohorts
    for frame in (train.withColumn("v", F.lit(2.0)), train.withColumn("v", F.lit(None).cast("double")), train.limit(0)):
        model = reloaded(stage(["v"]).fit(frame), tmp_path / "m")
        assert [r["v"] for r in model.transform(other).collect()] == [None] * 3


def test_encoders_in_a_saved_pipeline(cohorts, tmp_path):
    train, other = cohorts
    fitted = Pipeline(stages=[en.OneHotColumns(["c"]), en.MinMaxColumns(["v", "k"])]).fit(train)
    assert reloaded(fitted, tmp_path / "p").transform(other).collect() == fitted.transform(other).collect()


# ---- long ensembles

def scores(df, name="score"):
    return {r["id"]: r[name] for r in df.collect()}


def test_walked_trees_equal_the_library(blobs):
    model = G.boosted(maxIter=6, maxDepth=4, stepSize=0.3).fit(blobs)
    got, want = scores(en_ens.Ensemble.of(model).score(blobs)), scores(cl.positive_score(model, blobs))
    assert got == pytest.approx(want, abs=1e-12)


def test_staged_scores_equal_separate_fits(blobs):
    rounds = [1, 4]
    gbt = {"stepSize": 0.3, "maxDepth": 3, "subsamplingRate": 0.7, "featureSubsetStrategy": "0.5"}
    fit = en_ens.boosted_fit(G.boosted())
    staged = en_ens.Ensemble.of(fit(blobs, gbt, 4)).staged_scores(blobs, rounds)
    ada = cl.AdaBoost(rounds=4, max_depth=2).fit(blobs)
    ada_staged = en_ens.Ensemble.of(ada).staged_scores(blobs, rounds)
    for n in rounds:
        assert scores(staged.where(F.col("n_rounds") == n)) == pytest.approx(
            scores(cl.positive_score(fit(blobs, gbt, n), blobs)), abs=1e-12)
        part = cl.AdaBoost(rounds=n, max_depth=2).fit(blobs)
        chain = blobs
        for i, t in enumerate(part.trees):
            chain = t.copy({t.predictionCol: f"p{i}", t.rawPredictionCol: "", t.probabilityCol: ""}).transform(chain)
        vote = sum(F.lit(a / sum(part.alphas)) * (2 * F.col(f"p{i}") - 1) for i, a in enumerate(part.alphas))
        want = scores(chain.withColumn("score", 1 / (1 + F.exp(-vote))))
        assert scores(ada_staged.where(F.col("n_rounds") == n)) == pytest.approx(want, abs=1e-12)
        assert scores(part.score(blobs)) == pytest.approx(want, abs=1e-12)


def test_trees_are_walked_in_batches(blobs):
    model = G.boosted(maxIter=5, maxDepth=6, stepSize=0.3).fit(blobs)
    gap = blobs.withColumn("features", array_to_vector(F.transform(
        "x", lambda v, i: F.when(i == F.col("id") % 5, float("nan")).otherwise(v))))
    frame = en_ens.Ensemble.of(model).score(gap)
    assert scores(frame) == pytest.approx(scores(cl.positive_score(model, gap)), abs=1e-12)
    assert scores(en_ens.Ensemble.of(model).score(gap.limit(0))) == {}
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "aggregate(" not in plan and "from_json" not in plan


def test_two_thousand_trees_have_a_plan_of_constant_depth(blobs):
    trees = G.boosted(maxIter=4, maxDepth=3).fit(blobs)
    nodes = [en_ens.tree_nodes(t) for t in trees.trees]
    long = en_ens.Ensemble([nodes[i % 4] for i in range(2000)], [1.0 / (i + 1) for i in range(2000)])

    def plan(e):
        return e.score(blobs.select("id", "features"))._jdf.queryExecution().optimizedPlan().toString().split("\n")

    assert len(plan(long)) == len(plan(en_ens.Ensemble(nodes, [1.0] * 4)))
    leaves = {(r["id"], i): r["prediction"] for i, t in enumerate(trees.trees) for r in t.transform(blobs).collect()}
    weight = [sum(1.0 / (i + 1) for i in range(j, 2000, 4)) for j in range(4)]
    for i, score in list(scores(long.score(blobs)).items())[:50]:
        margin = sum(w * leaves[i, j] for j, w in enumerate(weight))
        assert score == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-9)


def test_staged_rounds_beyond_an_early_end(blobs):
    pure = blobs.where("label = 1")
    model = cl.AdaBoost(rounds=3).fit(pure)
    got = en_ens.Ensemble.of(model).staged_scores(pure.select("id", "features"), [1, 5])
    assert got.groupBy("n_rounds").count().count() == 2 and got.select("score").distinct().count() == 1


def test_staged_grid_search(blobs):
    table = en_ens.staged_grid_search(blobs, en_ens.boosted_fit(G.boosted()), [{"maxDepth": 1}, {"maxDepth": 3}], [1, 4], folds=2)
    assert table.count() == 2 * 2 * 2 and table.where("score < 0.6 or score > 1").count() == 0
    best = tn.select_best(table, ["candidate", "n_rounds"]).first()
    assert best["n_rounds"] in (1, 4)


class Counted:
    """An estimator that notes how many fits run at once, and on how many rows."""

    def __init__(self, base):
        self.base, self.fits, self.running, self.most = base, [], 0, 0
        self.lock = threading.Lock()

    def getParam(self, name):
        return self.base.getParam(name)

    def fit(self, df, params):
        with self.lock:
            self.running += 1
            self.most = max(self.most, self.running)
            self.fits.append(df.count())
        model = self.base.fit(df, params)
        with self.lock:
            self.running -= 1
        return model


def test_large_tables_are_fitted_one_candidate_at_a_time(blobs, monkeypatch):
    assert [tn.fits_at_once(n, 9, 4) for n in (0, 10, 1_500_000, 3_000_000, 10**9)] == [4, 4, 2, 1, 1]
    settings = [{"maxDepth": d} for d in (1, 2, 3)]
    whole = tn.grid_search(blobs, G.forest(numTrees=2), settings, folds=2)[1]
    monkeypatch.setattr(tn, "ROWS_SIDE_BY_SIDE", 100)
    counted = Counted(G.forest(numTrees=2))
    one = tn.grid_search(blobs, counted, settings, folds=2)[1]
    assert counted.most == 1 and len(counted.fits) == 7 and counted.fits[-1] == 300
    assert one.collect() == whole.collect()


def test_cross_validation_fits_each_family_once_a_fold(blobs):
    families = {"a": Counted(G.forest(numTrees=2)), "b": Counted(G.logistic())}
    table = tn.cross_validate(blobs, families, folds=3)
    assert table.columns == ["model", "fold", "score"] and table.count() == 6
    assert all(len(c.fits) == 3 and max(c.fits) < 300 for c in families.values())


def test_grid_search_picks_the_best_mean(blobs):
    settings = [{"maxDepth": 0}, {"maxDepth": 3}]
    model, table = tn.grid_search(blobs, G.forest(numTrees=5), settings, folds=3)
    assert table.count() == 6 and tn.select_best(table).first()["candidate"] == 1
    assert auc(cl.positive_score(model, blobs)) > 0.9


def test_balanced_accuracy(spark):
    df = spark.createDataFrame([(1.0, 1.0)] * 8 + [(0.0, 1.0)] * 1 + [(0.0, 0.0)] * 1, "label double, prediction double")
    assert tn.BalancedAccuracyEvaluator().evaluate(df) == pytest.approx(0.75)


def test_bake_off_of_estimators(blobs):
    table = tn.cross_validate(blobs, {"lg": G.logistic(), "bag": G.bagged_trees(maxDepth=2)}, folds=3)
    assert table.count() == 6 and [r["place"] for r in tn.bake_off(table).orderBy("place").collect()] == [1, 2]


def test_grids_are_clamped_and_distinct():
    assert {s["stepSize"] for s in G.boosted_settings()} == {1.0, 0.2} and len(G.boosted_settings()) == 8
    wide = G.forest_settings(G.FOREST_WIDE_GRID)
    assert max(s["maxDepth"] for s in wide) == 30 and len(wide) == len({str(s) for s in wide}) == 640
    assert len(G.linear_svm_settings(100)) == 3 and len(G.logistic_settings(100)) == 7
    assert G.logistic_settings(100)[3] == {"regParam": 0.01} and len(G.mlp_settings(29)) == 20
    assert len(G.boosted_settings(G.BOOSTED_WIDE_GRID)) == 720


class Fitted(Exception):
    pass


@pytest.fixture
def asked(blobs, monkeypatch):
    """The estimators that registered fits begin to fit, the settings of grids and the numbers of folds."""
    seen = {"fits": [], "folds": [], "settings": []}

    def fit(estimator, df, params=None):
        seen["fits"].append(estimator)
        raise Fitted

    def grid_search(df, estimator, settings, folds):
        seen["settings"] = settings
        seen["folds"].append(folds)
        fit(estimator, df)

    def study(spark, sf, folds=modelling.FOLDS):
        seen["folds"].append(folds)
        # as many numbers a row as the study's
        wide = F.array_repeat(F.col("x")[0], len(modelling.P.CONTINUOUS.features))
        return blobs.select("id", "label", "fold", array_to_vector(wide).alias("features"), F.lit("train").alias("split"))

    monkeypatch.setattr(modelling, "study", study)
    monkeypatch.setattr(modelling.tn, "grid_search", grid_search)
    for kind in (G.LinearSVC, G.MultilayerPerceptronClassifier):
        monkeypatch.setattr(kind, "fit", fit)
    return seen


def test_fit_mlp_makes_all_passes_of_the_study(spark, asked):
    with pytest.raises(Fitted):
        modelling.fit_mlp(spark, "")
    assert asked["fits"][0].getMaxIter() == 200 and asked["fits"][0].getLayers()[1:] == [200, 200, 2]


def test_grid_mlp_has_the_studys_candidates(spark, asked):
    with pytest.raises(Fitted):
        modelling.grid_mlp(spark, "")
    assert asked["settings"] == G.mlp_settings(len(modelling.P.CONTINUOUS.features)) and asked["folds"] == [5, 5]
    assert {s["maxIter"] for s in asked["settings"]} == {2000, 10000} and len(asked["settings"]) == 20


def test_grid_linear_svm_fits_every_candidate_to_convergence(spark, asked):
    with pytest.raises(Fitted):
        modelling.grid_linear_svm(spark, "")
    assert asked["fits"][0].getMaxIter() == G.UNTIL_CONVERGED
    assert asked["folds"] == [5, 5] and asked["settings"] == G.linear_svm_settings(240)


def test_fit_rbf_svm_fits_to_convergence(spark, asked):
    with pytest.raises(Fitted):
        modelling.fit_rbf_svm(spark, "")
    assert asked["fits"][0].getMaxIter() == G.UNTIL_CONVERGED and asked["folds"] == [5]


def test_fit_rbf_svm_writes_no_wide_rows(spark, asked, monkeypatch):
    written = []
    monkeypatch.setattr(modelling, "reliable_checkpoint", lambda df: written.append(df.columns) or df)
    with pytest.raises(Fitted):
        modelling.fit_rbf_svm(spark, "")
    assert written == []


def test_linear_svm_ends_by_its_tolerance(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 6)) * [1, 3, 10, 30, 0.1, 0.01]
    y = (x[:, 0] + x[:, 1] / 3 + x[:, 5] * 100 + rng.normal(size=400) > 0).astype(float)
    df = spark.createDataFrame([(float(b), Vectors.dense(a)) for a, b in zip(x, y)], ["label", "features"]).coalesce(1).persist()
    short, whole = G.linear_svm(maxIter=20, regParam=1e-4).fit(df).summary(), G.linear_svm(regParam=1e-4).fit(df).summary()
    assert short.totalIterations == 20 < whole.totalIterations < 2000
    assert whole.objectiveHistory[-1] < short.objectiveHistory[-1]


def test_platt_scores_are_monotone_in_the_margin(blobs):
    model = cl.platt(blobs, G.linear_svm(maxIter=10), folds=3)
    scored = model.score(blobs)
    assert model.slope > 0 and auc(scored) > 0.9
    assert scored.agg(F.min("score"), F.max("score")).where("`min(score)` > 0 and `max(score)` < 1").count() == 1


def test_platt_keeps_margins_and_no_wide_rows(blobs, monkeypatch):
    seen = []

    class Fits:
        def fit(self, df):
            seen.append((df.count(), df.storageLevel.useMemory))
            return G.linear_svm(maxIter=5).fit(df)

    plans = []

    class Line(cl.LogisticRegression):
        def fit(self, df):
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
            return super().fit(df)

    monkeypatch.setattr(cl, "LogisticRegression", Line)
    model = cl.platt(blobs, Fits(), folds=3)
    assert not any(kept for _, kept in seen[:3]) and max(n for n, _ in seen[:3]) < 300 and seen[3][0] == 300
    assert "InMemoryRelation [label" in plans[0] and "features" not in plans[0].split("InMemoryRelation")[1].split("]")[0]
    assert model.slope > 0


def test_fourier_features_approach_the_kernel(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6, 3))
    df = spark.createDataFrame([([float(v) for v in r],) for r in x], "x array<double>")
    w, b = cl.fourier_frequencies(3, 4000, 0.3)
    z = np.array([r[0] for r in df.select(cl.fourier_features(F.col("x"), w, b)).collect()])
    kernel = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(2))
    assert np.abs(sorted((z @ z.T).ravel()) - np.array(sorted(kernel.ravel()))).max() < 0.08
    assert cl.scale_gamma(df, "x") == pytest.approx(1 / (3 * x.var()))


def test_adaboost(blobs):
    model = cl.AdaBoost(rounds=5, max_depth=1, checkpoint_every=2).fit(blobs)
    assert 1 <= len(model.trees) <= 5 and auc(model.score(blobs)) > 0.85
    assert len(cl.AdaBoost(rounds=3).fit(blobs.where("label = 1")).trees) == 1


def test_adaboost_over_forests(blobs):
    model = cl.AdaBoost(rounds=2, base=G.forest(numTrees=2, maxDepth=1)).fit(blobs)
    assert auc(model.score(blobs)) > 0.8


def test_samme_weights_sum_to_one(blobs):
    df = blobs.select("id", "label", F.when(F.col("id") % 5 == 0, 1 - F.col("label")).otherwise(F.col("label")).alias("p"),
                      F.lit(0.5).alias("w"))
    row = cl.samme_weights(df, "label", "p", "w").agg(F.sum("new_weight"), F.max("alpha")).first()
    assert row[0] == pytest.approx(1.0) and row[1] == pytest.approx(np.log(4.0))


def test_soft_vote_lies_between_its_members(blobs):
    members = {"lg": G.logistic().fit(blobs), "rf": G.forest(numTrees=3, maxDepth=3).fit(blobs),
               "ada": cl.AdaBoost(rounds=2).fit(blobs)}
    out = cl.vote_models(blobs, members)
    names = [f"p_{m}" for m in members]
    outside = (F.col("score") < F.least(*names) - 1e-12) | (F.col("score") > F.greatest(*names) + 1e-12)
    assert out.where(outside).count() == 0


def test_hard_vote_needs_more_than_half(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.1), (2, 0.9), (2, 0.8), (2, 0.2)], "k int, score double")
    assert {r["k"]: r["vote"] for r in cl.hard_vote(df, ["k"]).collect()} == {1: 0, 2: 1}


def test_scoring_costs_count_rows_in_the_scoring_job(blobs):
    got = {r["model"]: r for r in cl.scoring_costs(blobs, {"lg": G.logistic().fit(blobs), "lda": LinearDiscriminant().fit(blobs)}).collect()}
    assert set(got) == {"lg", "lda"} and all(r["rows"] == 300 and r["seconds_per_row"] > 0 for r in got.values())


def test_discriminant_equals_the_closed_form(blobs, tmp_path):
    rows = blobs.collect()
    x, y = np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows])
    means = [x[y == c].mean(0) for c in (0, 1)]
    pooled = sum(((x[y == c] - means[c]).T @ (x[y == c] - means[c]) for c in (0, 1))) / len(x)
    slopes = np.linalg.solve(pooled, means[1] - means[0])
    model = LinearDiscriminant().fit(blobs.repartition(5))
    assert model.getOrDefault("coefficients") == pytest.approx(slopes.tolist())
    assert model.getOrDefault("intercept") == pytest.approx(-0.5 * (means[0] + means[1]) @ slopes)
    again = reloaded(model, tmp_path / "lda")
    got = scores(cl.positive_score(again, blobs))
    margin = x @ slopes + model.getOrDefault("intercept")
    assert got == pytest.approx({r["id"]: 1 / (1 + np.exp(-m)) for r, m in zip(rows, margin)})
    assert auc(cl.positive_score(model, blobs)) > 0.9


def test_discriminant_of_constant_features_and_one_class(blobs):
    flat = blobs.withColumn("features", array_to_vector(F.concat("x", F.array(F.lit(3.0)), "x")))
    assert auc(cl.positive_score(LinearDiscriminant().fit(flat), flat)) > 0.9
    with pytest.raises(ValueError, match="classes"):
        LinearDiscriminant().fit(blobs.where("label = 1"))


def test_only_one_cohort_of_the_partitioned_table_is_read(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("test tables not present")
    plan = cleaning.partitioned_model_table(spark, sf)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cohort" in plan and "(cohort" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_checkpoints_go_to_one_folder(spark):
    assert ensure_checkpoint_dir(spark) == ensure_checkpoint_dir(spark)


def test_spread_fills_the_cores_evenly(spark):
    cores = spark.sparkContext.defaultParallelism
    few = 400 * cores
    uneven = spark.range(few, numPartitions=cores).union(spark.range(few, few + 8, numPartitions=1))
    assert uneven.rdd.getNumPartitions() == cores + 1
    even = spread(uneven, "id", cores + 1)
    sizes = [r["count"] for r in even.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == even.rdd.getNumPartitions() == 2 * cores and max(sizes) < 1.5 * min(sizes)
    assert sorted(r.id for r in even.collect()) == list(range(few + 8))
    assert spread(uneven, "id", 1).rdd.getNumPartitions() == cores
    assert spread(uneven, "id", 100 * cores).rdd.getNumPartitions() == cores + 1
