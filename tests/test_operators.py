import math
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayloom.functions.dist import beta_inc, chi2_upper, f_upper, gamma_upper, norm_cdf, norm_ppf, sample_size, t_two_sided
from assayloom.matrix import array_from_long, long_from_array, long_from_wide, numeric_columns, select_in_order
from assayloom.operators import batch, folds, impute, labels, metrics, missing, neighbours, normalize, ranking, resample, selection, stats
from assayloom.operators.forest import boost, grow_forest, learner


@pytest.fixture(scope="module")
def long(spark):
    rows = [(i, i % 2, f, None if (i + f) % 7 == 0 else float((i * 7 + f * 3) % 11) + (2.0 if f == 0 and i % 2 else 0.0)) for i in range(40) for f in range(5)]
    return spark.createDataFrame(rows, "id long, target int, fi long, value double")


def test_tails_keep_known_identities():
    assert sample_size() == 105 and sample_size(0.1, 0.6, 0.2) == 5 and sample_size(0.2, 0.8, 0.1) == 2
    for t, df in ((0.3, 3), (2.1, 10), (5.0, 40)):
        assert math.isclose(t_two_sided(t, df), f_upper(t * t, 1, df), rel_tol=1e-10)
    assert math.isclose(chi2_upper(3.84, 1), math.erfc(math.sqrt(3.84 / 2)), rel_tol=1e-10)
    assert math.isclose(beta_inc(2, 3, 0.4) + beta_inc(3, 2, 0.6), 1, rel_tol=1e-12)
    assert math.isclose(gamma_upper(1, 2.5), math.exp(-2.5), rel_tol=1e-12)
    x = np.array([-3.0, -0.5, 0.0, 1.7])
    assert np.allclose(norm_ppf(norm_cdf(x)), x)


def test_long_and_wide_are_inverse(spark):
    wide = spark.createDataFrame([("a", 1, 0.5, None), ("b", 0, float("nan"), 2.0)], "patient_id string, target int, p double, q double")
    assert numeric_columns(wide) == ["p", "q"]
    assert select_in_order(wide, ["q", "patient_id"]).columns == ["patient_id", "q"]
    cells = {(r.patient_id, r.feature): r.value for r in long_from_wide(wide, ["p", "q"], ["patient_id"]).collect()}
    assert cells == {("a", "p"): 0.5, ("a", "q"): None, ("b", "p"): None, ("b", "q"): 2.0}


def test_log2_and_top_l_can_be_undone(spark, long):
    positive = long.withColumn("value", F.col("value") + 1)
    back = normalize.log2(positive).withColumn("value", F.pow(F.lit(2.0), F.col("value")))
    a, b = (df.select(F.sum("value"), F.count("value")).first() for df in (positive, back))
    assert math.isclose(a[0], b[0], rel_tol=1e-12) and a[1] == b[1]
    ratio = normalize.top_l(positive).alias("a").join(positive.alias("b"), ["id", "fi"]).select("fi", (F.col("a.value") / F.col("b.value")).alias("r")).groupBy("fi").agg((F.max("r") - F.min("r")).alias("d"))
    assert all(abs(r.d) < 1e-12 for r in ratio.collect())


def test_imputers_fill_gaps_and_nothing_else(spark, long):
    arrays = array_from_long(long, ["id", "target"])
    for method, how in (("mean", {}), ("median", {}), ("mode", {}), ("knn", {"k": 3}), ("knn", {"k": 3, "weights": "distance"}), ("mice", {"rounds": 2}), ("miss_forest", {"rounds": 1, "trees": 3}), ("qrilc", {}), ("minprob", {})):
        done = impute.impute(long, method, **how)
        joined = done.select("id", "fi", F.col("value").alias("new")).join(long, ["id", "fi"])
        assert joined.count() == long.count(), method
        assert joined.filter("value is not null and abs(value - new) > 1e-12").count() == 0, method
        assert joined.filter("new is null").count() == 0, method
    again = impute.qrilc(arrays.repartition(3), ["id", "target"]).orderBy("id").collect()
    assert again == impute.qrilc(arrays, ["id", "target"]).orderBy("id").collect()
    with pytest.raises(ValueError):
        impute.minprob(long, arrays, ["id", "target"], lower=-1.0)
    with pytest.raises(ValueError):
        impute.impute(long, "nothing")


def test_missing_not_at_random_is_found(spark):
    rows = [(i, i % 2, f, None if f == 0 and i % 2 else 1.0 * i) for i in range(60) for f in range(3)]
    found = {r.fi: r.mnar for r in missing.detect_mnar(spark.createDataFrame(rows, "id long, target int, fi long, value double")).collect()}
    assert found == {0: True, 1: False, 2: False}


def test_metrics_of_a_perfect_and_a_constant_score(spark):
    rows = [(g, i, i % 2, float(i % 2) if g == 0 else 0.5) for g in (0, 1) for i in range(20)]
    scored = spark.createDataFrame(rows, "group long, id long, y int, score double")
    points = metrics.roc_points(scored)
    auc = {r.group: r.roc_auc for r in metrics.auc_exact(points).collect()}
    assert auc == {0: 1.0, 1: 0.5}
    assert {r.group: r.auc for r in metrics.grid_summary(metrics.roc_grid(points)).collect()} == {0: pytest.approx(1.0), 1: pytest.approx(0.5)}
    best = {r.group: (r.threshold, r.j) for r in metrics.youden(points).collect()}
    assert best == {0: (1.0, 1.0), 1: (1.5, 0.0)}
    hard = {r.group: r for r in metrics.label_metrics(metrics.confusion(metrics.predict_labels(scored, metrics.youden(points)))).collect()}
    assert hard[0].mcc == 1 and hard[0].average_precision == 1 and hard[1].mcc == 0 and hard[1].sensitivity == 0
    empty = scored.filter("group > 5")
    assert metrics.roc_points(empty).count() == 0 and metrics.youden(metrics.roc_points(empty)).count() == 0


def test_trees_shapley_values_add_up():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((120, 6))
    y = (x[:, 1] + 0.5 * x[:, 4] + 0.1 * rng.standard_normal(120) > 0).astype(int)
    forest = boost(x, y, 30)
    shap = forest.shapley(x[:10])
    mean = sum(forest.scale * t.expected(x[0], frozenset()) for t in forest.trees)
    assert np.allclose(shap.sum(axis=1) + mean, forest.margin(x[:10]))
    assert set(np.argsort(-np.abs(shap).mean(axis=0))[:2]) == {1, 4}
    out = forest.shapley(x[:10], "ejected")
    root = sum(forest.scale * t.value[0] for t in forest.trees)
    assert np.allclose(out.sum(axis=1) + root, forest.margin(x[:10]))
    assert ranking._rank_auc(y, grow_forest(x, y, 30, 3).predict(x)) > 0.9
    assert ranking._rank_auc(y, grow_forest(x, y, 30, 3, balanced=True).predict(x)) > 0.9
    with pytest.raises(NotImplementedError):
        learner("other")


def test_the_shap_report_adds_up_over_the_whole_background(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(x[1] > 0), x.tolist()) for i, x in enumerate(rng.standard_normal((300, 4)))]
    df = spark.createDataFrame(rows, "id long, target int, x array<double>")
    got = ranking.shap_report(df.filter("id < 20"), df, trees=20).groupBy("id").agg(F.sum("shap").alias("s")).collect()
    x, y = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    forest = learner("xgboost")(x, y, trees=20)
    p = forest.predict(x)
    assert len(got) == 20 and all(r.s == pytest.approx(p[r.id] - p.mean(), abs=1e-9) for r in got)

    one = {r.fi: r.shap for r in ranking.shap_report(df.filter("id = 3"), df, model="random_forest", trees=10, depth=4).collect()}
    trees = learner("random_forest")(x, y, trees=10, depth=4)

    def worth(s):
        z = x.copy()
        z[:, s] = x[3, s]
        return trees.predict(z).mean()

    orders = list(permutations(range(4)))
    want = [np.mean([worth(list(o[: o.index(f) + 1])) - worth(list(o[: o.index(f)])) for o in orders]) for f in range(4)]
    assert [one[f] for f in range(4)] == pytest.approx(want, abs=1e-9)


def test_selection_finds_the_feature_that_differs(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 2, f, float(rng.standard_normal() + (3.0 if f == 2 and i % 2 else 0.0))) for i in range(80) for f in range(6)]
    long = spark.createDataFrame(rows, "id long, target int, fi long, value double")
    assert selection.select_features(long, 2, number=2, n_repeats=1).first().fi == 2
    assert stats.t_test(long).orderBy("p_value").first().fi == 2
    assert selection.relief_filter(long, splits=2).orderBy(F.desc("mean")).first().fi == 2
    hits = {r.fi: r.decision for r in selection.boruta(long, trials=15, trees=10).collect()}
    assert hits[2] == "confirmed"
    arrays = array_from_long(long, ["id", "target"])
    assert ranking.ranks(ranking.feature_importance(arrays, "shap", trees=10)).filter("rank = 1").first().fi == 2
    assert ranking.addition_by_performance(arrays, 1, trees=10).first().fi == 2
    assert ranking.permutation_importance(arrays, repeats=2, trees=10).orderBy(F.desc("importance")).first().fi == 2
    scored, kept = ranking.elimination(arrays, most=2, splits=2, trees=10)
    assert kept.filter("rank = 1").first().fi == 2 and scored.count() == 2 * 2 * 24
    with pytest.raises(ValueError):
        ranking.search(arrays, scorers=("other",))


def test_rebalancing_counts(spark):
    rows = [(i, int(i < 12), [float(i % 5), float(i % 3)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, target int, x array<double>")
    counts = lambda d: resample.counts_of(d)
    assert counts(resample.augment(df, "none")) == (28, 12)
    assert counts(resample.augment(df, "smote_balanced")) == (28, 28)
    assert counts(resample.augment(df, "kde_balanced")) == (28, 28)
    assert counts(resample.augment(df, "kde", 0.5, 30)) == (20, 10)
    assert counts(resample.augment(df, "ratio", 0.5)) == (12, 12)
    assert sum(counts(resample.augment(df, "smote_balanced", total=100))) == 100
    assert resample.augment(df, "smote_tomek").count() <= 56 and resample.augment(df, "smote_enn").count() <= 56
    with pytest.raises(ValueError):
        resample.augment(df, "other")


def test_splits_do_not_depend_on_partitions(spark):
    df = spark.range(50).withColumn("target", (F.col("id") % 3 == 0).cast("int"))
    key = ["repeat", "id"]
    a, b = (folds.repeated_stratified_folds(x, 4, 2).orderBy(key).collect() for x in (df, df.repartition(5)))
    assert a == b
    assert folds.shuffle_splits(df, 2).filter("repeat = 0 and test").count() == 15
    assert folds.bootstrap(df, 3).groupBy("boot").agg(F.sum("weight").alias("n")).filter("n <> 50").count() == 0


def test_labels(spark):
    df = spark.createDataFrame([(1, "control"), (2, "control"), (3, "contrl"), (4, "cancer"), (5, "cancer")], "id long, label string")
    assert {r.id: r.label for r in labels.repair_labels(df).collect()}[3] == "control"
    with pytest.raises(ValueError):
        labels.repair_labels(df, metric="other")
    only = spark.createDataFrame([(1, "a"), (2, "b")], "id long, label string")
    assert sorted(labels.repair_labels(only).collect()) == sorted(only.collect())
    cohort = spark.createDataFrame([("p", "Site A"), ("q", None)], "patient_id string, site string")
    rows = spark.createDataFrame([("p", "x", 1.0), ("q", "x", 2.0), ("r", "x", 3.0)], "patient_id string, label string, v double")
    assert {r.patient_id: r.label for r in labels.enrich_labels(rows, cohort, "site").collect()} == {"p": "x @ Site A", "q": "x @ None", "r": "x @ None"}
    with pytest.raises(ValueError, match="ids_in_cohort"):
        labels.check(rows, rows, cohort)


def test_combat_brings_batches_together(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i % 2, f, float(rng.standard_normal() + 4 * (i % 2))) for i in range(60) for f in range(4)]
    df = spark.createDataFrame(rows, "id long, plate long, fi long, value double")
    after = batch.combat(df, "plate").groupBy("fi").agg((F.avg(F.when(F.col("plate") == 0, F.col("value"))) - F.avg(F.when(F.col("plate") == 1, F.col("value")))).alias("d"))
    assert all(abs(r.d) < 0.5 for r in after.collect())


def test_masked_distances():
    a, b = np.array([[1.0, np.nan, 3.0]]), np.array([[2.0, 5.0, 5.0], [np.nan, 1.0, np.nan]])
    d = neighbours.masked_distances(a, b)
    assert math.isclose(d[0, 0], math.sqrt(5 * 3 / 2)) and np.isnan(d[0, 1])


def test_arrays_come_back(spark, long):
    back = long_from_array(array_from_long(long, ["id"]), "x", ["id"])
    both = back.alias("a").join(long.alias("b"), ["id", "fi"])
    assert both.count() == long.count() == back.count()
    assert both.filter(~F.col("a.value").eqNullSafe(F.col("b.value"))).count() == 0
