"""Fits, searches, imputations and draws against direct computation on small matrices."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayloom.matrix import array_from_long, long_from_array
from assayloom.operators import batch, folds, impute, information, metrics, neighbours, normalize, ranking, resample, selection, stats
from assayloom.operators.forest import Shape, boost, grow, grow_forest, learner
from assayloom.operators.grid import folds_of, matrix_of, splits_of
from assayloom.operators.samplers import Genetic, Parzen, crowding, fronts

SMALL = {"trees": 6}


@pytest.fixture(scope="module")
def rows(spark):
    """(id, target, x): the first feature tells the classes apart, the second a little, the others nothing."""
    rng = np.random.default_rng(0)
    out = [(7 * i, i % 2, (rng.standard_normal(5) + np.array([2.0, 0.7, 0, 0, 0]) * (i % 2)).tolist()) for i in range(60)]
    return spark.createDataFrame(out, "id long, target int, x array<double>").cache()


@pytest.fixture(scope="module")
def gaps(spark, rows):
    """The long form with every seventh cell missing."""
    long = long_from_array(rows, "x", ["id", "target"])
    return long.withColumn("value", F.when((F.col("id") + 3 * F.col("fi")) % 13 > 1, F.col("value"))).cache()


def wide(long):
    """Ids and matrix, missing values nan."""
    got = array_from_long(long.select("id", "fi", "value"), ["id"]).orderBy("id").collect()
    return np.array([r.id for r in got]), np.array([[np.nan if v is None else v for v in r.x] for r in got], float)


def numbers(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def same_rows(got, want):
    got, want = sorted(got), sorted(want)
    assert len(got) == len(want) and np.allclose(np.array(got, float), np.array(want, float), atol=1e-9)


def fold_parts(m, f):
    return [(r, p, f[r] == p) for r in range(len(f)) for p in range(f.max() + 1)]


def test_folds_reach_the_workers_as_they_are(rows):
    m = matrix_of(rows)
    f = folds_of(m, rows, 3, 2, 5)
    table = {(r.repeat, r.id): r.fold for r in folds.repeated_stratified_folds(rows.select("id", "target"), 3, 2, 5).collect()}
    assert all(table[r, i] == f[r, k] for r in range(2) for k, i in enumerate(m.ids.tolist()))
    t = splits_of(m, rows, 2, 0.3, 1)
    assert t.sum(axis=1).tolist() == [18, 18]
    with pytest.raises(ValueError, match="cells"):
        matrix_of(rows, most_cells=10)


def test_scores_of_folds(rows):
    m, fit = matrix_of(rows), learner("xgboost")
    want = [(r * 3 + p, i, y, s) for r, p, t in fold_parts(m, folds_of(m, rows, 3, 2, 4)) for i, y, s in zip(m.ids[t], m.y[t], fit(m.x[~t], m.y[~t], seed=4, **SMALL).predict(m.x[t]), strict=True)]
    same_rows(numbers(ranking.cv_scores(rows, k=3, repeats=2, seed=4, **SMALL), "group", "id", "y", "score"), want)


@pytest.mark.parametrize("kind", ["gain", "shap", "eject_shap"])
def test_importances_of_folds(rows, kind):
    m, parts = matrix_of(rows), []
    for _, _, t in fold_parts(m, folds_of(m, rows, 2, 2, 1)):
        forest = learner("xgboost")(m.x[~t], m.y[~t], seed=1, **SMALL)
        game = {"shap": "expected", "eject_shap": "ejected"}.get(kind)
        parts.append(np.abs(forest.shapley(m.x[~t], game)).mean(axis=0) if game else forest.importance(5))
    same_rows(numbers(ranking.feature_importance(rows, kind, k=2, repeats=2, seed=1, **SMALL), "fi", "importance"), enumerate(np.mean(parts, axis=0)))
    with pytest.raises(NotImplementedError):
        ranking.feature_importance(rows, "eject_shap", "random_forest")


def test_permutation_importance(rows):
    m = matrix_of(rows)
    forest, want = learner("random_forest")(m.x, m.y, seed=2, **SMALL), []

    def precision(s):  # over all thresholds, written out
        steps, before = 0.0, 0.0
        for cut in sorted(set(s), reverse=True):
            chosen = s >= cut
            recall = (m.y[chosen] == 1).sum() / (m.y == 1).sum()
            steps, before = steps + (recall - before) * (m.y[chosen] == 1).mean(), recall
        return steps

    for j in range(5):
        rng, drops = np.random.default_rng([2, j]), []
        for _ in range(4):
            z = m.x.copy()
            z[:, j] = rng.permutation(z[:, j])
            drops.append(precision(forest.predict(m.x)) - precision(forest.predict(z)))
        want.append((j, np.mean(drops), np.std(drops)))
    same_rows(numbers(ranking.permutation_importance(rows, "random_forest", 4, 2, **SMALL), "fi", "importance", "std"), want)


def mcc(y, hard):
    tp, tn, fp, fn = (((hard == a) & (y == b)).sum() for a, b in ((1, 1), (0, 0), (1, 0), (0, 1)))
    d = np.sqrt(float(tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return (tp * tn - fp * fn) / d if d else 0.0


def test_addition_by_importance(spark, rows):
    m = matrix_of(rows)
    importance = spark.createDataFrame([(0, 0.5), (3, 0.2), (1, 0.2), (2, 0.1)], "fi long, importance double")
    got = {r.rank: r for r in ranking.addition_by_importance(rows, importance, 3, k=2, repeats=2, seed=1, **SMALL).collect()}
    assert {k: r.fi for k, r in got.items()} == {1: 0, 2: 1, 3: 3}
    for rank, panel in ((1, [0]), (2, [0, 1, 3]), (3, [0, 1, 3])):  # equal importances enter together
        each = []
        for _, _, t in fold_parts(m, folds_of(m, rows, 2, 2, 1)):
            s = learner("xgboost")(m.x[~t][:, panel], m.y[~t], seed=1, **SMALL).predict(m.x[t][:, panel])
            each.append(mcc(m.y[t], (s >= 0.5).astype(int)))
        assert got[rank].mean_mcc == pytest.approx(np.mean(each)) and got[rank].std_mcc == pytest.approx(np.std(each))


def test_addition_by_performance(rows):
    m, chosen = matrix_of(rows), []
    parts = fold_parts(m, folds_of(m, rows, 2, 1, 0))
    for r in ranking.addition_by_performance(rows, 2, k=2, repeats=1, **SMALL).orderBy("rank").collect():
        means = {}
        for f in set(range(5)) - set(chosen):
            panel = sorted([*chosen, f])
            means[f] = np.mean([mcc(m.y[t], (learner("xgboost")(m.x[~t][:, panel], m.y[~t], **SMALL).predict(m.x[t][:, panel]) >= 0.5).astype(int)) for _, _, t in parts])
        best = min(means, key=lambda f: (-round(means[f], 12), f))
        assert r.fi == best and r.mean_mcc == pytest.approx(means[best])
        chosen.append(best)


def test_elimination(rows):
    m = matrix_of(rows)
    scored, kept = ranking.elimination(rows, 3, splits=2, seed=3, **SMALL)
    want, counts = [], {}
    for g, t in enumerate(splits_of(m, rows, 2, 0.3, 3)):
        left = list(range(5))
        while left:
            forest = learner("xgboost")(m.x[~t][:, left], m.y[~t], seed=3, **SMALL)
            imp = forest.importance(len(left))
            if len(left) <= 3:
                want += [(g, len(left), i, s) for i, s in zip(m.ids[t], forest.predict(m.x[t][:, left]), strict=True)]
                for place, v in zip(range(len(left)), imp, strict=True):
                    counts.setdefault((len(left), left[place]), []).append(v)
            left.pop(int(imp.argmin()))
    same_rows(numbers(scored, "group", "rank", "id", "score"), want)
    same_rows(numbers(kept, "rank", "fi", "count", "importance"), [(*k, len(v) / 2, sum(v) / 2) for k, v in counts.items()])


def test_search_scores_its_trials(rows):
    m = matrix_of(rows)
    got = ranking.search(rows, "random_forest", 5, ("mcc",), k=2, repeats=1, seed=1, batch=2).orderBy("trial").collect()
    assert [r.trial for r in got] == list(range(5)) and json.loads(got[0].params) == {}
    for r in got[1:3]:
        params = json.loads(r.params)
        assert set(params) == set(ranking.SPACES["random_forest"])
        each = [mcc(m.y[t], (learner("random_forest")(m.x[~t], m.y[~t], seed=1, **params).predict(m.x[t]) >= 0.5).astype(int)) for _, _, t in fold_parts(m, folds_of(m, rows, 2, 1, 1))]
        assert r["mean_test_mcc"] == pytest.approx(np.mean(each), abs=1e-9)
    best = max(r["mean_test_mcc"] for r in got)
    assert all(r.best == (r.trial == min(x.trial for x in got if x["mean_test_mcc"] == best)) for r in got)
    with pytest.raises(ValueError, match="scorer"):
        ranking.search(rows, scorers=("luck",))


SPACE = {"a": (-5.0, 5.0, False), "b": (1e-6, 1.0, True), "c": ["x", "y", "z"], "n": (1, 9, False)}


def test_parzen_estimators_come_nearer_than_chance():
    value = lambda p: -((p["a"] - 2) ** 2) - np.log10(p["b"] / 1e-3) ** 2 - 3 * (p["c"] != "y") - abs(p["n"] - 4)
    found, chance = [], []
    for seed in range(5):
        for sampler, out in ((Parzen(SPACE, seed), found), (Parzen(SPACE, seed + 100, startup=10**9), chance)):
            while len(sampler.trials) < 100:
                for p in sampler.ask(5):
                    assert -5 <= p["a"] <= 5 and 1e-6 <= p["b"] <= 1 and p["c"] in "xyz" and p["n"] in range(1, 10)
                    sampler.tell(p, (value(p),))
            out.append(max(v for _, v in sampler.trials))
    assert np.mean(found) > np.mean(chance) and Parzen(SPACE, 3).ask(4) == Parzen(SPACE, 3).ask(4)


def test_genetic_search_moves_towards_the_front():
    rng = np.random.default_rng(0)
    scores = rng.integers(0, 6, (40, 2)).astype(float)
    rank, left, level = fronts(scores), set(range(40)), 0
    while left:
        beaten = {i for i in left if any((scores[j] >= scores[i]).all() and (scores[j] > scores[i]).any() for j in left)}
        assert {i for i in left if rank[i] == level} == left - beaten
        left, level = beaten, level + 1
    assert crowding(np.array([[0.0], [1.0], [4.0], [5.0]])).tolist() == [np.inf, 0.8, 0.8, np.inf]
    goals = lambda p: (-((p["a"] - 1) ** 2), -((p["a"] + 1) ** 2) - abs(p["n"] - 3))

    def run(population):
        sampler = Genetic(SPACE, 1, population)
        while len(sampler.trials) < 200:
            for p in sampler.ask(20):
                sampler.tell(p, goals(p))
        return [sum(goals(p)) for p, _ in sampler.trials[-40:]]

    assert np.mean(run(20)) > np.mean(run(10**9)) + 5


def test_components_and_effective_dimension(rows, gaps):
    m = matrix_of(rows)
    x = (m.x - m.x.mean(axis=0)) / m.x.std(axis=0)
    both = rows.withColumn("x", F.transform("x", lambda v: v))
    scaled = array_from_long(normalize.standardise(long_from_array(both, "x", ["id"]), long_from_array(both, "x", ["id"])), ["id"])
    train, held = normalize.pca_scores(scaled, scaled.filter("id < 70"), ["id"], 3)
    got = np.array([[r.PCA_0, r.PCA_1, r.PCA_2] for r in train.orderBy("id").collect()])
    want = x @ np.linalg.svd(x, full_matrices=False)[2][:3].T
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-8) and held.count() == 10
    z = np.nan_to_num(wide(gaps)[1])
    w = np.linalg.eigvalsh(np.cov(z.T))
    p = w / w.sum()
    assert normalize.effective_dimension(gaps).first()[0] == pytest.approx(np.exp(-(p * np.log(p)).sum()))


def test_correlations_over_what_both_have(gaps, monkeypatch):
    _, x = wide(gaps)
    for block in (512, 2):  # features in one block, and in several
        monkeypatch.setattr(stats, "FEATURES", block)
        got = {(r.f_i, r.f_j): r["corr"] for r in stats.pair_correlations(gaps).collect()}
        assert set(got) == {(i, j) for i in range(5) for j in range(i, 5)}
        for (i, j), c in got.items():
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            assert c == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1])


def test_combat(spark):
    rng = np.random.default_rng(2)
    x, plate = rng.standard_normal((40, 6)) + 2, np.arange(40) % 3
    x[plate == 1] = x[plate == 1] * 1.5 + 1
    rows = [(i, int(plate[i]), f, float(x[i, f])) for i in range(40) for f in range(6)]
    got = {(r.id, r.fi): r.value for r in batch.combat(spark.createDataFrame(rows, "id long, plate long, fi long, value double"), "plate", 1e-10).collect()}
    n = np.array([(plate == b).sum() for b in range(3)])
    means = np.array([x[plate == b].mean(axis=0) for b in range(3)])
    grand = (n[:, None] * means).sum(axis=0) / 40
    sd = np.sqrt(np.mean([(x[i] - means[plate[i]]) ** 2 for i in range(40)], axis=0))
    z, out = (x - grand) / sd, np.zeros_like(x)
    for b in range(3):
        own = z[plate == b]
        g, d = own.mean(axis=0), own.var(axis=0, ddof=1)
        g_bar, t2, m, s2 = g.mean(), g.var(ddof=1), d.mean(), d.var(ddof=1)
        prior_a, prior_b = (2 * s2 + m**2) / s2, (m * s2 + m**3) / s2
        gs, ds = g.copy(), d.copy()
        for _ in range(500):
            gs = (t2 * n[b] * g + ds * g_bar) / (t2 * n[b] + ds)
            ds = (((own - gs) ** 2).sum(axis=0) / 2 + prior_b) / (n[b] / 2 + prior_a - 1)
        out[plate == b] = (own - gs) / np.sqrt(ds) * sd + grand
    assert np.allclose([[got[i, f] for f in range(6)] for i in range(40)], out, atol=1e-6)


def test_imputation_by_other_rows(gaps):
    ask, have = gaps.filter("id < 140"), gaps.filter("id >= 140")
    (ids, x), (others, y) = wide(ask), wide(have)
    modes = [min(v for v in set(c[~np.isnan(c)]) if (c == v).sum() == max((c == u).sum() for u in c[~np.isnan(c)])) for c in y.T]
    for method, fill in (("mean", np.nanmean(y, axis=0)), ("median", np.nanmedian(y, axis=0)), ("mode", np.array(modes))):
        assert np.allclose(wide(impute.impute(ask, method, reference=have))[1], np.where(np.isnan(x), fill, x))
    for weights, k in (("uniform", 3), ("distance", 4)):
        got, want = wide(impute.impute(ask, "knn", k=k, weights=weights, reference=have))[1], x.copy()
        d = neighbours.masked_distances(x, y)
        for i, j in zip(*np.nonzero(np.isnan(x)), strict=True):
            near = sorted((round(d[i, o], 12), others[o], o) for o in range(len(y)) if not np.isnan(y[o, j]) and not np.isnan(d[i, o]))[:k]
            w = [1.0 if weights == "uniform" else 1 / d[i, o] for *_, o in near]
            want[i, j] = sum(a * y[o, j] for a, (*_, o) in zip(w, near, strict=True)) / sum(w)
        assert np.allclose(got, want)
    with pytest.raises(ValueError, match="takes no"):
        impute.impute(ask, "mean", k=3)
    with pytest.raises(ValueError, match="neither"):
        impute.impute(ask, "knn", weights="odd")


@pytest.mark.parametrize("estimator", ["linear", "forest", "boosted"])
def test_chained_regressions(spark, estimator):
    rng = np.random.default_rng(1)
    a = rng.standard_normal(80)
    x = np.stack((a, 2 * a + 0.05 * rng.standard_normal(80), -a + 0.05 * rng.standard_normal(80)), axis=1)
    z = x.copy()
    z[rng.random(z.shape) < 0.15] = np.nan
    rows = [(i, 0, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(z)]
    df = spark.createDataFrame(rows, "id long, target int, x array<double>")
    how = {} if estimator == "linear" else {"trees": 20, "rounds": 2}
    got = np.array([r.x for r in impute.mice(df, ["id", "target"], estimator=estimator, **how).orderBy("id").collect()])
    gone = np.isnan(z) & ~np.isnan(z).all(axis=1)[:, None]
    assert np.allclose(got[~np.isnan(z)], z[~np.isnan(z)]) and np.abs(got - x)[gone].mean() < 0.5 * np.abs(np.broadcast_to(np.nanmean(z, axis=0), x.shape) - x)[gone].mean()
    # A few rows completed by regressions on the others: as if theirs had been the only ones, and no row of the others comes back.
    some = np.array([r.x for r in impute.mice(df.filter("id < 5"), ["id"], estimator=estimator, reference=df.filter("id >= 5").select("id", "x"), **how).orderBy("id").collect()])
    assert some.shape == (5, 3) and np.allclose(some[~np.isnan(z[:5])], z[:5][~np.isnan(z[:5])]) and not np.isnan(some).any()
    with pytest.raises(ValueError, match="none of"):
        impute.mice(df, ["id"], estimator="odd")


def test_one_round_of_linear_regressions(spark):
    rng = np.random.default_rng(5)
    z = rng.standard_normal((30, 3))
    z[:4, 0] = z[10:13, 1] = np.nan
    df = spark.createDataFrame([(i, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(z)], "id long, x array<double>")
    got = np.array([r.x for r in impute.mice(df, ["id"], rounds=1, ridge=0.0).orderBy("id").collect()])
    now = np.where(np.isnan(z), np.nanmean(z, axis=0), z)
    for j in (1, 0):  # fewest gaps first
        rest, gone = np.delete(now, j, axis=1), np.isnan(z[:, j])
        beta = np.linalg.lstsq(np.column_stack((np.ones(30), rest))[~gone], z[~gone, j], rcond=None)[0]
        now[gone, j] = np.column_stack((np.ones(30), rest))[gone] @ beta
    assert np.allclose(got, now)


@pytest.mark.parametrize("method", ["qrilc", "minprob", "miss_forest"])
def test_other_imputers_do_not_depend_on_partitions(gaps, method):
    how = {"rounds": 2, "trees": 5} if method == "miss_forest" else {}
    long = gaps.withColumn("value", F.col("value") + 10)
    (ids, x), (_, got), (_, again) = wide(long), wide(impute.impute(long, method, **how)), wide(impute.impute(long.repartition(5), method, **how))
    assert np.allclose(got[~np.isnan(x)], x[~np.isnan(x)]) and np.allclose(got, again, equal_nan=True)
    if method == "miss_forest":
        assert not np.isnan(got).any() and (got >= np.nanmin(x, axis=0)).all() and (got <= np.nanmax(x, axis=0)).all()
    if method == "qrilc":
        assert all(0 <= got[i, j] <= np.nanmax(x) + 10 for i, j in zip(*np.nonzero(np.isnan(x)), strict=True))


def test_information_of_pairs(gaps, monkeypatch):
    monkeypatch.setattr(information, "BLOCK", 2)
    _, x = wide(gaps)
    y = np.array([r.target for r in gaps.select("id", "target").distinct().orderBy("id").collect()])
    got = {(r.f_i, r.f_j): r.value for r in information.information_matrix(gaps).collect()}
    assert set(got) == {(i, j) for i in range(-1, 5) for j in range(i, 5)} and all(got[i, i] == 1 for i in range(-1, 5))
    for i, j in itertools.combinations(range(-1, 5), 2):
        a, b = (y.astype(float) if f < 0 else x[:, f] for f in (i, j))
        both = ~np.isnan(a) & ~np.isnan(b)
        mi = information.discrete_information(b[both], a[both]) if i < 0 else information.continuous_information(a[both], b[both])
        assert got[i, j] == pytest.approx(np.sqrt(1 - np.exp(-2 * mi)))


def test_information_nears_its_true_value():
    rng = np.random.default_rng(0)
    y = np.arange(3000) % 2
    x = rng.standard_normal(3000) + 2 * y
    grid = np.linspace(-8, 10, 20_001)
    a, b = (np.exp(-((grid - m) ** 2) / 2) / np.sqrt(2 * np.pi) for m in (0, 2))
    mix = (a + b) / 2
    true = ((a * np.log(a / mix) + b * np.log(b / mix)) / 2).sum() * (grid[1] - grid[0])
    assert information.discrete_information(x, y) == pytest.approx(true, abs=0.03)
    assert information.discrete_information(rng.standard_normal(3000), y) < 0.03
    z = 0.8 * x / x.std() + 0.6 * rng.standard_normal(3000)
    assert information.continuous_information(rng.standard_normal(2000), rng.standard_normal(2000)) < 0.05 < information.continuous_information(x[:2000], z[:2000])


def test_ward_order(spark):
    rng = np.random.default_rng(4)
    m = rng.random((9, 9))
    m = (m + m.T) / 2
    cells = [(i, j, float(m[i, j])) for i in range(9) for j in range(i, 9)]
    order = information.ward_order(spark.createDataFrame(cells, "f_i long, f_j long, value double"))
    clusters = [[i] for i in range(9)]
    while len(clusters) > 1:  # by centroids: what the sum of squares grows by

        def cost(p):
            a, b = (m[clusters[k]] for k in p)
            return len(a) * len(b) / (len(a) + len(b)) * ((a.mean(axis=0) - b.mean(axis=0)) ** 2).sum()

        a, b = min(itertools.combinations(range(len(clusters)), 2), key=cost)
        joined = set(clusters[a] + clusters[b])
        places = [order.index(f) for f in joined]
        assert max(places) - min(places) == len(joined) - 1  # every cluster's leaves stand side by side
        clusters = [c for k, c in enumerate(clusters) if k not in (a, b)] + [sorted(joined)]


def test_multisurf_row_by_row():
    rng = np.random.default_rng(3)
    x, y = rng.standard_normal((150, 4)), rng.integers(0, 2, 150)
    z = (x - x.min(axis=0)) / (x.max(axis=0) - x.min(axis=0))
    want = np.zeros(4)
    for i in range(150):
        d = np.abs(z - z[i]).sum(axis=1)
        others = np.delete(d, i)
        near = [j for j in range(150) if j != i and d[j] < others.mean() - others.std() / 2]
        for sign, group in ((-1, [j for j in near if y[j] == y[i]]), (1, [j for j in near if y[j] != y[i]])):
            if group:
                want += sign * np.abs(z[group] - z[i]).mean(axis=0) / 150
    assert np.allclose(selection.multisurf(x, y), want)


def test_filters_keep_the_feature_that_tells(rows):
    long = long_from_array(rows, "x", ["id", "target"])
    assert {r.fi for r in selection.significant(long, 1e-4).collect()} >= {0}
    found = {r.fi: r.decision for r in selection.boruta(long, trials=15, trees=10).collect()}
    assert found[0] == "confirmed" and len(found) == 5
    assert selection.select_features(long, "boruta", trials=15, trees=10).filter("fi = 0").count() == 1
    assert 0 in {r.fi for r in selection.relief_filter(long, 4).collect()}
    scores = {r.fi: r.mi for r in information.information_cv(long, n_repeats=1).collect()}
    assert [r.fi for r in selection.select_features(long, 2, 1, n_repeats=1).orderBy(F.desc("mi")).collect()] == sorted(scores, key=lambda f: -scores[f])[:2]
    assert selection.select_features(long, 0.035, 1, n_repeats=1).count() == sum(v >= 0.035 for v in scores.values())
    assert selection.select_features(long, "effective_dim", 1, n_repeats=1).count() == int(np.ceil(normalize.effective_dimension(long).first()[0]))


def test_new_rows_lie_between_neighbours(rows):
    few = rows.filter("target = 0 or id < 200")
    m = matrix_of(few)
    small = m.x[m.y == 1]
    out = resample.augment(few, "smote_balanced", seed=3)
    new = [np.array(r.x) for r in out.filter("id < 0").collect()]
    assert len(new) == (m.y == 0).sum() - len(small) > 0
    d = np.sqrt(((small[:, None] - small[None]) ** 2).sum(axis=2))
    for v in new:
        on = []
        for i in range(len(small)):
            for j in np.argsort(d[i])[1:6]:
                step = small[j] - small[i]
                u = ((v - small[i]) @ step) / (step @ step)
                on.append(-1e-9 <= u <= 1 + 1e-9 and np.allclose(small[i] + u * step, v))
        assert any(on)
    noisy = resample.rebalance(few, 1.0, 200, seed=1)
    assert noisy.count() == 200 and noisy.filter("target = 1").count() == 100
    h = resample.best_bandwidth(few.filter("target = 1"))
    away = [np.abs(small - np.array(r.x)).max(axis=1).min() for r in noisy.filter("id < 0 and target = 1").collect()]
    assert h in resample.BANDWIDTHS and np.median(away) < 4 * h


def test_new_rows_get_names(spark, rows):
    patients = rows.select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("patient_id"), F.lit("control").alias("label"))
    new = spark.createDataFrame([(-1, 1, [0.0] * 5), (-1_000_000_001, 0, [1.0] * 5), (-2, 1, [2.0] * 5)], rows.schema)
    got = {r.id: (r.patient_id, r.label) for r in resample.name_new(rows.unionAll(new), patients).collect()}
    assert len(got) == 63 and got[0] == ("p0", "control") and {i: got[i] for i in got if i < 0} == {-1: ("AUG0", "AUG0"), -2: ("AUG1", "AUG1"), -1_000_000_001: ("AUG2", "AUG2")}
    report = {r.stage: tuple(r)[1:] for r in resample.class_report(rows, rows.unionAll(new)).collect()}
    assert report == {"before": (60, 30, 30, 0.5), "after": (63, 32, 31, pytest.approx(32 / 63))}


def test_holdout_scores_and_local_weights(rows):
    m = matrix_of(rows.filter("id < 280"))
    forest = learner("xgboost")(m.x[:, [0, 2]], m.y, seed=1, **SMALL)
    held = matrix_of(rows.filter("id >= 280"))
    got = ranking.holdout_scores(rows.filter("id < 280"), rows.filter("id >= 280"), panel=[0, 2], seed=1, **SMALL)
    same_rows(numbers(got, "id", "score"), zip(held.ids, forest.predict(held.x[:, [0, 2]]), strict=True))
    narrow = ranking.holdout_scores(ranking.with_panel(rows.filter("id < 280"), [0, 2]), ranking.with_panel(rows.filter("id >= 280"), [0, 2]), seed=1, **SMALL)
    same_rows(numbers(narrow, "id", "score"), numbers(got, "id", "score"))
    weights = ranking.lime(rows.filter("id < 30"), lambda x: 3 * x[:, 0] - x[:, 3], samples=4000)
    means = {r.fi: r.w for r in weights.groupBy("fi").agg(F.avg("weight").alias("w")).collect()}
    assert means[0] / -means[3] == pytest.approx(3, rel=0.1) and max(abs(means[f]) for f in (1, 2, 4)) < 0.1 * means[0]


def test_reports_of_folds_and_bootstraps(spark):
    rng = np.random.default_rng(6)
    rows = [(g, i, i % 2, float(np.round(rng.standard_normal() + 1.5 * (i % 2), 1))) for g in range(6) for i in range(40)]
    scored = spark.createDataFrame(rows, "group long, id long, y int, score double")

    def summary(y, s, w=None):
        w = np.ones(len(y)) if w is None else w
        cuts = sorted(set(s[w > 0]), reverse=True)
        rate = lambda c, k: w[(s >= c) & (y == k)].sum() / w[y == k].sum()
        j = [(round(rate(c, 1) - rate(c, 0), 12), c) for c in cuts]
        top = max(j)
        hard = s >= top[1] if top[0] > 0 else np.zeros(len(s), bool)
        tp, fp, fn, tn = (w[(hard == a) & (y == b)].sum() for a, b in ((1, 1), (1, 0), (0, 1), (0, 0)))
        d = np.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
        return {"sensitivity": tp / (tp + fn), "ppv": tp / (tp + fp) if tp + fp else 0.0, "npv": tn / (tn + fn) if tn + fn else 0.0, "mcc": (tp * tn - fp * fn) / d if d else 0.0}

    def check(got, each):
        for name in ("sensitivity", "ppv", "npv", "mcc"):
            v = [e[name] for e in each]
            assert got[name] == pytest.approx((np.mean(v), *np.percentile(v, [2.5, 97.5])), abs=1e-4)

    table = lambda df: {r.metric: (r["mean"], r.low, r.high) for r in df.collect()}
    a = np.array(rows)
    check(table(metrics.fold_report(scored)), [summary(a[a[:, 0] == g, 2], a[a[:, 0] == g, 3]) for g in range(6)])
    one = scored.filter("group = 0").drop("group")
    drawn = {}
    for r in folds.bootstrap(one, 30, 2).collect():
        drawn.setdefault(r.boot, {})[r.id] = r.weight
    y, s = a[a[:, 0] == 0, 2], a[a[:, 0] == 0, 3]
    check(table(ranking.bootstrap_report(one, 30, 2)), [summary(y, s, np.array([w.get(i, 0) for i in range(40)], float)) for w in drawn.values()])


def test_a_split_is_the_best_of_all():
    rng = np.random.default_rng(7)
    x = np.round(rng.standard_normal((40, 4)), 1)
    x[rng.random(x.shape) < 0.2] = np.nan
    grad, hess = rng.standard_normal(40), rng.uniform(0.5, 1.5, 40)
    for shape in (Shape(1, lam=0.5), Shape(1, alpha=0.8, child=3.0, min_leaf=6), Shape(1, min_share=0.3)):
        pull = lambda g, a=shape.alpha: np.sign(g) * max(abs(g) - a, 0)
        score = lambda rows, lam=shape.lam: pull(grad[rows].sum()) ** 2 / (hess[rows].sum() + lam)
        best = (0, None)
        for f in range(4):
            values = np.unique(x[~np.isnan(x[:, f]), f])
            for cut in (values[1:] + values[:-1]) / 2:
                for missing in (False, True):
                    low = np.where(np.isnan(x[:, f]), missing, x[:, f] <= cut)
                    least = max(shape.child, shape.min_share * hess.sum())
                    if min(hess[low].sum(), hess[~low].sum()) >= least and min(low.sum(), (~low).sum()) >= shape.min_leaf:
                        best = max(best, (score(low) + score(~low) - score(np.ones(40, bool)), (f, cut)), key=lambda b: b[0])
        tree = grow(x, grad, hess, shape)
        assert tree.gain[0] == pytest.approx(best[0]) and (tree.feature[0], pytest.approx(tree.threshold[0])) == best[1]
    assert len(grow(x, grad, hess, Shape(3, gamma=1e6)).feature) == 1
    assert (grow(x, grad, hess, Shape(9, leaves=4)).feature < 0).sum() == 4


def test_learners_take_missing_values_and_their_settings():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((200, 5))
    y = (x[:, 0] > 0).astype(int)
    x[rng.random(200) < 0.3, 0] = np.nan
    for forest in (boost(x, y, 40), boost(x, y, 60, subsample=0.5, columns=0.6, alpha=0.1, gamma=0.05, child_weight=0.5), grow_forest(x, y, 40, 4), grow_forest(x, y, 40, 4, criterion="entropy", features="log2", min_leaf=3, leaves=8)):
        assert ranking._rank_auc(y, forest.predict(x)) > 0.8
    assert np.corrcoef(boost(x[:, 1:], x[:, 2] * 3, 60, logistic=False).predict(x[:, 1:]), x[:, 2])[0, 1] > 0.98


def test_normalisers_by_name(gaps):
    for method, by in (("standard", normalize.standardise), ("min_max", normalize.min_max_clip), ("median", normalize.centre_on_median)):
        got = normalize.Normaliser(method).fit(gaps.filter("id < 200")).transform(gaps)
        same = by(gaps, gaps.filter("id < 200"))
        assert np.allclose(wide(got)[1], wide(same)[1], equal_nan=True)
        with pytest.raises(ValueError, match="not fitted"):
            normalize.Normaliser(method).transform(gaps)
    top = normalize.Normaliser("top_l", l=3)
    assert top.get_params() == {"method": "top_l", "l": 3} and np.allclose(wide(top.transform(gaps))[1], wide(normalize.top_l(gaps, 3))[1], equal_nan=True)
    assert top.set_params(method="none").transform(gaps) is gaps
    for bad in ({"method": "odd"}, {"method": "log2", "l": 3}):
        with pytest.raises(ValueError):
            normalize.Normaliser(**bad)


def test_neighbours_by_any_distance(rows):
    m = matrix_of(rows)
    one = {
        "euclidean": lambda a, b: np.sqrt(((a - b) ** 2).sum()), "manhattan": lambda a, b: np.abs(a - b).sum(), "chebyshev": lambda a, b: np.abs(a - b).max(),
        "cosine": lambda a, b: 1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b), "correlation": lambda a, b: 1 - np.corrcoef(a, b)[0, 1], "masked_euclidean": lambda a, b: np.sqrt(((a - b) ** 2).sum()),
    }
    assert set(one) == set(neighbours.METRICS)
    for metric, f in one.items():
        want = []
        for i in range(60):
            near = sorted((round(f(m.x[i], m.x[j]), 12), m.ids[j]) for j in range(60) if j != i)[:3]
            want += [(m.ids[i], n, d, k + 1) for k, (d, n) in enumerate(near)]
        same_rows(numbers(neighbours.nearest(rows.select("id", "x"), 3, metric=metric), "id", "nid", "distance", "rank"), want)
    with pytest.raises(ValueError, match="metric"):
        neighbours.nearest(rows, 1, metric="odd")


@pytest.mark.parametrize("model", ["xgboost", "random_forest"])
def test_a_model_comes_back_from_its_table(spark, rows, tmp_path, model):
    from assayloom.sources.files import read_forest

    m = matrix_of(rows)
    forest = ranking.fitted(rows, model, None, 2, **SMALL)
    ranking.model_table(spark, forest).repartition(3).write.parquet(str(tmp_path / "model.parquet"))
    again = read_forest(spark, str(tmp_path / "model.parquet"))
    x = np.where(np.random.default_rng(0).random(m.x.shape) < 0.2, np.nan, m.x)
    assert np.array_equal(again.predict(x), forest.predict(x)) and np.array_equal(again.importance(5), forest.importance(5))
    assert np.array_equal(ranking.scored_by(again, rows).orderBy("id").toPandas()["score"].to_numpy(), forest.predict(m.x))
