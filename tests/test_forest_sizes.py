"""Fits of the findings of round three: the same trees in less time, and work that is not repeated."""

import numpy as np
import pytest

from assayloom.operators import ranking
from assayloom.operators import forest as trees_of
from assayloom.operators.forest import boost, grow, grow_forest, ranked, Shape


def slow_split(x, grad, hess, rows, shape):
    """The best split by sorting each column, a cut at a time."""
    best = None
    for j in range(x.shape[1]):
        order = rows[np.argsort(x[rows, j], kind="stable")]
        for k in range(len(order) - 1):
            if x[order[k], j] == x[order[k + 1], j] or min(k + 1, len(order) - k - 1) < shape.min_leaf:
                continue
            (a, b), (c, d) = ((grad[o].sum(), hess[o].sum()) for o in (order[: k + 1], order[k + 1 :]))
            gain = a**2 / b + c**2 / d - (a + c) ** 2 / (b + d)
            if min(b, d) >= shape.child and (best is None or gain > best[0] + 1e-9):
                best = gain, j, (x[order[k], j] + x[order[k + 1], j]) / 2
    return best


@pytest.mark.parametrize("least", [1, 9])
def test_rows_drawn_several_times_split_as_copies(least):
    rng = np.random.default_rng(4)
    x, shape = rng.standard_normal((80, 5)).round(1), Shape(1, min_leaf=least)
    y, rows = (x[:, 2] + rng.standard_normal(80) > 0).astype(float), rng.integers(0, 80, 80)
    tree = grow(x, -y, np.ones(80), shape, sample=rows)
    gain, j, cut = slow_split(x, -y, np.ones(80), rows, shape)
    assert tree.feature[0] == j and tree.gain[0] == pytest.approx(gain) and tree.threshold[0] == pytest.approx(cut)
    assert tree.cover[0] == 80


def test_many_trees_on_all_features_are_quick():
    """search_trials draws forests of up to 500 trees on all features."""
    rng = np.random.default_rng(0)
    x = rng.standard_normal((5000, 64))
    y = (x[:, 0] + rng.standard_normal(5000) > 0).astype(int)
    calls, real = [0], trees_of._by_code
    trees_of._by_code = lambda c: (calls.__setitem__(0, calls[0] + 1), real(c))[1]
    try:
        grow_forest(x, y, 8, 5, features="all")
    finally:
        trees_of._by_code = real
    assert calls[0] == 0  # a sort a node and feature were 15,000


def test_shadows_are_ordered_as_their_codes():
    x = np.random.default_rng(1).standard_normal((500, 6)).round(1)
    codes, _ = ranked(x)
    both = (np.random.default_rng([0, 3]).permuted(v, axis=0) for v in (x, codes.T))
    assert (ranked(next(both))[0].T == next(both)).all()


def test_elimination_grows_no_tree_again(spark, monkeypatch):
    """The scores and features kept are those of boosting anew at every size; most trees are not grown again."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((120, 12)).round(2)
    rows = spark.createDataFrame([(i, int(v[0] + v[1] * v[2] > 0), v.tolist()) for i, v in enumerate(x)], "id long, target int, x array<double>").cache()
    got = [sorted(tuple(r) for r in df.collect()) for df in ranking.elimination(rows, 6, splits=2, trees=4)]
    made = []
    monkeypatch.setattr(ranking, "_without", lambda trees, gone: made.append(1) or [])
    want = [sorted(tuple(r) for r in df.collect()) for df in ranking.elimination(rows, 6, splits=2, trees=4)]
    assert got == want
    monkeypatch.undo()
    y = (x[:, 0] > 0).astype(int)
    whole = boost(x, y, 6)
    unused = next(j for j in range(12) if not any((t.feature == j).any() for t in whole.trees))
    begun = ranking._without(whole.trees, unused)
    assert len(begun) == 6
    again = boost(np.delete(x, unused, axis=1), y, 6)
    assert all(np.array_equal(a.feature, b.feature) and np.array_equal(a.threshold, b.threshold) for a, b in zip(begun, again.trees, strict=True))


def test_workers_map_one_file(spark, monkeypatch):
    """A large matrix travels as the name of a file; scores are the same."""
    import pickle

    from assayloom.operators import grid

    rng = np.random.default_rng(3)
    x = rng.standard_normal((90, 5))
    rows = spark.createDataFrame([(i, int(v[0] > 0), v.tolist()) for i, v in enumerate(x)], "id long, target int, x array<double>").cache()
    want = sorted(ranking.cv_scores(rows, trees=3).collect())
    monkeypatch.setattr(grid, "LEAST_STORED", 1)
    m = grid.matrix_of(rows)
    assert m.path and x.tobytes() not in pickle.dumps(m) and np.array_equal(pickle.loads(pickle.dumps(m)).x, m.x)
    assert sorted(ranking.cv_scores(rows, trees=3).collect()) == want


def test_permuted_features_ask_only_their_trees(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((200, 9))
    y = (x[:, 1] + x[:, 4] > 0).astype(int)
    rows = spark.createDataFrame([(i, int(t), v.tolist()) for i, (v, t) in enumerate(zip(x, y, strict=True))], "id long, target int, x array<double>").cache()
    got = {r.fi: (r.importance, r.std) for r in ranking.permutation_importance(rows, repeats=4, trees=5).collect()}
    forest = boost(x, y, 5, 0.05, 2)
    base = ranking._average_precision(y, forest.predict(x))
    for j in range(9):
        gen, drops = np.random.default_rng([0, j]), []
        for _ in range(4):
            z = x.copy()
            z[:, j] = gen.permutation(z[:, j])
            drops.append(base - ranking._average_precision(y, forest.predict(z)))
        assert got[j] == (np.mean(drops), np.std(drops))


def test_means_need_no_whole_matrix(spark, monkeypatch):
    from assayloom.operators import preprocess

    cells = [(i, i % 2, i % 5 == 0, f, None if (3 * i + f) % 4 == 0 else float(i * f % 7 + 1)) for i in range(30) for f in range(3)]
    split = spark.createDataFrame(cells, "id long, target int, test boolean, fi long, value double")
    tried = [{"scaler": s, "mnar": None, "mar": m} for s in ("none", "min_max") for m in ({"method": "mean"}, None)]
    monkeypatch.setattr(preprocess, "over_pipelines", None)  # has a whole matrix in a task
    got = {(r.pipeline, r.id, r.place): r.value for r in preprocess.completed_cells(split, tried).collect()}
    assert len(got) == 4 * 90
    for f in range(3):
        mean = np.mean([v for _, _, test, g, v in cells if g == f and not test and v is not None])
        for i, _, _, g, v in cells:
            if g == f:
                assert got["none_none_mean", i, f] == pytest.approx(mean if v is None else v) and got["none_none_none", i, f] == v
