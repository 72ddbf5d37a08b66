"""Shapley values by leaf paths against all sets of features, and for trees as deep as the defaults."""

import time
from itertools import combinations
from math import factorial

import numpy as np
import pytest

from assayloom.operators.forest import LEARNERS, grow_forest


def by_sets(tree, x, game):
    own = sorted(set(tree.feature[tree.feature >= 0].tolist()))
    worth = {frozenset(s): getattr(tree, game)(x, frozenset(s)) for k in range(len(own) + 1) for s in combinations(own, k)}
    out, m = np.zeros(len(x)), len(own)
    for f in own:
        for k in range(m):
            for s in combinations([g for g in own if g != f], k):
                out[f] += factorial(k) * factorial(m - k - 1) / factorial(m) * (worth[frozenset((*s, f))] - worth[frozenset(s)])
    return out


@pytest.mark.parametrize("game", ["expected", "ejected"])
@pytest.mark.parametrize("depth", [1, 3, 6])
def test_values_of_a_tree(game, depth):
    rng = np.random.default_rng(depth)
    x = rng.normal(size=(80, 6))
    y = ((x[:, 0] * x[:, 1] + x[:, 2] > 0) ^ (x[:, 3] > 1)).astype(int)
    x[rng.random(x.shape) < 0.1] = np.nan
    for tree in grow_forest(x, y, 3, depth, seed=1).trees:
        got = tree.shapley(x[:12], game)
        for r in range(12):
            assert got[r] == pytest.approx(by_sets(tree, x[r], game), abs=1e-10)


def test_deep_forests_end():
    """Default depth, 30 features: values add up to the margin less its mean, and are there in seconds."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(250, 30))
    y = (x[:, :5].sum(axis=1) + rng.normal(size=250) > 0).astype(int)
    forest = LEARNERS["balanced_random_forest"](x, y, trees=20)
    assert max(len(set(t.feature[t.feature >= 0].tolist())) for t in forest.trees) > 15
    began = time.time()
    shap = forest.shapley(x)
    assert time.time() - began < 60
    mean = sum(forest.scale * t.expected(x[0], frozenset()) for t in forest.trees) + forest.base
    assert shap.sum(axis=1) == pytest.approx(forest.margin(x) - mean, abs=1e-8)
