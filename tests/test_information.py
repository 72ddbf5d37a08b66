"""Neighbour information by sorted sweeps against all differences, bootstraps by splitting, bandwidths from blocks."""

import collections
import resource

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayloom.operators import folds, information, resample


def numbers(kind, n, seed=0):
    rng = np.random.default_rng(seed)
    x = {"normal": rng.normal(size=n), "ties": rng.integers(0, 4, n).astype(float), "skewed": np.exp(rng.normal(0, 3, n)), "apart": np.where(rng.random(n) < 0.1, 1e6, 0) + rng.random(n)}[kind]
    return information.unlike(x, seed)


@pytest.mark.parametrize("kind", ["normal", "ties", "skewed", "apart"])
def test_counts_and_radii(kind):
    x = np.sort(numbers(kind, 300))
    d = np.abs(x[:, None] - x)
    for k in (1, 3, 7):
        radius = information.kth_distances(x, k)
        assert (radius == np.sort(d, axis=1)[:, k]).all()
        assert (information.within(x, x, radius) == (d < radius[:, None]).sum(axis=1)).all()
    plain = np.round(x, 1)
    assert (information.within(plain, plain, np.full(300, 0.3)) == (np.abs(plain[:, None] - plain) < 0.3).sum(axis=1)).all()
    assert (information.within(plain, plain, np.zeros(300)) == 0).all()


@pytest.mark.parametrize("kind", ["normal", "ties", "skewed", "apart"])
@pytest.mark.parametrize("n", [5, 700])
def test_radii_in_the_plane(kind, n):
    x, y = numbers(kind, n, 1), numbers("normal", n, 2)
    d = np.maximum(np.abs(x[:, None] - x), np.abs(y[:, None] - y))
    assert (information.kth_in_plane(x, y, 3) == np.sort(d, axis=1)[:, 3]).all()


def test_a_long_feature_in_little_memory():
    n = 200_000
    x, y = numbers("normal", n), np.arange(n) % 2
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    mi = information.discrete_information(x + y, y)
    assert mi == pytest.approx(0.111, abs=0.01)
    z = x[:40_000]
    both = information.continuous_information(z, z + numbers("normal", 40_000, 5))
    assert both == pytest.approx(0.5 * np.log(2), abs=0.02)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000  # KB


def test_information_over_folds(spark):
    """The mean over the training parts of every repeat, times the share that is there."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3))
    target = (x[:, 0] + rng.normal(size=60) > 0).astype(int)
    cells = [(i, int(target[i]), f, None if (i + f) % 7 == 0 else float(x[i, f])) for i in range(60) for f in range(3)]
    long = spark.createDataFrame(cells, "id long, target int, fi long, value double").repartition(4)
    fold = {(r.repeat, r.id): r.fold for r in folds.repeated_stratified_folds(long.select("id", "target").distinct(), 2, 3, 5).collect()}
    got = {r.fi: r.mi for r in information.information_cv(long, 2, 3, 5).collect()}
    for f in range(3):
        v = np.array([np.nan if c[3] is None else c[3] for c in cells if c[2] == f])
        scores = []
        for repeat in range(3):
            for part in range(2):
                seen = np.array([fold[repeat, i] != part for i in range(60)])
                scores.append(information.discrete_information(information.unlike(np.nan_to_num(v[seen]), 5), target[seen]) * (1 - np.isnan(v[seen]).mean()))
        assert got[f] == pytest.approx(np.mean(scores), abs=1e-12)


@pytest.mark.parametrize("leaf_rows", [1024, 8])
def test_bootstrap(spark, leaf_rows, monkeypatch):
    monkeypatch.setattr(folds, "LEAF_ROWS", leaf_rows)
    rows = spark.range(200).select("id", (F.col("id") * 2).alias("y")).unionAll(spark.createDataFrame([(7, -1), (7, -2)], "id long, y long"))
    found = folds.bootstrap(rows, 150, seed=3).collect()
    total, one = collections.Counter(), collections.Counter()
    for r in found:
        total[r.boot] += r.weight
        one[r.weight] += 1
        assert r.weight > 0 and (r.y == 2 * r.id or r.id == 7)
    assert set(total) == set(range(150)) and set(total.values()) == {202}
    assert len({(r.boot, r.id, r.y) for r in found}) == len(found)
    drawn = sum(one.values()) / (150 * 202)
    assert drawn == pytest.approx(1 - (1 - 1 / 202) ** 202, abs=0.01)  # the share of rows that a boot draws
    per_row = collections.Counter()
    for r in found:
        per_row[r.id, r.y] += r.weight
    assert min(per_row.values()) > 100 and max(per_row.values()) < 205  # 150 are expected, with a deviation of 12
    again = folds.bootstrap(rows.repartition(5, "y"), 150, seed=3)
    assert sorted((r.boot, r.y, r.weight) for r in again.collect() if r.id != 7) == sorted((r.boot, r.y, r.weight) for r in found if r.id != 7)
    assert sorted((r.boot, r.y, r.weight) for r in folds.bootstrap(rows, 150, seed=4).collect()) != sorted((r.boot, r.y, r.weight) for r in found)
    assert folds.bootstrap(rows.filter("false"), 3).collect() == []


@pytest.mark.parametrize("block", [2048, 16])
@pytest.mark.parametrize("spread", [0.05, 1.0, 30.0])
def test_bandwidth(spark, spread, block, monkeypatch):
    """The best of all folds and bandwidths, each likelihood written out."""
    monkeypatch.setattr(resample, "OTHERS", block)
    x = np.random.default_rng(7).normal(0, spread, (70, 3))
    fold = np.arange(70) % 5
    scores = []
    for h in resample.BANDWIDTHS:
        ll = 0.0
        for f in range(5):
            train, test = x[fold != f], x[fold == f]
            e = ((test[:, None] - train[None]) ** 2).sum(axis=2) / (-2 * h * h)
            top = e.max(axis=1)
            ll += (top + np.log(np.exp(e - top[:, None]).sum(axis=1)) - np.log(len(train)) - 3 * (np.log(h) + 0.5 * np.log(2 * np.pi))).sum()
        scores.append(ll)
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, x array<double>").repartition(3)
    assert resample.best_bandwidth(rows) == resample.BANDWIDTHS[int(np.argmax(scores))]
    assert resample.best_bandwidth(rows.limit(1)) == resample.BANDWIDTHS[0]
