"""MissForest over tables that no single task completes: a task a tree, the same as one after another."""

import os

import numpy as np
import pytest

from assayloom.operators import impute, miss_forest
from assayloom.operators.forest import Forest, Shape, grow


def one_by_one(z, own, rounds, trees, depth, seed):
    """The rounds with whole matrices, trees grown in turn; each has draws of its own."""

    def fit(a, y, b, j):
        made = []
        for t in range(trees):
            rng = np.random.default_rng([seed + j, t])
            rows = rng.integers(0, len(y), len(y))
            made.append(grow(a, -y, np.ones(len(y)), Shape(depth), rng=rng, mtry=max(1, int(np.sqrt(a.shape[1]))), sample=rows))
        return Forest(made, 1 / trees).predict(b)

    return impute._rounds(z, own, fit, rounds, True)


@pytest.fixture(scope="module")
def gapped(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((300, 2)) @ rng.standard_normal((2, 6)) + 0.1 * rng.standard_normal((300, 6))
    x[:, 1] = x[:, 1].round(1)  # equal values
    z = np.where(rng.random(x.shape) < 0.15, np.nan, x)
    z[:, 5] = x[:, 5]  # one without gaps
    rows = [(i, i % 2, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(z)]
    return x, z, spark.createDataFrame(rows, "id long, target int, x array<double>").cache()


def matrix(df):
    rows = df.orderBy("id").collect()
    return [r.id for r in rows], np.array([r.x for r in rows])


def test_large_tables_are_completed_tree_by_tree(gapped, monkeypatch):
    """They raised. Blocks, partitions and tasks bear on nothing."""
    x, z, df = gapped
    want = one_by_one(z, np.ones(300, bool), 4, 7, 6, 3)
    monkeypatch.setattr(miss_forest, "BLOCK", 300)  # six partitions
    how = {"rounds": 4, "trees": 7, "seed": 3, "most_cells": 1}
    ids, got = matrix(impute.miss_forest(df, ["id", "target"], **how))
    assert ids == list(range(300)) and np.array_equal(got, want)
    assert np.array_equal(matrix(impute.miss_forest(df.repartition(5), ["id"], **how | {"rounds": 1}))[1], one_by_one(z, np.ones(300, bool), 1, 7, 6, 3))
    gone = np.isnan(z)
    assert np.abs(got - x)[gone].mean() < 0.6 * np.abs(np.nanmean(z, axis=0) - x)[gone].mean()


def test_large_tables_learn_from_their_reference_only(gapped):
    _, z, df = gapped
    df = df.withColumn("id", df.id + 1000)
    how = {"rounds": 2, "trees": 4, "most_cells": 1}
    ids, got = matrix(impute.miss_forest(df.filter("id < 1020"), ["id"], reference=df.filter("id >= 1020").select("id", "x"), **how))
    assert ids == list(range(1000, 1020)) and np.array_equal(got, one_by_one(z, np.arange(300) >= 20, 2, 4, 6, 0)[:20])
    ids, few = matrix(impute.miss_forest(df.filter("id in (1003, 1011)"), ["id"], reference=df.filter("id >= 1020").select("id", "x"), rounds=2, trees=4, most_cells=1))
    assert ids == [1003, 1011] and np.array_equal(few, one_by_one(z[[3, 11, *range(20, 300)]], np.arange(282) >= 2, 2, 4, 6, 0)[:2])


def test_a_feature_without_values_and_bad_ones(spark):
    rows = [(i, [None, None if i % 7 == 0 else float(i % 5), float(i % 3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    _, got = matrix(impute.miss_forest(df, ["id"], rounds=2, trees=3, most_cells=1))
    assert (got[:, 0] == 0).all() and not np.isnan(got).any()
    for bad, said in (([1.0, float("inf"), 2.0], "infinite"), ([1.0], "values"), (None, "values")):
        with pytest.raises(ValueError, match=said):
            impute.miss_forest(df.unionByName(spark.createDataFrame([(99, bad)], "id long, x array<double>")), ["id"], most_cells=1)


def test_only_columns_in_use_are_kept(spark, gapped):
    """A round's columns go when the next ones are there."""
    folder = miss_forest.folder_of_columns(spark)
    before = set(os.listdir(folder))
    impute.miss_forest(gapped[2], ["id"], rounds=3, trees=2, most_cells=1)
    left = [f for f in set(os.listdir(folder)) - before if f.startswith("column-")]
    assert len(left) <= 2 * 6 + 6 + 1  # values and order, places of gaps, one block's marks
