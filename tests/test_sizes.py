"""What keeps large tables within time and memory: work is done once, and in pieces of a bounded size."""

import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayloom.operators import information, metrics, neighbours, ranking, selection
from assayloom.operators.forest import boost


def watched(spark, rows):
    """Scores whose every computation is counted, and the count."""
    made = spark.sparkContext.accumulator(0)

    def count(parts):
        for pdf in parts:
            made.add(len(pdf))
            yield pdf

    return rows.mapInPandas(count, rows.schema), made


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    return spark.createDataFrame([(i % 3, i, i % 2, round(float(rng.random()), 1)) for i in range(300)], "group long, id long, y int, score double").cache()


def test_folds_are_scored_once(spark, scored):
    seen, made = watched(spark, scored)
    assert sorted(metrics.fold_report(seen).collect()) == sorted(metrics.fold_report(scored).collect())
    assert made.value == 300


def test_a_fit_holds_few_columns_at_a_time():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((20_000, 64))
    tracemalloc.start()
    boost(x, (x[:, 0] > 0).astype(int), trees=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * x.nbytes / 2  # codes and orders are short numbers; sorting all columns at each node took 10 times the matrix


def test_steps_are_scored_once(spark, scored):
    steps = scored.withColumn("rank", F.lit(1).cast("long"))
    seen, made = watched(spark, steps)
    assert ranking.rank_summary(seen).collect() == ranking.rank_summary(steps).collect()
    assert made.value == 300


def test_boots_are_drawn_once(spark, scored, monkeypatch):
    from assayloom.operators import folds

    made, drawn = spark.sparkContext.accumulator(0), folds.bootstrap

    def watch(*args):
        out = drawn(*args)

        def count(parts):
            for pdf in parts:
                made.add(int(pdf["weight"].sum()))
                yield pdf

        return out.mapInPandas(count, out.schema)

    want = sorted(ranking.bootstrap_report(scored, 5).collect())
    monkeypatch.setattr(folds, "bootstrap", watch)
    assert sorted(ranking.bootstrap_report(scored, 5).collect()) == want
    assert made.value == 5 * 300


def test_relief_holds_few_differences():
    rng = np.random.default_rng(0)
    x, y = rng.standard_normal((3000, 40)), rng.integers(0, 2, 3000)
    tracemalloc.start()
    whole = selection.multisurf(x, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * x.nbytes  # 64 rows' differences to all were 64 times the matrix
    assert np.allclose(sum(selection.multisurf(x, y, p, 3) for p in range(3)), whole, atol=1e-12)


def test_points_of_many_columns_are_near_few():
    """As many distances as points, about, on a plane whose points stand in stripes; each is the one found among all."""
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 3, 40_000).astype(float), rng.standard_normal(40_000)
    began = time.time()
    got = information.kth_in_plane(x, y, 3)
    assert time.time() - began < 7
    for i in range(0, 40_000, 1999):
        assert got[i] == np.sort(np.maximum(np.abs(x - x[i]), np.abs(y - y[i])))[3]


def test_alike_rows_are_explained_once(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 3)).round(1)
    rows = spark.createDataFrame([(i, int(v[0] > 0), v.tolist()) for i, v in enumerate(x)], "id long, target int, x array<double>")
    many = rows.crossJoin(spark.range(1000).withColumnRenamed("id", "copy")).withColumn("id", F.col("copy") * 60 + F.col("id")).drop("copy").cache()
    many.count()
    began = time.time()
    got = ranking.shap_report(many, many, trees=20).groupBy("id").agg(F.sum("shap").alias("s")).count()
    assert got == 60_000 and time.time() - began < 60


@pytest.mark.parametrize("metric", ["braycurtis", "canberra", "chebyshev", "hamming", "manhattan", "minkowski", "sqeuclidean"])
def test_distances_hold_few_differences(metric):
    rng = np.random.default_rng(0)
    a, b = rng.standard_normal((64, 64)), rng.standard_normal((2048, 64))
    tracemalloc.start()
    neighbours.distances(a, b, metric)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * 8 * len(a) * len(b)  # all differences of all features at once were 64 times the distances
