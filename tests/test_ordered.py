"""Running sums, ranks and quantiles over groups that many tasks share, against direct computation."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayloom.operators import folds, metrics, ordered, stats


@pytest.fixture(scope="module")
def scored(spark):
    """A group with most of the rows, many ties, a small one, a null key and null scores."""
    rng = random.Random(5)
    rows = [(g, i, rng.randint(0, 1), round(rng.gauss(0, 1), d)) for g, n, d in (("hot", 3000, 2), ("small", 40, 1), (None, 200, 6)) for i in range(n)]
    rows += [("hot", 3000 + i, i % 2, 0.25) for i in range(1500)]
    return spark.createDataFrame(rows, "group string, id long, y int, score double").repartition(7)


@pytest.mark.parametrize("size", [1 << 16, 50])
def test_points_of_one_large_group(scored, size, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS", size)
    found = metrics.roc_points(scored).collect()
    by = collections.defaultdict(list)
    for r in scored.collect():
        by[r.group].append(r)
    got = collections.defaultdict(dict)
    for r in found:
        got[r.group][r.score] = r
    for g, rows in by.items():
        marks = sorted({r.score for r in rows}, reverse=True)
        assert sorted(got[g], reverse=True) == marks
        for k, m in enumerate(marks):
            r = got[g][m]
            assert (r.tp, r.fp) == (sum(x.y for x in rows if x.score >= m), sum(1 - x.y for x in rows if x.score >= m))
            assert (r.p, r.n, r.k, r.last, r.above) == (sum(x.y for x in rows), sum(1 - x.y for x in rows), k + 1, k == len(marks) - 1, marks[k - 1] if k else None)


def test_no_task_has_a_whole_group(spark, scored, monkeypatch):
    """The rows of the largest group are dealt out by stretches, so one key is over many partitions."""
    monkeypatch.setattr(ordered, "ROWS", 50)
    at = ordered.with_stretch(scored.groupBy("group", "score").agg(F.count("*").alias("c")), "score")
    sizes = {r[0]: r[1] for r in at.filter("group = 'hot'").groupBy("__stretch").count().collect()}
    assert len(sizes) > 8 and max(sizes.values()) < sum(sizes.values()) / 4
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would join partitions as small as these
    run = ordered.running(at, ("group",), F.col("__stretch"), [F.col("score")], {"r": F.col("c")})
    parts = run.filter("group = 'hot'").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) > 1
    edges = at.groupBy("__stretch").agg(F.min("score").alias("a"), F.max("score").alias("b")).orderBy("__stretch").collect()
    assert all(x.b < y.a for x, y in zip(edges, edges[1:], strict=False))  # equal values share a stretch, and stretches follow each other


@pytest.mark.parametrize("size", [1 << 16, 30])
def test_ranks_with_ties(spark, size, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS", size)
    rng = random.Random(2)
    rows = [(i, fi, None if rng.random() < 0.1 else 0.0 if rng.random() < 0.4 else round(rng.gauss(0, 1), 1 + fi)) for i in range(400) for fi in range(3)]
    long = spark.createDataFrame(rows, "id long, fi long, value double")
    got = {(r.id, r.fi): r.r for r in stats.average_ranks(long).collect()}
    for fi in range(3):
        own = [(v, i) for i, f, v in rows if f == fi and v is not None]
        for v, i in own:
            assert got.pop((i, fi)) == sum(w < v for w, _ in own) + (sum(w == v for w, _ in own) + 1) / 2
    assert not got


def test_draws_of_one_class(spark):
    """Folds of a class that is nearly all rows, and of null targets, differ by one row at most."""
    rows = spark.range(3000).select("id", F.when(F.col("id") < 20, 1).when(F.col("id") < 25, None).otherwise(0).alias("target"))
    found = folds.repeated_stratified_folds(rows, 7, 2)
    counts = collections.Counter((r.repeat, r.target, r.fold) for r in found.collect())
    for repeat in range(2):
        for target, n in ((1, 20), (None, 5), (0, 2975)):
            own = [counts[repeat, target, f] for f in range(7)]
            assert sum(own) == n and max(own) - min(own) <= 1
    again = folds.repeated_stratified_folds(rows.repartition(5), 7, 2)
    assert sorted(map(str, found.collect())) == sorted(map(str, again.collect()))


@pytest.mark.parametrize("passes", [1, 2, 3])
def test_quantiles_are_exact(spark, passes):
    rng = np.random.default_rng(passes)
    groups = {"normal": rng.normal(size=5000), "ties": np.repeat([0.0, 1.0, -3.5], [4000, 10, 7]), "wide": np.exp(rng.normal(0, 40, 3001)), "one": np.array([2.5]), "two": np.array([1.0, 2.0]), "eleven": np.arange(11.0), "odd": np.array([-np.inf, 0.0, 1e308])}
    rows = spark.createDataFrame([(g, float(v)) for g, own in groups.items() for v in own] + [("normal", None), ("none", None)], "g string, value double").repartition(6)
    at = [0.0, 0.025, 0.3, 0.5, 0.975, 1.0]
    got = {r.g: r.q for r in ordered.quantiles(rows, ("g",), at, passes=passes).collect()}
    assert set(got) == set(groups)
    for g, own in groups.items():
        own = np.sort(own)
        for p, q in zip(at, got[g], strict=True):
            pos = p * (len(own) - 1)
            a, b = own[int(np.floor(pos))], own[int(np.ceil(pos))]
            want = a if pos == np.floor(pos) else (1 - (pos - np.floor(pos))) * a + (pos - np.floor(pos)) * b
            assert q == pytest.approx(want, rel=1e-12, abs=1e-300), (g, p)
    assert {r.g: r.median for r in ordered.medians(rows, ("g",)).collect()}["eleven"] == 5.0


def test_quantiles_of_nothing(spark):
    rows = spark.createDataFrame([], "fi long, value double")
    assert ordered.quantiles(rows, ("fi",), [0.5]).collect() == []
    assert ordered.with_stretch(rows, "value").collect() == []
