"""Nearest rows in several blocks against all distances."""

import numpy as np
import pytest

from assayloom.operators import neighbours


def table(spark, x, first=0):
    rows = [(first + i, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, x array<double>").repartition(5)


def best(d, ids, k):
    order = sorted((round(float(v), 12), int(i)) for v, i in zip(d, ids, strict=True) if not np.isnan(v))
    return order[:k]


def one_pair(metric, a, b):
    """The distance of two rows, a coordinate at a time; None where the metric is tested elsewhere."""
    pairs = list(zip(a.tolist(), b.tolist(), strict=True))
    both, one = sum(x != 0 and y != 0 for x, y in pairs), sum((x != 0) != (y != 0) for x, y in pairs)
    n, over = len(pairs), lambda x, y: x / y if y else 0.0
    return {
        "euclidean": sum((x - y) ** 2 for x, y in pairs) ** 0.5,
        "manhattan": sum(abs(x - y) for x, y in pairs),
        "chebyshev": max(abs(x - y) for x, y in pairs),
        "sqeuclidean": sum((x - y) ** 2 for x, y in pairs),
        "minkowski": sum(abs(x - y) ** 3 for x, y in pairs) ** (1 / 3),
        "canberra": sum(over(abs(x - y), abs(x) + abs(y)) for x, y in pairs),
        "braycurtis": over(sum(abs(x - y) for x, y in pairs), sum(abs(x + y) for x, y in pairs)) if any(x + y for x, y in pairs) else None,
        "hamming": sum(x != y for x, y in pairs) / n,
        "jaccard": over(one, both + one),
        "dice": over(one, 2 * both + one),
        "rogerstanimoto": 2 * one / (n + one),
        "sokalsneath": over(2 * one, both + 2 * one),
        "russellrao": (n - both) / n,
    }.get(metric)


def sparse(n=240):
    """Whole numbers, mostly 0, in groups that share most of their features; some rows are 0 throughout."""
    rng = np.random.default_rng(8)
    x = (rng.random((8, 12)) < 0.4)[rng.integers(0, 8, n)] ^ (rng.random((n, 12)) < 0.05)
    x = x * rng.integers(-3, 4, (n, 12)).astype(float)
    x[5:8] = 0
    return x


@pytest.mark.parametrize("metric", sorted(set(neighbours.METRICS) - {"masked_euclidean", "cosine", "correlation"}))
def test_distances_pair_by_pair(spark, metric, monkeypatch):
    x = sparse()
    d = neighbours.distances(x[:40], x[:40], metric)
    for i in range(40):
        for j in range(40):
            want = one_pair(metric, x[i], x[j])
            assert np.isnan(d[i, j]) if want is None else abs(d[i, j] - want) < 1e-9
    if metric in neighbours.SETS or metric in ("canberra", "braycurtis", "hamming"):  # their bounds need rows with zeros
        monkeypatch.setattr(neighbours, "OTHERS", 20)
        got = {(r.id, r.rank): r.nid for r in neighbours.nearest(table(spark, x), 3, metric=metric).collect()}
        whole = neighbours.distances(x, x, metric)
        np.fill_diagonal(whole, np.nan)
        assert got == {(i, k + 1): n for i in range(len(x)) for k, (_, n) in enumerate(best(whole[i], np.arange(len(x)), 3))}


@pytest.fixture
def clustered():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 20, (6, 5))
    x = centres[rng.integers(0, 6, 300)] + rng.normal(0, 0.5, (300, 5))
    x[50:60] = x[40]  # rows that are equal
    return x


@pytest.mark.parametrize("metric", sorted(neighbours.METRICS))
@pytest.mark.parametrize("size", [2048, 20])
def test_nearest(spark, clustered, metric, size, monkeypatch):
    monkeypatch.setattr(neighbours, "OTHERS", size)
    got = {}
    for r in neighbours.nearest(table(spark, clustered), 4, metric=metric).collect():
        got.setdefault(r.id, {})[r.rank] = (round(r.distance, 9), r.nid)
    d = neighbours.distances(clustered, clustered, metric)
    np.fill_diagonal(d, np.nan)
    for i in range(len(d)):
        want = best(d[i], np.arange(len(d)), 4)
        assert [v for v, _ in (got[i][k + 1] for k in range(4))] == pytest.approx([v for v, _ in want], abs=1e-8)
        if want[3][0] > want[2][0] + 1e-6 and len({round(v, 6) for v, _ in want}) == 4:
            assert [n for _, n in (got[i][k + 1] for k in range(4))] == [n for _, n in want]


@pytest.mark.parametrize("size", [2048, 25])
def test_nearest_that_have_a_feature(spark, clustered, size, monkeypatch):
    """Gaps in a tenth of the cells, a feature that nobody has and one that two rows have."""
    monkeypatch.setattr(neighbours, "OTHERS", size)
    rng = np.random.default_rng(4)
    x = np.where(rng.random(clustered.shape) < 0.1, np.nan, clustered)
    x = np.concatenate([x, np.full((300, 1), np.nan), np.full((300, 1), np.nan)], axis=1)
    x[7, 6], x[200, 6] = 1.5, -2.0
    got = {}
    for r in neighbours.nearest_having(table(spark, x), 3).collect():
        got.setdefault((r.id, r.fi), []).append((round(r.distance, 9), r.value))
    d = neighbours.masked_distances(x, x)
    np.fill_diagonal(d, np.nan)
    for i, j in zip(*np.nonzero(np.isnan(x)), strict=True):
        have = np.flatnonzero(~np.isnan(x[:, j]))
        want = best(d[i, have], have, 3)
        mine = sorted(got.get((i, j), []))
        assert [v for v, _ in mine] == pytest.approx([v for v, _ in want], abs=1e-8)
        if len({round(v, 6) for v, _ in want}) == len(want) == 3:
            assert sorted(v for _, v in mine)[:1] == pytest.approx(sorted(x[n, j] for _, n in want)[:1]) or best(d[i, have], have, 4)[3][0] <= want[2][0] + 1e-9


def test_other_candidates(spark, clustered, monkeypatch):
    monkeypatch.setattr(neighbours, "OTHERS", 30)
    got = {(r.id, r.rank): r.nid for r in neighbours.nearest(table(spark, clustered[:20] + 0.01), 2, table(spark, clustered[100:], 1000)).collect()}
    d = neighbours.masked_distances(clustered[:20] + 0.01, clustered[100:])
    for i in range(20):
        assert [got[i, 1], got[i, 2]] == [n for _, n in best(d[i], np.arange(1000, 1200), 2)]


def test_bounds_hold_and_prune(clustered):
    """No row is nearer than its block's bound, and clusters apart are not asked."""
    rng = np.random.default_rng(9)
    for metric in neighbours.METRICS:
        x = np.where(rng.random(clustered.shape) < 0.15, np.nan, clustered) if metric == "masked_euclidean" else clustered
        parts = np.array_split(np.argsort(clustered[:, 0]), 10)
        spread = neighbours._spread(x, metric)
        low, high = (np.array([np.where(np.isnan(spread[p]), fill, spread[p]).__getattribute__(f)(axis=0) for p in parts]) for fill, f in ((np.inf, "min"), (-np.inf, "max")))
        least = np.array([(~np.isnan(spread[p])).sum(axis=1).min() for p in parts])
        bounds = neighbours._Summaries(np.arange(10), low, high, least, least).bounds(x[:50], metric)
        for b, p in enumerate(parts):
            d = neighbours.distances(x[:50], x[p], metric)
            assert (np.where(np.isnan(d), np.inf, d).min(axis=1) >= bounds[:, b] - 1e-7).all()


@pytest.mark.parametrize("n", [400, 1600])
def test_rows_sent_grow_with_the_rows(spark, n, monkeypatch):
    """Four times the clusters: a row still meets a few blocks, whatever their number."""
    monkeypatch.setattr(neighbours, "OTHERS", 40)
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(0, 50, (n // 40, 8)), 40, axis=0) + rng.normal(0, 0.1, (n, 8))
    asked = []
    real = neighbours.met_in_blocks
    monkeypatch.setattr(neighbours, "met_in_blocks", lambda rows, *a: (asked.append(rows.count()), real(rows, *a))[1])
    found = neighbours.nearest(table(spark, x), 3)
    assert found.count() == 3 * n
    assert asked[0] == n and asked[1] <= 4 * n


def test_no_candidates(spark):
    none = spark.createDataFrame([], "id long, x array<double>")
    assert neighbours.nearest(none, 3).collect() == []
    assert neighbours.nearest(table(spark, np.ones((3, 2))), 3, none).collect() == []
    assert len(neighbours.nearest(table(spark, np.ones((1, 2))), 3).collect()) == 0


@pytest.mark.parametrize("spread", [0.1, 1.0])
def test_all_meet_all_in_large_blocks(spark, spread, monkeypatch):
    """Rows that no block can be ruled out for: each travels as often as there are blocks of candidates, and single precision loses none."""
    monkeypatch.setattr(neighbours, "OTHERS", 20)
    monkeypatch.setattr(neighbours, "DENSE", 200)
    monkeypatch.setattr(neighbours, "WIDE", 50)
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.standard_normal((380, 12)), 100 + spread * rng.standard_normal((20, 12))])
    x[20:30] = x[10]
    asked, real = [], neighbours.met_in_blocks
    monkeypatch.setattr(neighbours, "met_in_blocks", lambda rows, *a: (asked.append(rows.count()), real(rows, *a))[1])
    got = {}
    for r in neighbours.nearest(table(spark, x), 4).collect():
        got.setdefault(r.id, {})[r.rank] = (round(r.distance, 9), r.nid)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.nan)
    for i in range(len(d)):
        assert [n for _, n in (got[i][k + 1] for k in range(4))] == [n for _, n in best(d[i], np.arange(len(d)), 4)]
    assert asked == [2 * len(x)]  # 20 blocks were asked one by one
    gone = np.where(rng.random(x.shape) < 0.1, np.nan, x)
    gone[:, 3] = np.nan
    gone[[7, 200], 3] = 1.5, -2.0
    near = {}
    for r in neighbours.nearest_having(table(spark, gone), 3).collect():
        near.setdefault((r.id, r.fi), []).append(r.distance)
    d = neighbours.masked_distances(gone, gone)
    np.fill_diagonal(d, np.nan)
    for i, j in zip(*np.nonzero(np.isnan(gone)), strict=True):
        have = np.flatnonzero(~np.isnan(gone[:, j]))
        assert sorted(near.get((i, j), [])) == pytest.approx([v for v, _ in best(d[i, have], have, 3)], abs=1e-6)


def test_a_sieve_loses_nothing(monkeypatch):
    monkeypatch.setattr(neighbours, "WIDE", 64)
    rng = np.random.default_rng(2)
    for x in (rng.standard_normal((3000, 9)) + 1000, rng.integers(0, 2, (3000, 9)).astype(float), rng.normal(0, 1e6, (3000, 9))):
        ids = rng.permutation(3000)
        row, place, d = neighbours._near(neighbours._Sieve(x), ids[:40], x[:40], ids, 6)
        far = np.sqrt(((x[:40, None] - x[None]) ** 2).sum(axis=2))
        far[np.arange(40), np.arange(40)] = np.nan
        for i in range(40):
            assert [ids[p] for p in place[row == i][np.lexsort((ids[place[row == i]], np.round(d[row == i], 12)))]] == [n for _, n in best(far[i], ids, 6)]
