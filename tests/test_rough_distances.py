"""Single precision passes on all that may be among the nearest, and few more."""

import numpy as np
import pytest

from assayloom.operators import neighbours

RNG = np.random.default_rng(0)
TABLES = {
    "normal": RNG.standard_normal((5000, 24)), "whole": RNG.integers(-2, 3, (5000, 6)).astype(float), "twice": RNG.standard_normal((2500, 8)).repeat(2, 0), "positive": RNG.random((5000, 12)),
    "wide": RNG.standard_normal((5000, 8)) * 10.0 ** RNG.integers(-6, 6, (5000, 8)),
}


@pytest.mark.parametrize("metric", ["canberra", "minkowski", "braycurtis"])
@pytest.mark.parametrize("name", sorted(TABLES))
def test_as_in_doubles(metric, name):
    x, ids = TABLES[name], np.random.default_rng(1).permutation(5000)
    row, place = neighbours._smallest(d := neighbours._apart(ids[:100], x[:100], ids, x, metric), ids, 3)
    found = neighbours._roughly(ids[:100], x[:100], ids, x, 3, metric)
    assert found is not None or name == "wide"
    if found:
        assert sorted(zip(found[0], ids[found[1]], np.round(found[2], 12), strict=True)) == sorted(zip(row, ids[place], np.round(d[row, place], 12), strict=True))


def test_where_it_tells_too_little():
    x, ids = RNG.standard_normal((50, 6))[RNG.integers(0, 50, 5000)], np.arange(5000)
    assert neighbours._roughly(ids[:100], x[:100], ids, x + 1e-9 * RNG.standard_normal(x.shape), 3, "canberra") is None
    assert neighbours._roughly(ids[:100], np.where(x[:100] > 1, np.nan, x[:100]), ids, x, 3, "minkowski") is None


def test_many_equal_distances_go_by_id():
    d, ids = np.round(RNG.random((40, 9000)) * 4) / 4, np.random.default_rng(2).permutation(9000)
    row, place = neighbours._smallest(d, ids, 5)
    assert list(zip(row, ids[place], strict=True)) == [(r, i) for r in range(40) for i in ids[np.lexsort((ids, d[r]))[:5]]]
