"""Steps of an addition share the trees that do not split on what has left."""

import numpy as np

from assayloom.operators import ranking

PARAMS = {"number": 12, "k": 2, "repeats": 8, "trees": 4}


def test_steps_go_down_from_the_largest_panel(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((120, 12))
    rows = spark.createDataFrame([(i, int(v[3] + v[5] > 0), v.tolist()) for i, v in enumerate(x)], "id long, target int, x array<double>")
    importance = spark.createDataFrame([(f, float(12 - f // 2)) for f in range(12)], "fi long, importance double")  # two leave at once
    asked, plain = [], ranking.grid

    def watch(spark, shared, keys, *rest):
        asked.append(len(keys))
        return plain(spark, shared, keys, *rest)

    monkeypatch.setattr(ranking, "grid", watch)
    got = sorted(tuple(r) for r in ranking.addition_by_importance(rows, importance, **PARAMS).collect())
    assert len(got) == 12 and asked[0] < 12 * 16
    monkeypatch.setattr(ranking, "_without", lambda trees, gone: [])
    want = sorted(tuple(r) for r in ranking.addition_by_importance(rows, importance, **PARAMS).collect())
    assert np.allclose(np.array(got, float), np.array(want, float), equal_nan=True)
