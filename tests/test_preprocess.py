"""Stored preprocessing and the search over many: what one pipeline gives by itself is what the search gives, and what a row gets depends
on the training rows alone."""

import numpy as np
import pytest

from assayloom.config import Options, parse_settings
from assayloom.operators.preprocess import Imputer, Scaler, completed_cells, pipeline, pipeline_name
from assayloom.plans.run import parameter_combinations, performance, prepare_and_store, run, stored_pipeline
from assayloom.sources.files import read_model
from assayloom.sources.sinks import parameter_table

from .test_runs import QUICK, numbered, one_panel  # noqa: F401

PARTS = [("none", None), ("min_max", {"method": "qrilc", "tune_sigma": 0.5}), ("quantile", {"method": "minprob", "quantile_percent": 0.1, "tune_sigma": 1.0}), ("median", None), ("log2", None)]
LAST = [{"method": "mean"}, {"method": "knn", "k": 4, "weights": "distance"}, {"method": "knn", "k": 6, "weights": "uniform"}, {"method": "mice", "estimator": "linear"}, {"method": "miss_forest"}, None]


@pytest.fixture(scope="module")
def split(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        x = np.exp(rng.standard_normal(7) + (i % 2) * np.arange(7) / 6)
        for j in range(7):
            gone = rng.random() < (0.5 if j == 2 and i % 2 else 0.12)
            rows.append((i, i % 2, i % 10 < 2, j, None if gone else float(x[j])))
    return spark.createDataFrame(rows, "id long, target int, test boolean, fi long, value double").persist()


@pytest.mark.parametrize("strategy", ["mnar", "mixed"])
def test_the_search_gives_what_each_pipeline_gives(spark, split, strategy):
    some = [{"scaler": s, "mnar": a, "mar": b} for s, a in PARTS for b in LAST]
    got = {}
    for r in completed_cells(split, some, strategy).collect():
        got.setdefault(r.pipeline, {})[r.id, r.place] = r.value
    assert set(got) == {pipeline_name(c) for c in some}
    for c in [some[i] for i in (1, 5, 9, 10, 14, 18, 25)]:
        model = pipeline(c, strategy).fit(split.filter("not test").select("id", "target", "fi", "value"))
        want = {(r.id, r.fi): r.value for r in model.transform(split.select("id", "target", "fi", "value")).collect()}
        own = got[pipeline_name(c)]
        assert want.keys() == own.keys()
        for k, v in want.items():
            assert (v is None) == (own[k] is None) and (v is None or own[k] == pytest.approx(v, abs=1e-9)), (c, k)


@pytest.mark.parametrize("last", [*LAST[:2], *LAST[3:5], {"method": "mode"}])
def test_a_row_depends_on_the_training_rows_alone(spark, split, tmp_path, last):
    fitted = pipeline({"scaler": "median", "mnar": {"method": "minprob", "tune_sigma": 0.5}, "mar": last}, "mixed", [f"p{j}" for j in range(7)]).fit(split.filter("not test").select("id", "target", "fi", "value"))
    fitted.write().save(str(tmp_path / "m"))
    model = read_model(str(tmp_path / "m"))
    assert [s.uid for s in model.stages] == [s.uid for s in fitted.stages] and [s.options for s in model.stages] == [s.options for s in fitted.stages]
    rows = split.filter("test").select("id", "target", "fi", "value")
    read = lambda df: {(r.id, r.fi): r.value for r in df.collect()}
    every, alone = read(model.transform(rows)), read(model.transform(rows.filter("id = 11")))
    assert len(alone) == 7 and alone == pytest.approx({k: v for k, v in every.items() if k[0] == 11}) and every == pytest.approx(read(fitted.transform(rows)))
    assert all(v is not None for v in every.values())
    assert model.transform(rows.filter("false")).count() == 0
    table = {(r.stage, r.param): r.value for r in parameter_table(spark, model).collect()}
    assert table[model.stages[1].uid, "method"] == "minprob" and table[model.stages[0].uid, "method"] == "median"
    with pytest.raises(ValueError, match="other features"):
        stored_pipeline(str(tmp_path / "m"), ["a", "b"])


@pytest.mark.parametrize(("method", "how"), [("standard", "{}"), ("top_l", '{"l": 3}')])
def test_scalers_agree_with_their_functions(spark, split, method, how):
    from assayloom.operators import normalize

    rows = split.select("id", "fi", "value")
    want = normalize.standardise(rows, rows) if method == "standard" else normalize.top_l(rows, 3)
    got = Scaler(method=method, how=how).fit(rows).transform(rows)
    read = lambda df: {(r.id, r.fi): r.value for r in df.collect()}
    a, b = read(got), read(want)
    assert a.keys() == b.keys() and all((a[k] is None) == (b[k] is None) and (a[k] is None or a[k] == pytest.approx(b[k])) for k in a)


def test_odd_steps_raise(split):
    for stage, text in ((Scaler(method="other"), "no such scaler"), (Scaler(method="log2", how='{"l": 3}'), "takes no l"), (Imputer(method="other"), "no such method"), (Imputer(method="knn", how='{"p": 3}'), "takes no p")):
        with pytest.raises(ValueError, match=text):
            stage.fit(split)


def test_jobs_do_not_grow_with_the_pipelines(spark, split):
    def jobs(combinations, group):
        spark.sparkContext.setJobGroup(group, group)
        try:
            completed_cells(split, combinations).write.format("noop").mode("overwrite").save()
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    every = [{"scaler": s, "mnar": None, "mar": m} for s in ("none", "min_max") for m in (LAST[0], *({"method": "knn", "k": k, "weights": w} for k in range(2, 9) for w in ("uniform", "distance")))]
    few = [every[0], every[15]]
    assert abs(jobs(every, "many") - jobs(few, "few")) <= 2  # the adaptive plan may differ by a broadcast


def test_all_450_are_scored_at_once(spark, split):
    cells = split.select("id", "target", "fi", "value")
    quick = [c for c in parameter_combinations("mixed") if c["mar"]["method"] in ("knn", "mean") or c["mar"].get("estimator") == "linear"]
    scores = performance(cells, "mixed", combinations=quick, trees=3)
    names = [r.pipeline for r in scores.select("pipeline").collect()]
    assert len(names) == len(set(names)) == len(quick) == 360


def test_a_run_with_a_stored_pipeline(spark, numbered, tmp_path, monkeypatch):  # noqa: F811
    one_panel(monkeypatch)
    some = [{"scaler": s, "mnar": None, "mar": m} for s in ("none", "min_max") for m in ({"method": "mean"},)]
    options = Options(input_path=numbered, output_path=str(tmp_path / "out"))
    paths = prepare_and_store(spark, options, parse_settings(QUICK), "p", some, trees=5)
    assert sum(p.endswith(".model") for p in paths) == 2
    again = Options(input_path=numbered, output_path=str(tmp_path / "run"), best_pipeline=str(tmp_path / "out" / "p_best_pipeline_1.model"), dry_run=True)
    tables = run(spark, again, parse_settings(QUICK), "r", {"trees": 4}, boots=10, ci_repeats=1)
    assert {r.param for r in tables["preprocessing"].collect()} == {"method", "how", "strategy", "features"}
    assert "p0" in {r.feature for r in tables["result"].collect()}
