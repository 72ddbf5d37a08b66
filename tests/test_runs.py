import json

import numpy as np
import pytest

from assayloom.__main__ import parse
from assayloom.config import Options, Settings, as_dict, differences, headers, parse_settings, read_settings, switched_on
from assayloom.plans.run import parameter_combinations, prepare, run, run_matrix
from assayloom.operators.compare import compare_models, first_significant
from assayloom.sources import files


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return written(tmp_path_factory.mktemp("data"), "id")


@pytest.fixture(scope="module")
def numbered(tmp_path_factory):
    """Patients with whole numbers as ids, and missing values in both sets."""
    return written(tmp_path_factory.mktemp("numbered"), "", gaps=True)


def written(home, prefix, gaps=False):
    rng = np.random.default_rng(0)
    lines = ["Unnamed: 0,patient_id,target,label," + ",".join(f"p{i}" for i in range(6))]
    for i in range(90):
        y = i % 2
        values = rng.standard_normal(6) + np.array([2.0 * y, 0, 0, 0, 0, 0])
        cells = ["" if gaps and (i * 7 + j * 3) % 11 == 0 else f"{v:.4f}" for j, v in enumerate(values)]
        lines.append(f"{i},{prefix}{1000 + i},{y},{'cancer' if y else 'control'}," + ",".join(cells))
    (home / "train.csv").write_text("\n".join(lines[:61]) + "\n")
    (home / "holdout.csv").write_text("\n".join([lines[0], *lines[61:]]) + "\n")
    (home / "cohort.csv").write_text("patient_id,plate,site\n" + "".join(f"{prefix}{1000 + i},{i % 3},s{i % 2}\n" for i in range(90)))
    return str(home)


def test_settings():
    assert parse_settings("") == Settings() == read_settings("config.toml")
    s = parse_settings("random_state = 3\n[feature_selection.addition]\nimportance_selection = 'tree_importance'\n")
    assert s.random_state == 3 and s.feature_selection.addition.importance_selection == "tree_importance"
    assert differences(as_dict(s), as_dict(Settings())) == {"feature_selection.addition.importance_selection": ("tree_importance", "shap"), "random_state": (3, 0)}
    assert headers(s) == ["stats", "feature_selection", "augmentation", "optimization"] and "scale_transform" in switched_on(s)
    with pytest.raises(ValueError, match="stats.other"):
        parse_settings("[stats]\nother = 1\n")
    for odd in ("importance_selection = 'gain'", "method = 'luck'"):
        with pytest.raises(ValueError, match="none of"):
            parse_settings(f"[feature_selection.addition]\n{odd}\n")


def test_options():
    o, config, runs = parse(["--input-path", "x", "--no-rec-feat-add", "--model", "random_forest"])
    assert o.source == "x" and o.target == "x/results" and not o.rec_feat_add and config is None and runs is None
    assert parse(["--runs", "r.csv"]) == (None, None, "r.csv")
    assert Options(s3_bucket="b", s3_input_path="k").source == "s3a://b/k"
    for bad in ({}, {"input_path": "x", "s3_bucket": "b", "s3_input_path": "k"}, {"input_path": "x", "model": "other"}):
        with pytest.raises(ValueError):
            Options(**bad)


def test_sources(spark, folder, tmp_path):
    data = files.extract(spark, folder)
    assert data.train.count() == 60 and "Unnamed: 0" not in data.train.columns and data.cohort.columns == ["patient_id", "plate", "site"]
    with pytest.raises(FileNotFoundError):
        files.extract(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        files.list_files(spark, f"{folder}/*.xyz")
    assert files.read_or_fallback(spark, f"{folder}/other.csv", "m") is None
    (tmp_path / "m_rfe_important_features_gbt.csv").write_text("a,b\n1,2\n")
    (tmp_path / "m_x.txt").write_text("a\tc\n3\t4\n")
    assert files.read_or_fallback(spark, f"{tmp_path}/x.txt", "m").columns == ["a", "c"]
    both = files.read_folder(spark, f"{tmp_path}/m_*", ("m_",))
    assert sorted(both.columns) == ["a", "b", "c", "source"] and both.count() == 2
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "er" / "m_z.csv").write_text("a,d\n5,6\n")
    assert files.read_folder(spark, f"{tmp_path}/deep", ("m_",), recursive=True).select("a", "d").collect() == [(5, 6)]
    assert [r.model for r in files.read_results(spark, [f"{tmp_path}/m_rfe_important_features_gbt.csv"]).collect()] == ["gbt"]


QUICK = """
[feature_selection]
cross_validation_repeats = 1
number_of_features = 3
multisurf_cross_validation_splits = 3
[feature_selection.addition]
importance_selection = "tree_importance"
[optimization.optuna]
trials = 3
after_rfa = false
"""


def one_panel(monkeypatch):
    from assayloom.plans import run as plan

    every = plan.panels
    monkeypatch.setattr(plan, "panels", lambda *a: {"mean_mcc": every(*a)["mean_mcc"]})  # one panel is enough here


def test_a_run_from_files_to_panels(spark, folder, tmp_path, monkeypatch):
    one_panel(monkeypatch)
    options = Options(input_path=folder, output_path=str(tmp_path / "out"), use_batch_corrected=True)
    tables = run(spark, options, parse_settings(QUICK), "t", {"trees": 8}, boots=20, ci_repeats=1)
    assert tables["result"].orderBy("rank").first().feature == "p0"
    stored = spark.read.parquet(str(tmp_path / "out" / "t_result.parquet"))
    assert stored.count() == tables["result"].count()
    note = spark.read.json(str(tmp_path / "out" / "t_metadata.json")).first()
    assert json.loads(note.settings)["feature_selection"]["number_of_features"] == 3
    read = lambda name: spark.read.parquet(str(tmp_path / "out" / f"t_mean_mcc_{name}.parquet"))
    assert read("holdout_metrics").first().roc_auc > 0.7
    at = [{r.name: r.threshold for r in read(f"{s}_metrics").collect()} for s in ("semi_holdout", "holdout")]
    assert at[0] == at[1]  # the holdout is judged at the thresholds found before
    wrong = read("holdout_report").filter("row = 'misclassified'").collect()
    assert all(r.patient_id.startswith("id") and r.label in ("cancer", "control") for r in wrong)
    assert read("holdout_report").filter("row = 'metrics'").count() == read("holdout_metrics").count()
    full, one, zero = (read(f"holdout_shap_{c}") for c in ("full", "class_1", "class_0"))
    assert full.count() == one.count() + zero.count() > 0 and read("holdout_shap_mean").count() == full.select("fi").distinct().count()
    assert read("semi_holdout_cv_ci").count() == 5
    # The stored model gives the stored scores: the rows it gets wrong are those of the report.
    forest = files.read_forest(spark, str(tmp_path / "out" / "t_mean_mcc_holdout_model.parquet"))
    assert len(forest.trees) == 8 and forest.logit
    semi = spark.read.parquet(str(tmp_path / "out" / "t_mean_mcc_semi_holdout_shap_full.parquet")).select("id").distinct().count()
    assert semi == 30  # as large a share of the training rows as the holdout has rows, up to a half


def test_a_run_with_numbers_as_ids_and_missing_values(spark, numbered, tmp_path, monkeypatch):
    one_panel(monkeypatch)
    loaded = files.load(spark, Options(input_path=numbered), Settings())
    assert sorted(r.patient_id for r in loaded.holdout.collect()) == list(range(1060, 1090))
    from assayloom.plans.run import frames

    assert frames(loaded).features == [f"p{i}" for i in range(6)]
    for model in ("xgboost", "random_forest"):
        options = Options(input_path=numbered, output_path=str(tmp_path / model), model=model, dry_run=True)
        tables = run(spark, options, parse_settings(QUICK), "n", {"trees": 8}, boots=10, ci_repeats=1)
        assert {r.feature for r in tables["result"].collect()} <= {f"p{i}" for i in range(6)}
        first = [r.feature for r in tables["result"].orderBy("rank").collect()]
        assert "p0" in first[: 1 if model == "xgboost" else 2]


@pytest.mark.parametrize("kind", ["shap", "eject_shap", "mutual_information", "permutation_importance"])
def test_every_importance_puts_the_feature_that_counts_first(spark, folder, kind):
    from assayloom.operators import ranking
    from assayloom.plans.run import frames, narrowed

    rows = narrowed(frames(files.extract(spark, folder)).train, list(range(6)))
    got = ranking.importance_by(rows, kind, k=2, repeats=1, trees=8) if kind != "mutual_information" else ranking.importance_by(rows, kind)
    assert got.columns == ["fi", "importance"] and ranking.ranks(got).orderBy("rank").first().fi == 0
    with pytest.raises(ValueError, match="no such importance"):
        ranking.importance_by(rows, "gain")


def test_a_run_with_searches_and_new_rows(spark, folder, tmp_path, monkeypatch):
    one_panel(monkeypatch)
    text = QUICK.replace("after_rfa = false", "after_rfa = true\nbefore_validation = true").replace("trials = 3", "trials = 2")
    options = Options(input_path=folder, output_path=str(tmp_path / "out"), model="random_forest", augmentation="smote_balanced", dry_run=True)
    tables = run(spark, options, parse_settings(text), "s", {"trees": 8}, boots=10, ci_repeats=1)
    assert {"trials_after_rfa", "trials_mean_mcc_holdout", "trials_mean_mcc_semi_holdout", "result_before_search"} <= set(tables)
    assert tables["trials_after_rfa"].count() == 2
    new = tables["augmented_mean_mcc_semi_holdout"].filter("id < 0").collect()
    assert sorted(r.patient_id for r in new) == sorted(f"AUG{i}" for i in range(len(new))) and all(r.label == r.patient_id for r in new)
    report = {r.stage: r for r in tables["classes_cv"].collect()}
    assert report["before"].total == 60 and report["after"].positive == report["after"].negative


def test_the_grid_of_preprocessing():
    assert [len(parameter_combinations(s)) for s in ("mar", "mnar", "mixed")] == [15, 6, 450]
    for s in ("mar", "mnar", "mixed"):
        assert len({repr(c) for c in parameter_combinations(s)}) == len(parameter_combinations(s))
    assert {c["mar"]["k"] for c in parameter_combinations("mar") if c["mar"]["method"] == "knn"} == {4, 5, 6, 7, 8}
    assert {c["scaler"] for c in parameter_combinations("mixed")} == {"none", "min_max", "median", "log2", "quantile"}


def test_preprocessing_search(spark, numbered):
    from assayloom.plans.run import frames

    long = frames(files.extract(spark, numbered)).train
    some = [{"scaler": s, "mnar": None, "mar": m} for s, m in (("none", {"method": "mean"}), ("min_max", {"method": "mice", "estimator": "linear"}), ("log2", {"method": "knn", "k": 4, "weights": "distance"}))]
    best = prepare(spark, long, "mar", combinations=some, trees=5)
    assert best.count() == 3
    with pytest.raises(ValueError, match="no such scaler"):
        prepare(spark, long, "mar", combinations=[{"scaler": "other", "mnar": None, "mar": None}], trees=5)


def test_a_log_is_written_where_the_results_go(spark, tmp_path, monkeypatch, caplog):
    import logging

    from assayloom import __main__ as command

    def go(spark, options, settings, name):
        logging.getLogger("x").warning("a step")
        if options.model == "random_forest":
            raise RuntimeError("it broke")

    monkeypatch.setattr(command, "run", go)
    caplog.set_level(logging.INFO)
    for model in ("xgboost", "random_forest"):
        at = tmp_path / model
        argv = ["--input-path", "x", "--output-path", str(at), "--model", model]
        if model == "xgboost":
            command.main(argv)
        else:
            with pytest.raises(RuntimeError):
                command.main(argv)
        lines = [r.value for r in spark.read.text(str(next(at.glob("*_log.txt")))).collect()]
        assert any("WARNING a step" in line for line in lines)
        assert any(("done" if model == "xgboost" else "it broke") in line for line in lines)


def test_a_matrix_of_runs(spark, tmp_path):
    rows = spark.createDataFrame([("a", None, 5), (None, None, None), (None, "b", 1), ("c", None, 7)], "`cli_input-path` string, `cli_s3-bucket` string, config_random_state int")
    seen = []
    names = run_matrix(spark, rows, Settings(), lambda s, o, c, name: seen.append((o.source, c.random_state)))
    assert len(names) == 2 and sorted(seen) == [("a", 5), ("c", 7)]
    (tmp_path / "runs.csv").write_text("cli_input-path,cli_dry-run,config_random_state,config_number_of_features,config_scale_transform\nx,true,3,12,false\n,,,,\ny,,,,\n")
    seen.clear()
    run_matrix(spark, files.read_runs(spark, str(tmp_path / "runs.csv")), Settings(), lambda s, o, c, name: seen.append((o.input_path, o.dry_run, c.random_state, c.feature_selection.number_of_features, c.scale_transform)))
    assert sorted(seen) == [("x", True, 3, 12, False), ("y", False, 0, 30, True)]
    with pytest.raises(ValueError, match="unknown setting"):
        run_matrix(spark, spark.createDataFrame([("a", "1")], "`cli_input-path` string, config_other string"), Settings(), lambda *a: None)


def test_models_compared(spark):
    rows = spark.createDataFrame([("m", 0.2, 3, {"x": {"features_importances": 0.9}}), ("m", 0.01, 2, {"x": {"features_importances": 0.4}}), ("n", 0.03, 1, {"y": {"features_importances": 0.6}})], "model string, p_value_mcc double, n_features_to_select int, features_chosen map<string,map<string,double>>")
    got = compare_models(first_significant(rows)).collect()
    assert [(r.feature, r.m, r.n, r.average) for r in got] == [("y", 0.0, 0.6, 0.3), ("x", 0.4, 0.0, 0.2)]
