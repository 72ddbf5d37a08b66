"""The three ways to run: feature selection, preprocessing search, and a matrix of runs."""

from __future__ import annotations

import itertools
import json
import logging
from dataclasses import dataclass, fields, is_dataclass, replace

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.config import Options, Selection, Settings
from assayloom.matrix import array_from_long, long_from_wide, numeric_columns
from assayloom.operators import batch, folds, impute, information, metrics, ranking, resample, selection, stats
from assayloom.operators.forest import learner
from assayloom.operators.preprocess import best_of, over_pipelines, pipeline, pipeline_name
from assayloom.runtime import kept
from assayloom.sources.files import Extracted, exists, load, read_model
from assayloom.sources.sinks import parameter_table, save

log = logging.getLogger(__name__)

#: Most cells that the driver's fits take at once; the matrices of such studies have far fewer.
MOST_CELLS = 50_000_000
KEYS = ("id", "patient_id", "target", "label")


@dataclass
class Frames:
    """Long forms of both sets, with a numeric id a patient and the feature names by place."""

    train: DataFrame
    holdout: DataFrame
    features: list[str]


def frames(data: Extracted) -> Frames:
    """Ids, labels and batches of whatever type are carried along and are no features."""
    features = numeric_columns(data.train)
    if data.train.count() * len(features) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells; select features first")

    def one(df: DataFrame) -> DataFrame:
        rows = df.withColumn("id", F.abs(F.xxhash64(F.col("patient_id").cast("string")))).withColumn("target", F.col("target").cast("int"))
        return long_from_wide(rows if "label" in rows.columns else rows.withColumn("label", F.lit(None).cast("string")), features, list(KEYS))

    return Frames(one(data.train), one(data.holdout), features)


def chosen_features(long: DataFrame, options: Options, s: Selection, seed: int) -> list[int]:
    """The places of the features that the filter keeps, in source order."""
    if options.feature_selection == "multisurf":
        kept = selection.relief_filter(long, s.multisurf_cross_validation_splits, seed=seed)
    elif options.feature_selection in ("boruta", "univariate"):
        kept = selection.select_features(long, options.feature_selection, s.number_of_features, seed)
    else:
        kept = selection.select_features(long, s.number_of_mi_features, s.number_of_features, seed)
    return sorted(r[0] for r in kept.select("fi").collect())


def narrowed(long: DataFrame, keep: list[int], missing: bool = False) -> DataFrame:
    """(id, patient_id, target, label, x) with the features at the places ``keep``; missing values are 0 unless ``missing`` leaves them."""
    rows = long.filter(F.col("fi").isin(keep))
    keys = [k for k in KEYS if k in long.columns]
    return array_from_long(rows if missing else rows.withColumn("value", F.coalesce("value", F.lit(0.0))), keys)


def panels(result: DataFrame, n: int, alpha: float) -> dict[str, list[int]]:
    """Feature places (in the narrowed frame) by panel: up to the best of three metrics, and the panels found by t-test below the best of two."""
    out = {m: [r[0] for r in selection.best_prefix(result, m).orderBy("rank").select("fi").collect()] for m in ("mean_roc_auc", "mean_mcc", "stab_mcc")}
    for m in ("roc_auc", "mcc"):
        tested = stats.t_from_summary_p(result, m, n)
        found = [r[0] for r in selection.panel_below_best(tested, m, alpha).orderBy("rank").select("fi").collect()]
        if found:
            out[f"{m}_ttest"] = found
    return out


class _Run:
    """What the steps of one feature-selection run share."""

    def __init__(self, options: Options, settings: Settings, params: dict, boots: int, ci_repeats: int):
        self.options, self.settings, self.params, self.boots, self.ci_repeats = options, settings, params, boots, ci_repeats
        self.seed, self.model, self.selection = settings.random_state, options.model, settings.feature_selection
        self.k, self.repeats = self.selection.cross_validation_splits, self.selection.cross_validation_repeats
        self.tables: dict[str, DataFrame] = {}

    def augmented(self, rows: DataFrame, step: str) -> DataFrame:
        """The rows to learn from at a step, and the tables that say what was added."""
        if self.options.augmentation == "none":
            return rows
        smote = self.settings.augmentation.smote
        out = resample.augment(rows, self.options.augmentation, smote.new_cancer_ratio, smote.new_total_samples, self.seed).persist()
        self.tables[f"augmented_{step}"] = resample.name_new(out, rows)
        self.tables[f"classes_{step}"] = resample.class_report(rows, out)
        return out

    def searched(self, rows: DataFrame, optimise: bool, name: str) -> dict:
        """The learner's parameters: those given, and where a search is asked for those of its best trial."""
        if not optimise:
            return self.params
        search = self.settings.optimization.optuna
        scorers = (search.scorer,) if isinstance(search.scorer, str) else search.scorer
        trials = ranking.search(rows, self.model, search.trials, scorers, self.k, self.repeats, self.seed).persist()
        self.tables[f"trials_{name}"] = trials
        return self.params | json.loads(trials.filter("best").first()["params"])

    def ranked(self, rows: DataFrame, params: dict, width: int) -> DataFrame:
        """A row a panel: rank, the feature that it adds and its importance, and the scores over the folds."""
        s, seed = self.selection, self.seed
        if self.options.rec_feat_add and s.addition.method == "feature_importance":
            importance = ranking.importance_by(rows, s.addition.importance_selection, self.model, self.k, self.repeats, seed, **params).persist()
            scored = ranking.addition_by_importance(rows, importance, s.number_of_features, self.model, self.k, self.repeats, seed, **params)
            return scored.join(F.broadcast(importance), "fi")  # a row a feature
        if self.options.rec_feat_add:
            scored = ranking.addition_by_performance(rows, s.number_of_features, self.model, self.k, self.repeats, seed, **params)
            return scored.withColumn("stab_mcc", F.try_divide("mean_mcc", "std_mcc"))
        scored, kept = ranking.elimination(rows, min(40, width), self.model, s.multisurf_cross_validation_splits, seed=seed, **params)
        counts = kept.groupBy("fi").agg(F.sum("count").alias("times"), F.avg("importance").alias("importance"))
        order = ranking.ranks(counts.withColumn("importance", F.col("times") + F.col("importance"))).select("rank", "fi", "importance")
        return ranking.rank_summary(scored).join(F.broadcast(order), "rank")

    def evaluated(self, name: str, panel: list[int], train: DataFrame, held: DataFrame, share: float) -> None:
        """A panel fitted on part of the training rows and tested on the others, then fitted on all and tested on the holdout, at the
        thresholds found on the former; its tables."""
        model, seed = self.model, self.seed
        part = folds.stratified_split(train, share, seed, "label")
        at = None
        for split, (fit, test) in {"semi_holdout": (part.filter("not test"), part.filter("test")), "holdout": (train, held)}.items():
            fit, test = (ranking.with_panel(x.select(*KEYS, "x"), panel) for x in (fit, test))
            learn = self.augmented(fit, f"{name}_{split}")
            params = self.searched(learn, self.settings.optimization.optuna.before_validation, f"{name}_{split}")
            forest = ranking.fitted(learn, model, None, seed, **params)
            scored = ranking.scored_by(forest, test).persist()
            points = metrics.roc_points(scored)
            at = metrics.thresholds(points).persist() if at is None else at
            scores = metrics.metrics_at(scored, at).join(F.broadcast(at.select("group", "name", "threshold")), ["group", "name"])  # seven rows
            wrong = metrics.predict_labels(scored, at.filter("name = 'youdens_j'")).join(F.broadcast(test.select("id", "patient_id", "label")), "id")  # a short matrix
            wrong = wrong.filter("predicted <> y").select(F.lit("misclassified").alias("row"), F.col("patient_id").cast("string").alias("patient_id"), "label")
            tables = {
                "model": ranking.model_table(train.sparkSession, forest), "metrics": scores, "roc": metrics.roc_grid(points), "ci": ranking.bootstrap_report(scored, self.boots, seed),
                "report": scores.withColumn("row", F.lit("metrics")).unionByName(wrong, allowMissingColumns=True),
                "cv_ci": metrics.fold_report(ranking.cv_scores(fit.unionByName(test).select("id", "target", "x"), model, 4, self.ci_repeats, seed, **params)),
            }
            shap = ranking.shap_report(test, learn, model, seed, **params).persist()
            tables |= {"shap_full": shap, **{f"shap_class_{c}": shap.filter(F.col("target") == c) for c in (0, 1)}}
            tables["shap_mean"] = shap.groupBy("fi").agg(F.avg("shap").alias("mean"), F.avg(F.abs("shap")).alias("mean_abs"))
            self.tables |= {f"{name}_{split}_{what}": df for what, df in tables.items()}


def run(spark: SparkSession, options: Options, settings: Settings, model_id: str = "run", params: dict | None = None, boots: int = 1000, ci_repeats: int = 25) -> dict[str, DataFrame]:
    """A feature-selection run, its tables written to the target and returned by name."""
    s, seed, search = settings.feature_selection, settings.random_state, settings.optimization.optuna
    data = load(spark, options, settings)
    f = frames(data)
    train, holdout = f.train, f.holdout
    stored = None
    if options.best_pipeline and exists(spark, options.best_pipeline):
        stored = stored_pipeline(options.best_pipeline, f.features)
        train, holdout = (stored.transform(x.select(*KEYS, "fi", "value")) for x in (train, holdout))
    elif options.best_pipeline:
        method, _, strategy = options.best_pipeline.partition(":")
        raw, how = train.select(*KEYS, "fi", "value"), strategy or options.imputation_strategy
        train = impute.impute(raw, method, how, keep=KEYS)
        holdout = impute.impute(holdout.select(*KEYS, "fi", "value"), method, how, keep=KEYS, reference=raw)
    if options.best_pipeline:
        train, holdout = kept(train), kept(holdout)  # all steps read them
    if options.use_batch_corrected:
        plates = data.cohort.select("patient_id", "plate")
        train, holdout = (batch.combat(x.join(plates, "patient_id"), "plate").drop("plate") for x in (train, holdout))
    step = _Run(options, settings, dict(params or {}), boots, ci_repeats)
    tables = step.tables
    if stored is not None:
        tables["preprocessing"] = parameter_table(spark, stored)
    tables["ttest"] = stats.t_test(train.select("target", "fi", "value")).withColumn("significant", F.col("p_value") < settings.stats.pvalue_thresh)
    keep = chosen_features(train.select("id", "target", "fi", "value"), options, s, seed)
    if not keep:
        raise ValueError("no feature passes the filter")
    log.info("the filter keeps %d of %d features: %s", len(keep), len(f.features), ", ".join(f.features[j] for j in keep))

    def arrays(places: list[int]) -> tuple[DataFrame, DataFrame]:
        missing = options.model == "xgboost" and options.augmentation == "none"  # which takes missing values as they are
        return tuple(narrowed(x.select(*KEYS, "fi", "value"), places, missing).persist() for x in (train, holdout))

    rows, held = arrays(keep)
    learn = step.augmented(rows, "cv")
    best = step.searched(learn, search.before_feature_selection, "before_feature_selection")
    result = step.ranked(learn, best, len(keep)).persist()
    if options.rec_feat_add and search.after_rfa:
        # The features that were ranked go through the filter again, a search follows on those, and they are ranked anew.
        ranked = sorted(keep[r[0]] for r in result.select("fi").collect())
        again = chosen_features(train.filter(F.col("fi").isin(ranked)).select("id", "target", "fi", "value"), options, s, seed)
        keep = again or ranked
        tables["result_before_search"] = result
        rows, held = arrays(keep)
        learn = step.augmented(rows, "cv")
        best = step.searched(learn, True, "after_rfa")
        result = step.ranked(learn, best, len(keep)).persist()
    step.params = best
    names = F.broadcast(spark.createDataFrame([(i, f.features[j]) for i, j in enumerate(keep)], "fi long, feature string"))
    tables["result"] = result.join(names, "fi").orderBy("rank")
    if "importance" in result.columns:
        tables["most_important"] = tables["result"].orderBy(F.desc("importance"), "rank").select("feature", "importance").limit(20)
    if 1 < len(keep) <= 1000:
        complete = train.filter(F.col("fi").isin(keep)).select("id", "target", "fi", "value")
        tables["spearman"], tables["mutual_information"] = stats.spearman(complete), information.information_matrix(complete)
    n_train, n_held = rows.count(), held.count()
    observed = s.cross_validation_splits * s.cross_validation_repeats if options.rec_feat_add else s.multisurf_cross_validation_splits
    log.info("%d features are ranked", result.count())
    for name, panel in panels(result, observed, settings.stats.pvalue_thresh).items():
        step.evaluated(name, sorted(panel), rows, held, min(0.5, n_held / max(1, n_train)))
    save(spark, options, settings, model_id, tables, fmt="parquet")
    result.unpersist()
    return tables


def parameter_combinations(strategy: str) -> list[dict]:
    """Scalers times imputers by strategy, each once."""
    # What is tried.
    mar = [{"method": "knn", "k": k, "weights": w} for k in (4, 5, 6, 7, 8) for w in ("uniform", "distance")]
    mar += [{"method": "mice", "estimator": e} for e in impute.ESTIMATORS] + [{"method": "mean"}, {"method": "miss_forest"}]
    mnar = [{"method": "qrilc", "tune_sigma": t} for t in (0.5, 1.0)] + [{"method": "minprob", "quantile_percent": q, "tune_sigma": t} for q in (0.1, 0.01) for t in (0.5, 1.0)]
    scalers = ("none", "min_max", "median", "log2", "quantile") if strategy == "mixed" else ("none",)
    first, second = ([None] if strategy == "mar" else mnar), ([None] if strategy == "mnar" else mar)
    return [{"scaler": s, "mnar": a, "mar": b} for s, a, b in itertools.product(scalers, first, second)]


def performance(long: DataFrame, strategy: str, model: str = "xgboost", combinations: list[dict] | None = None, seed: int = 0, **params) -> DataFrame:
    """(pipeline, metrics of its labels at Youden's threshold, AUC and sensitivities of its ROC grid) of every preprocessing, fitted on nine
    tenths of the rows (id, target, fi, value) and judged on the others. All pipelines are one job; what is still missing counts as 0."""
    combinations = parameter_combinations(strategy) if combinations is None else combinations
    part = folds.stratified_split(long.select("id", "target").distinct(), 0.1, seed).select("id", "test")
    if long.count() > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells; select features first")
    fit = learner(model)

    def each(name: str, ids: np.ndarray, y: np.ndarray, test: np.ndarray, x: np.ndarray) -> pd.DataFrame:
        x = np.nan_to_num(x, nan=0.0)
        score = fit(x[~test], y[~test], seed=seed, **params).predict(x[test])
        return pd.DataFrame({"group": name, "id": ids[test], "y": y[test], "score": score})

    split = long.select("id", F.col("target").cast("int").alias("target"), "fi", "value").join(F.broadcast(part), "id")  # a row a patient
    scored = kept(over_pipelines(split, combinations, each, "group string, id long, y int, score double", strategy, seed))
    points = metrics.roc_points(scored)
    at = metrics.youden(points).withColumn("name", F.lit("youdens_j"))
    return metrics.metrics_at(scored, at).join(metrics.grid_summary(metrics.roc_grid(points)), "group").withColumnRenamed("group", "pipeline")


def prepare(spark: SparkSession, long: DataFrame, strategy: str, model: str = "xgboost", combinations: list[dict] | None = None, seed: int = 0, **params) -> DataFrame:
    """The best five of ``performance`` by sensitivity at 95 percent specificity, ROC and PR areas, and predictive values, in this order."""
    return best_of(performance(long, strategy, model, combinations, seed, **params))


def prepare_and_store(spark: SparkSession, options: Options, settings: Settings, model_id: str, combinations: list[dict] | None = None, **params) -> list[str]:
    """The search over all preprocessings: the scores of all of them, and the best five fitted on all training rows, stored so that
    a later run loads one by its path. The paths written."""
    f = frames(load(spark, options, settings))
    combinations = parameter_combinations(options.imputation_strategy) if combinations is None else combinations
    long = f.train.select("id", "target", "fi", "value")
    scores = kept(performance(long, options.imputation_strategy, options.model, combinations, settings.random_state, **params))
    best, named = best_of(scores), {pipeline_name(c): c for c in combinations}
    tables, models = {"model_performance": scores, "pipelines": best}, {}
    for i, r in enumerate(best.collect(), 1):  # five
        models[f"best_pipeline_{i}"] = pipeline(named[r.pipeline], options.imputation_strategy, f.features).fit(long)
        tables[f"best_pipeline_{i}_parameters"] = parameter_table(spark, models[f"best_pipeline_{i}"])
    return save(spark, options, settings, model_id, tables, models)


def stored_pipeline(path: str, features: list[str]) -> PipelineModel:
    """A stored preprocessing, if it was fitted on just these features."""
    model = read_model(path)
    for stage in model.stages:
        if list(stage.getOrDefault("features")) != list(features):
            raise ValueError(f"{path} was fitted on other features than those of this run")
    return model


def _typed(default: object, value: object) -> object:
    """A cell's text as the kind of value that the option or setting has."""
    if not isinstance(value, str) or isinstance(default, str) or default is None:
        return value
    if isinstance(default, bool):
        if value.strip().lower() not in ("true", "false", "1", "0"):
            raise ValueError(f"{value!r} is neither true nor false")
        return value.strip().lower() in ("true", "1")
    return type(default)(value) if isinstance(default, int | float) else value


def run_matrix(spark: SparkSession, rows: DataFrame, settings: Settings, go=run) -> list[str]:
    """Every row that is not blank is a run: columns cli_<option> and config_<setting>. Rows that name no input are left out. The runs' names."""
    done = []
    for i, row in enumerate(r.asDict() for r in rows.dropna(how="all").collect()):  # a row a run
        cli = {k.removeprefix("cli_").replace("-", "_"): v for k, v in row.items() if k.startswith("cli_") and v is not None and str(v).strip()}
        if not (cli.get("input_path") or cli.get("s3_bucket") and cli.get("s3_input_path")):
            continue
        own = {k.removeprefix("config_"): v for k, v in row.items() if k.startswith("config_") and v is not None}
        take = lambda config: {k: _typed(getattr(config, k), v) for k, v in own.items() if hasattr(config, k) and not is_dataclass(getattr(config, k))}
        if odd := sorted(k for k in own if not hasattr(settings, k) and not hasattr(settings.feature_selection, k)):
            raise ValueError(f"unknown setting {odd[0]}")
        chosen = replace(settings, **take(settings), feature_selection=replace(settings.feature_selection, **take(settings.feature_selection)))
        defaults = {f.name: f.default for f in fields(Options)}
        go(spark, Options(**{k: _typed(defaults.get(k), v) for k, v in cli.items()}), chosen, f"run{i}")
        done.append(f"run{i}")
    return done
