"""Importance, recursive feature addition and elimination, and search: grids of small model fits, one task a fit."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import replace
from itertools import product
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayloom.config import IMPORTANCES
from assayloom.matrix import long_from_array
from assayloom.operators.forest import NODES, Tree, learner, nodes_of, ranked
from assayloom.operators.grid import Matrix, folds_of, grid, matrix_of, splits_of
from assayloom.operators.information import information_cv
from assayloom.operators.metrics import auc_exact, confusion, counted, grid_summary, label_metrics, pareto_front, pr_scores, predict_labels, roc_grid, roc_points, youden
from assayloom.operators.samplers import Genetic, Parzen

#: The ranges searched for each learner, (low, high, log scale) or choices.
SPACES = {
    "xgboost": {
        "depth": (2, 3, False), "rate": (0.001, 0.1, True), "trees": (50, 500, False), "subsample": (0.1, 1.0, False), "columns": (0.1, 1.0, False),
        "child_weight": (0, 10, False), "gamma": (0, 5, False), "lam": (1e-8, 10.0, True), "alpha": (1e-8, 10.0, True),
    },
    "balanced_random_forest": {
        "trees": (50, 1000, False), "depth": (2, 10, False), "min_split": (2, 10, False), "min_leaf": (3, 10, False), "features": ["sqrt", "log2", "all"],
        "criterion": ["gini", "entropy"], "min_share": (0.0, 0.5, False),
    },
    "random_forest": {
        "trees": (50, 500, False), "depth": (3, 5, False), "min_split": (2, 10, False), "min_leaf": (3, 10, False), "features": ["sqrt", "log2", "all"],
        "criterion": ["gini", "entropy", "log_loss"], "min_share": (0.0, 0.5, False), "leaves": (10, 100, False),
    },
}


def _rank_auc(y: np.ndarray, s: np.ndarray) -> float:
    p, n = (y == 1).sum(), (y == 0).sum()
    if not p or not n:
        return 0.5
    order = np.argsort(s, kind="stable")
    r = np.empty(len(s))
    values, start, count = np.unique(s[order], return_index=True, return_counts=True)
    r[order] = np.repeat(start + (count + 1) / 2, count)
    return float((r[y == 1].sum() - p * (p + 1) / 2) / (p * n))


def _average_precision(y: np.ndarray, s: np.ndarray) -> float:
    order = np.argsort(-s, kind="stable")
    hit = y[order] == 1
    tp, last = np.cumsum(hit), np.append(np.diff(s[order]) != 0, True)
    precision, recall = (tp / np.arange(1, len(y) + 1))[last], tp[last] / max(1, hit.sum())
    return float((np.diff(recall, prepend=0) * precision).sum())


SCORED = "id long, y int, score double"


def _scored(m: Matrix, t: np.ndarray, scores: np.ndarray, **group: int) -> pd.DataFrame:
    return pd.DataFrame({**group, "id": m.ids[t], "y": m.y[t].astype(int), "score": scores})


def cv_scores(arrays: DataFrame, model: str = "xgboost", k: int = 4, repeats: int = 1, seed: int = 0, **params) -> DataFrame:
    """(group, id, y, score) of every held-out row; group is repeat * k + fold. A fit a fold."""
    fit, m = learner(model), matrix_of(arrays)

    def run(shared: tuple, repeat: int, part: int) -> pd.DataFrame:
        m, folds = shared
        t = folds[repeat] == part
        return _scored(m, t, fit(m.x[~t], m.y[~t], seed=seed, **params).predict(m.x[t]), group=repeat * k + part)

    return grid(arrays.sparkSession, (m, folds_of(m, arrays, k, repeats, seed)), list(product(range(repeats), range(k))), run, f"group long, {SCORED}")


def feature_importance(arrays: DataFrame, method: str = "shap", model: str = "xgboost", k: int = 2, repeats: int = 1, seed: int = 0, **params) -> DataFrame:
    """(fi, importance) averaged over training folds, a model fitted on each: mean absolute SHAP or eject-SHAP of its rows, or split gain."""
    fit, m = learner(model), matrix_of(arrays)
    if method == "eject_shap" and model != "xgboost":
        raise NotImplementedError("eject-SHAP is for boosted trees")

    def run(shared: tuple, repeat: int, part: int) -> pd.DataFrame:
        m, folds = shared
        t = folds[repeat] == part
        x, forest = m.x[~t], fit(m.x[~t], m.y[~t], seed=seed, **params)
        game = {"shap": "expected", "eject_shap": "ejected"}.get(method)
        imp = np.abs(forest.shapley(x, game)).mean(axis=0) if game else forest.importance(x.shape[1])
        return pd.DataFrame({"fi": np.arange(len(imp)), "importance": imp})

    each = grid(arrays.sparkSession, (m, folds_of(m, arrays, k, repeats, seed)), list(product(range(repeats), range(k))), run, "fi long, importance double")
    return each.groupBy("fi").agg(F.avg("importance").alias("importance"))


def importance_by(arrays: DataFrame, kind: str, model: str = "xgboost", k: int = 2, repeats: int = 1, seed: int = 0, **params) -> DataFrame:
    """(fi, importance) of the kind asked for; one not known raises."""
    if kind not in IMPORTANCES:
        raise ValueError(f"no such importance: {kind}")
    if kind == "mutual_information":
        long = long_from_array(arrays.select("id", "target", "x"), "x", ["id", "target"])
        return information_cv(long, k, repeats, seed).withColumnRenamed("mi", "importance")
    if kind == "permutation_importance":
        return permutation_importance(arrays, model, seed=seed, **params).select("fi", "importance")
    return feature_importance(arrays, "gain" if kind == "tree_importance" else kind, model, k, repeats, seed, **params)


def permutation_importance(arrays: DataFrame, model: str = "xgboost", repeats: int = 10, seed: int = 0, **params) -> DataFrame:
    """(fi, importance, std): the loss of average precision when a feature is permuted, the model fitted once on all rows. A task a
    feature, in which only trees that split on it are asked again, of the column alone that changes; without such a tree nothing is lost."""
    m = matrix_of(arrays)
    forest = learner(model)(m.x, m.y, seed=seed, **params)

    def run(shared: tuple, j: int) -> pd.DataFrame:
        m, forest, base = shared
        rng, drops, used = np.random.default_rng([seed, j]), [], [(t.feature == j).any() for t in forest.trees]
        if not any(used):
            return pd.DataFrame({"fi": [j], "importance": [0.0], "std": [0.0]})
        features = np.unique(np.concatenate([t.feature[t.feature >= 0] for t, u in zip(forest.trees, used, strict=True) if u]))
        z, place = m.x[:, features], int(np.searchsorted(features, j))
        asked = [replace(t, feature=np.where(t.feature < 0, -1, np.searchsorted(features, t.feature))) if u else None for t, u in zip(forest.trees, used, strict=True)]
        still, own = [None if u else t.predict(m.x) for t, u in zip(forest.trees, used, strict=True)], m.x[:, j]
        for _ in range(repeats):
            z[:, place] = rng.permutation(own)
            margin = forest.base + forest.scale * sum((v if t is None else t.predict(z) for t, v in zip(asked, still, strict=True)), np.zeros(len(z)))
            drops.append(base - _average_precision(m.y, forest.of_margin(margin)))
        return pd.DataFrame({"fi": [j], "importance": [np.mean(drops)], "std": [np.std(drops)]})

    shared = (m, forest, _average_precision(m.y, forest.predict(m.x)))
    return grid(arrays.sparkSession, shared, [(j,) for j in range(m.x.shape[1])], run, "fi long, importance double, std double")


def _leaves(forest) -> list[tuple[float, list[tuple[int, float, float, bool]]]]:
    """Each leaf's share of the margin, and its path as (feature, low, high, missing): a row is in where low < x <= high for all, or x is
    missing and that goes there."""
    out = []
    for t in forest.trees:
        todo = [(0, {})]
        while todo:
            n, path = todo.pop()
            f, cut = int(t.feature[n]), float(t.threshold[n])
            if f < 0:
                out.append((forest.scale * float(t.value[n]), [(g, *span) for g, span in path.items()]))
                continue
            low, high, gone = path.get(f, (-np.inf, np.inf, True))
            left = t.missing_left is not None and bool(t.missing_left[n])
            todo += [(int(t.left[n]), {**path, f: (low, min(high, cut), gone and left)}), (int(t.right[n]), {**path, f: (max(low, cut), high, gone and not left)})]
    return out


def _inside(v: np.ndarray, low: float, high: float, gone: bool) -> np.ndarray:
    return (v > low) & (v <= high) | (np.isnan(v) & gone)


#: Slopes of rows against background rows that are held at once.
SLOPES = 1 << 21


def _ways(forest) -> tuple[list, list[tuple]]:
    """The distinct tests that the leaves' paths make of single features, and each leaf as (value, the features of its path, their tests' places)."""
    places: dict[tuple, int] = {}
    leaves = [(value, [f for f, *_ in path], [places.setdefault(test, len(places)) for test in path]) for value, path in _leaves(forest) if path]
    return list(places), leaves


def _passed(x: np.ndarray, tests: list) -> np.ndarray:
    """Whether each row passes each test."""
    return np.stack([_inside(x[:, f], *span) for f, *span in tests], axis=1) if tests else np.zeros((len(x), 0), bool)


def _alike(x: np.ndarray, tests: list) -> tuple[np.ndarray, np.ndarray]:
    """A row for each way to pass the tests, and the way of each row. Rows that pass the same ones stand at the same leaves."""
    bits = np.packbits(_passed(x, tests), axis=1)
    _, first, way = np.unique(np.ascontiguousarray(bits).view(f"V{max(1, bits.shape[1])}").ravel() if bits.shape[1] else np.zeros(len(x)), return_index=True, return_inverse=True)
    return first, way


def shap_report(arrays: DataFrame, background: DataFrame, model: str = "xgboost", seed: int = 0, **params) -> DataFrame:
    """(id, target, fi, shap) of the predicted probability: exact interventional Shapley values, averaged over all background rows.

    The model is fitted on the background. Against one background row the margin's values come from the leaves; they are scaled
    to the probability's difference, as the usual tree explainer does. A row's values add up to its prediction less the mean one.

    Rows that pass the same tests of the trees are alike, so background rows are met once a way to pass them, weighed by their number, and
    so are the rows of a batch. Of a leaf it only matters which of its tests a background row passes: slopes are summed by those.
    """
    m = matrix_of(background)
    forest = learner(model)(m.x, m.y, seed=seed, **params)
    tests, leaves = _ways(forest)
    first, way = _alike(m.x, tests)
    base = m.x[first]
    sent = arrays.sparkSession.sparkContext.broadcast((forest, tests, leaves, base, np.bincount(way, minlength=len(first)).astype(float)))

    def run(parts):
        forest, tests, leaves, base, many = sent.value
        margins, p, theirs = forest.margin(base), forest.predict(base), _passed(base, tests)
        fact = np.array([float(factorial(k)) for k in range(max((len(own) for _, own, _ in leaves), default=0) + 1)])
        groups = []  # of each leaf: the ways its tests are passed there, and which of them each background row has
        for _, _, own in leaves:
            _, at, which = np.unique(np.packbits(theirs[:, own], axis=1), axis=0, return_index=True, return_inverse=True)
            groups.append((theirs[np.ix_(at, own)], which.ravel()))

        def values(x: np.ndarray) -> np.ndarray:
            out, mine, own_margin, own_p = np.zeros(x.shape), _passed(x, tests), forest.margin(x), forest.predict(x)
            gap = own_margin[:, None] - margins
            far = np.abs(gap) > 1e-9
            slope = many * np.where(far, (own_p[:, None] - p) / np.where(far, gap, 1), (own_p * (1 - own_p))[:, None] if forest.logit else 1.0)
            for (value, features, own), (kinds, which) in zip(leaves, groups, strict=True):
                me = mine[:, own]
                for r in range(len(x)) if len(kinds) > 64 else [slice(None)]:  # deep paths have many ways; a row at a time
                    mr, sl = np.atleast_2d(me[r]), np.atleast_2d(slope[r])
                    summed = np.stack([np.bincount(which, row, len(kinds)) for row in sl])
                    plus, minus = mr[:, None] & ~kinds, ~mr[:, None] & kinds  # the leaf needs these features from the row, those from the background
                    s, n = plus.sum(axis=2), minus.sum(axis=2)
                    weight = (mr[:, None] | kinds).all(axis=2) * summed * value / fact[s + n]
                    gain = plus * (fact[np.maximum(s - 1, 0)] * fact[n] * weight)[..., None] - minus * (fact[s] * fact[np.maximum(n - 1, 0)] * weight)[..., None]
                    at = np.arange(len(x))[r]
                    out[np.ix_(np.atleast_1d(at), features)] += gain.sum(axis=1)
            return out / many.sum()

        for pdf in parts:
            if len(pdf):
                x = np.array(pdf["x"].tolist(), float)
                first, way = _alike(x, tests)
                step = max(1, SLOPES // len(base))
                each = np.concatenate([values(x[first[s : s + step]]) for s in range(0, len(first), step)])[way]
                width = x.shape[1]
                yield pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy(), width), "target": np.repeat(pdf["target"].to_numpy(), width), "fi": np.tile(np.arange(width), len(x)), "shap": each.ravel()})

    return arrays.select("id", "target", "x").mapInPandas(run, "id long, target int, fi long, shap double")


def lime(arrays: DataFrame, predict, samples: int = 500, seed: int = 0) -> DataFrame:
    """(id, fi, weight): a weighted ridge regression of ``predict`` on rows perturbed around each one."""

    def run(parts):
        for pdf in parts:
            x = np.array(pdf["x"].tolist(), float)
            out = []
            for i, v in zip(pdf["id"], x, strict=True):
                z = np.random.default_rng([seed, int(i) & 0xFFFFFFFF]).standard_normal((samples, len(v)))
                w = np.exp(-(z**2).sum(axis=1) / (0.75 * np.sqrt(len(v))) ** 2 / 2)
                a = z * np.sqrt(w)[:, None]
                beta = np.linalg.solve(a.T @ a + np.eye(len(v)), a.T @ (np.sqrt(w) * (predict(v + z) - predict(v[None])[0])))
                out.append(pd.DataFrame({"id": i, "fi": np.arange(len(v)), "weight": beta}))
            if out:
                yield pd.concat(out)

    return arrays.select("id", "x").mapInPandas(run, "id long, fi long, weight double")


def addition_by_importance(arrays: DataFrame, importance: DataFrame, number: int = 30, model: str = "xgboost", k: int = 2, repeats: int = 25, seed: int = 0, **params) -> DataFrame:
    """One row a rank: mean and std over folds of AUC, MCC (labels at one half) and sensitivities at fixed specificities, and their
    stabilities. Step i trains on all features with at least the i-th importance, in source order. A task has a fold and some steps, from the largest
    panel down; a boosted tree is only grown again where a feature has left that it or one before it splits on."""
    fit, m, spark, again = learner(model), matrix_of(arrays), arrays.sparkSession, model == "xgboost" and params.get("columns", 1.0) >= 1
    order = [(r[0], r[1]) for r in importance.orderBy(F.desc("importance"), "fi").limit(number).collect()]  # ``number`` rows
    panels = [[f for f, v in sorted(order) if v >= mark] for _, mark in order]

    def run(shared: tuple, repeat: int, part: int, first: int, own: list[list[int]]) -> Iterator[pd.DataFrame]:
        m, folds = shared
        t, left, begun = folds[repeat] == part, own[-1], {}
        x, y = np.asfortranarray(m.x[~t][:, left]), m.y[~t]
        known = ranked(x)
        for rank, panel in zip(range(first + len(own) - 1, first - 1, -1), reversed(own), strict=True):
            for gone in [j for j in reversed(range(len(left))) if left[j] not in panel]:
                x, known = np.delete(x, gone, axis=1), tuple(np.delete(v, gone, axis=0) for v in known)
                begun = {"begun": _without(begun["begun"], gone)} if again else {}
            left, forest = panel, fit(x, y, seed=seed, known=known, **begun, **params)
            begun = {"begun": forest.trees} if again else {}
            yield _scored(m, t, forest.predict(m.x[t][:, panel]), rank=rank, group=repeat * k + part)

    some = max(1, min(len(panels), k * repeats * len(panels) // (4 * spark.sparkContext.defaultParallelism)))  # steps of a task
    keys = [(r, p, s + 1, panels[s : s + some]) for r in range(repeats) for p in range(k) for s in range(0, len(panels), some)]
    scored = grid(spark, (m, folds_of(m, arrays, k, repeats, seed)), keys, run, f"rank long, group long, {SCORED}")
    names = spark.createDataFrame([(i + 1, f) for i, (f, _) in enumerate(order)], "rank long, fi long")
    return rank_summary(scored).join(F.broadcast(names), "rank")


def rank_summary(scored: DataFrame) -> DataFrame:
    """(rank, mean_*, std_*, stab_*) from scores by rank and fold; std is the population's, stability mean over std."""
    by = ("rank", "group")
    scored = counted(scored, by)
    points = roc_points(scored, by)
    each = grid_summary(roc_grid(points, by), by).join(label_metrics(confusion(predict_labels(scored, 0.5), by), by).select(*by, "mcc"), list(by))
    names = {"auc": "roc_auc", "mcc": "mcc", **{f"sens_at_{s}": f"sens_at_{s}" for s in (99, 95, 90, 85, 80)}}
    out = each.groupBy("rank").agg(*(F.avg(c).alias(f"mean_{n}") for c, n in names.items()), *(F.stddev_pop(c).alias(f"std_{n}") for c, n in names.items()))
    return out.withColumns({f"stab_{n}": F.try_divide(f"mean_{n}", f"std_{n}") for n in ("roc_auc", "mcc")})


def addition_by_performance(arrays: DataFrame, number: int = 5, model: str = "xgboost", k: int = 2, repeats: int = 1, seed: int = 0, **params) -> DataFrame:
    """(rank, fi, mean_mcc, std_mcc, mean_roc_auc, std_roc_auc): greedily the feature that raises the mean MCC most; its own figures."""
    fit, m, spark = learner(model), matrix_of(arrays), arrays.sparkSession
    width, shared = m.x.shape[1], (m, folds_of(m, arrays, k, repeats, seed))
    chosen: list[int] = []
    out: list[tuple] = []

    def run(shared: tuple, repeat: int, part: int, f: int, panel: list[int]) -> pd.DataFrame:
        m, folds = shared
        x, t = m.x[:, panel], folds[repeat] == part
        s, truth = fit(x[~t], m.y[~t], seed=seed, **params).predict(x[t]), m.y[t]
        hard = (s >= 0.5).astype(int)
        tp, tn, fp, fn = (float(((hard == a) & (truth == b)).sum()) for a, b in ((1, 1), (0, 0), (1, 0), (0, 1)))
        d = np.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
        return pd.DataFrame({"fi": [f], "mcc": [(tp * tn - fp * fn) / d if d else 0.0], "auc": [_rank_auc(truth, s)]})

    for rank in range(1, min(number, width) + 1):
        keys = [(r, p, f, sorted([*chosen, f])) for r in range(repeats) for p in range(k) for f in range(width) if f not in chosen]
        each = grid(spark, shared, keys, run, "fi long, mcc double, auc double")
        best = each.groupBy("fi").agg(F.avg("mcc"), F.stddev_pop("mcc"), F.avg("auc"), F.stddev_pop("auc")).orderBy(F.desc(F.col("avg(mcc)")), "fi").first()
        chosen.append(best[0])
        out.append((rank, *best))
    return spark.createDataFrame(out, "rank long, fi long, mean_mcc double, std_mcc double, mean_roc_auc double, std_roc_auc double")


def _without(trees: list[Tree], gone: int) -> list[Tree]:
    """The trees up to the first that splits on the feature ``gone``, as they are once it has left. Boosting anew without it would begin with them."""
    out = []
    for t in trees:
        if (t.feature == gone).any():
            break
        out.append(replace(t, feature=t.feature - (t.feature > gone)))
    return out


def elimination(arrays: DataFrame, most: int = 40, model: str = "xgboost", splits: int = 10, test: float = 0.3, seed: int = 0, **params) -> tuple[DataFrame, DataFrame]:
    """Down from all features, one out a round by the model's importance: scores (group, rank = panel size, id, y, score) at sizes ``most``
    to 1, and (rank, fi, count, importance): how often a size keeps a feature, and its mean importance. A task a split, which orders its rows once; a boosted tree is only
    grown again after a feature has left that it or one before it splits on."""
    fit, m, again = learner(model), matrix_of(arrays), model == "xgboost" and params.get("columns", 1.0) >= 1

    def run(shared: tuple, split: int) -> pd.DataFrame:
        m, tested = shared
        t, left, out, begun = tested[split], list(range(m.x.shape[1])), [], {}
        x, y = np.asfortranarray(m.x[~t]), m.y[~t]
        known = ranked(x)
        while left:
            forest = fit(x, y, seed=seed, known=known, **begun, **params)
            imp = forest.importance(len(left))
            if len(left) <= most:
                out.append(_scored(m, t, forest.predict(m.x[t][:, left]), group=split, rank=len(left)).assign(kept=False))
                out.append(pd.DataFrame({"group": split, "rank": len(left), "id": left, "y": 1, "score": imp, "kept": True}))
            gone = int(imp.argmin())
            left.pop(gone)
            x, known = np.delete(x, gone, axis=1), tuple(np.delete(v, gone, axis=0) for v in known)
            begun = {"begun": _without(forest.trees, gone)} if again else {}
        return pd.concat(out)

    done = grid(arrays.sparkSession, (m, splits_of(m, arrays, splits, test, seed)), [(i,) for i in range(splits)], run, f"group long, rank long, {SCORED}, kept boolean").persist()
    chosen = done.filter("kept").groupBy("rank", F.col("id").alias("fi")).agg((F.count("*") / float(splits)).alias("count"), (F.sum("score") / float(splits)).alias("importance"))
    return done.filter("not kept").drop("kept"), chosen


def search(arrays: DataFrame, model: str = "xgboost", trials: int = 1, scorers: tuple[str, ...] = ("auc",), k: int = 2, repeats: int = 1, seed: int = 0, batch: int = 10) -> DataFrame:
    """(trial, params json, mean_test_<scorer>.., best): trial 0 has the learner's defaults, the others what a sampler asks for over the
    learner's ranges (Parzen estimators for one scorer, NSGA-II for several), ``batch`` at a time, so that a batch's fits are one
    job with a task a trial and fold. best is the first trial on the Pareto front. Scorers: mcc, auc, sens@99spec,
    average_precision, balanced_accuracy, f1."""
    known = {"mcc": "mcc", "auc": "auc", "sens@99spec": "sens_at_99", "average_precision": "average_precision_scores", "balanced_accuracy": "balanced_accuracy", "f1": "f1"}
    if unknown := [s for s in scorers if s not in known]:
        raise ValueError(f"no such scorer: {unknown[0]}")
    fit, m, spark, by = learner(model), matrix_of(arrays), arrays.sparkSession, ("trial", "group")
    sampler = (Parzen if len(scorers) == 1 else Genetic)(SPACES[model], seed)
    shared = (m, folds_of(m, arrays, k, repeats, seed))

    def run(shared: tuple, repeat: int, part: int, trial: int, own: dict) -> pd.DataFrame:
        m, folds = shared
        t = folds[repeat] == part
        return _scored(m, t, fit(m.x[~t], m.y[~t], seed=seed, **own).predict(m.x[t]), trial=trial, group=repeat * k + part)

    def scored(plans: list[tuple[int, dict]]) -> list[tuple]:
        keys = [(r, p, t, own) for t, own in plans for r in range(repeats) for p in range(k)]
        rows = grid(spark, shared, keys, run, f"trial long, group long, {SCORED}").persist()
        points = roc_points(rows, by)
        each = label_metrics(confusion(predict_labels(rows, 0.5), by), by).join(grid_summary(roc_grid(points, by), by), list(by)).join(pr_scores(points, by), list(by))
        means = {r[0]: tuple(r)[1:] for r in each.groupBy("trial").agg(*(F.round(F.avg(known[s]), 10) for s in scorers)).collect()}  # a row a trial
        rows.unpersist()
        return [(t, json.dumps(own, sort_keys=True), *means[t]) for t, own in plans]

    out = scored([(0, {})])
    while len(out) < trials:
        plans = list(enumerate(sampler.ask(min(batch, trials - len(out))), len(out)))
        for (_, params), row in zip(plans, found := scored(plans), strict=True):
            sampler.tell(params, row[2:])
        out += found
    names = [f"mean_test_{s}" for s in scorers]
    table = spark.createDataFrame(out, "trial long, params string" + "".join(f", `{c}` double" for c in names))
    front = pareto_front(table.select("trial", *(f"`{c}`" for c in names)), names).agg(F.min("trial").alias("__best"))
    return table.join(F.broadcast(front)).withColumn("best", F.col("trial") == F.col("__best")).drop("__best")  # one row


def with_panel(arrays: DataFrame, panel: list[int]) -> DataFrame:
    """The rows with only the features at the places ``panel``."""
    return arrays.withColumn("x", F.transform(F.array(*(F.lit(i) for i in panel)), lambda i: F.get("x", i)))


def fitted(train: DataFrame, model: str = "xgboost", panel: list[int] | None = None, seed: int = 0, **params):
    """The learner fitted on all of ``train``, on the features at the places ``panel`` (default: all)."""
    m = matrix_of(train)
    return learner(model)(m.x if panel is None else m.x[:, panel], m.y, seed=seed, **params)


def scored_by(forest, rows: DataFrame, panel: list[int] | None = None) -> DataFrame:
    """(group 0, id, y, score) of rows (id, target, x)."""
    sent = rows.sparkSession.sparkContext.broadcast(forest)

    def run(parts):
        for pdf in parts:
            if len(pdf):
                z = np.array(pdf["x"].tolist(), float)
                yield pd.DataFrame({"group": 0, "id": pdf["id"], "y": pdf["target"].astype(int), "score": sent.value.predict(z if panel is None else z[:, panel])})

    return rows.select("id", "target", "x").mapInPandas(run, "group long, id long, y int, score double")


def holdout_scores(train: DataFrame, holdout: DataFrame, model: str = "xgboost", panel: list[int] | None = None, seed: int = 0, **params) -> DataFrame:
    """(group 0, id, y, score) of the holdout by a model fitted on all of ``train``."""
    return scored_by(fitted(train, model, panel, seed, **params), holdout, panel)


def model_table(spark: SparkSession, forest) -> DataFrame:
    """The model's nodes as a table, which any reader of the run's format can load; forest.from_nodes makes it a model again."""
    return spark.createDataFrame(nodes_of(forest), NODES)


def bootstrap_report(scored: DataFrame, n_bootstraps: int = 1000, seed: int = 0) -> DataFrame:
    """(metric, mean, low, high) over resamplings of the scored rows (id, y, score); the model is not fitted again."""
    from assayloom.operators.folds import bootstrap
    from assayloom.operators.metrics import percentile_interval

    drawn = counted(bootstrap(scored.select("id", "y", "score"), n_bootstraps, seed).withColumnRenamed("boot", "group"))
    points = roc_points(drawn)
    hard = label_metrics(confusion(predict_labels(drawn, youden(points))))
    both = hard.join(grid_summary(roc_grid(points)), "group").join(auc_exact(points), "group")
    return percentile_interval(both.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("auc", "mcc", "sensitivity", "ppv", "npv")))).alias("s")).select("s.*"))


def support_to_importance(features: DataFrame, kept: DataFrame) -> DataFrame:
    """(fi, importance) of all ``features``, 0 where ``kept`` has none."""
    return features.select("fi").distinct().join(kept.select("fi", "importance"), "fi", "left").withColumn("importance", F.coalesce("importance", F.lit(0.0)))


def ranks(importance: DataFrame) -> DataFrame:
    return importance.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("importance"), "fi")).cast("long"))  # a row a feature
