"""Imputation of missing values, deterministic and stochastic; random draws depend on a seed and the row's id only."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayloom.functions.dist import norm_cdf, norm_ppf
from assayloom.operators.forest import Forest, boost, grow_forest
from assayloom.operators.miss_forest import folder_of_columns, miss_forest_by_trees
from assayloom.operators.missing import detect_mnar
from assayloom.operators.neighbours import filled_by_nearest, nearest_having
from assayloom.operators.ordered import medians


def fill_table(reference: DataFrame, method: str) -> DataFrame:
    """(fi, __fill): what mean, median or mode (the most frequent value, the smallest of several) puts into a feature's gaps."""
    if method == "mean":
        return reference.groupBy("fi").agg(F.avg("value").alias("__fill"))
    if method == "median":
        return medians(reference, ("fi",)).withColumnRenamed("median", "__fill")
    counts = reference.filter("value is not null").groupBy("fi", "value").count()
    return counts.groupBy("fi").agg(F.max_by("value", F.struct("count", -F.col("value"))).alias("__fill"))


def filled_by(long: DataFrame, table: DataFrame) -> DataFrame:
    """Gaps filled by (fi, __fill); a feature without a fill stays missing."""
    return long.join(F.broadcast(table), "fi", "left").withColumn("value", F.coalesce("value", "__fill")).select(long.columns)  # a row a feature


def fill_mean(long: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """Means of ``reference`` (default: the same rows); a feature without values there stays missing."""
    return filled_by(long, fill_table(long if reference is None else reference, "mean"))


def fill_median(long: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    return filled_by(long, fill_table(long if reference is None else reference, "median"))


def fill_mode(long: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """The most frequent value, the smallest of several."""
    return filled_by(long, fill_table(long if reference is None else reference, "mode"))


def fill_knn(long: DataFrame, k: int = 5, weights: str = "uniform", reference: DataFrame | None = None) -> DataFrame:
    """The mean of the ``k`` nearest rows (of ``reference``, default: the same rows) that have the feature, by distance over shared coordinates; weights may go by distance. A
    feature nobody has becomes 0, and where no neighbour can be compared its mean is used.

    Blocks of rows meet blocks of rows, and each pair of blocks sends the best ``k`` offers for a gap, so what is shuffled grows
    with the gaps and not with the pairs of rows."""
    from assayloom.matrix import array_from_long

    if weights not in ("uniform", "distance"):
        raise ValueError(f"weights: {weights!r} is neither uniform nor distance")
    others = None if reference is None else array_from_long(reference, ["id"])
    best = nearest_having(array_from_long(long, ["id"]), k, others)
    if weights == "distance":
        zero = F.max(F.when(F.col("distance") == 0, 1).otherwise(0)).over(Window.partitionBy("id", "fi"))
        w = F.when(zero == 1, (F.col("distance") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.col("distance")))
    else:
        w = F.lit(1.0)
    filled = best.withColumn("w", w).groupBy("id", "fi").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("fill"))
    means = F.broadcast((long if reference is None else reference).groupBy("fi").agg(F.avg("value").alias("mean")))  # a row a feature
    met = long.join(means, "fi", "left").join(filled, ["id", "fi"], "left").withColumn("value", F.coalesce("value", "fill", "mean", F.lit(0.0)))
    return met.select(long.columns)


def _seeded(seed: int, key: object) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(str(key).encode())])


def truncated_normal(rng: np.random.Generator, n: int, mu: float, sigma: float, low: float, high: float) -> np.ndarray:
    """Draws between the bounds by the inverse of the distribution function."""
    if sigma <= 0:
        return np.full(n, min(max(mu, low), high))
    a, b = norm_cdf(np.array([(low - mu) / sigma, (high - mu) / sigma]))
    u = np.clip(a + rng.random(n) * (b - a), 1e-15, 1 - 1e-15)
    return np.clip(mu + sigma * norm_ppf(u), low, high)


def _by_row(arrays: DataFrame, fill, keep: list[str]) -> DataFrame:
    """``fill(id, values)`` of each row's array; missing values are nan inside."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in arrays.select(*keep).dtypes)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            pdf["x"] = [fill(i, np.array([np.nan if v is None else v for v in x], float)) for i, x in zip(pdf["id"], pdf["x"], strict=True)]
            pdf["x"] = [[None if np.isnan(v) else float(v) for v in x] for x in pdf["x"]]
            yield pdf

    return arrays.select(*keep, "x").mapInPandas(run, f"{kinds}, x array<double>")


def qrilc_row(key: object, x: np.ndarray, tune_sigma: float = 1.0, seed: int = 0) -> np.ndarray:
    """A sample with left-censored draws in its gaps; one without gaps, without values or with one value is left alone."""
    gone = np.isnan(x)
    n = len(x) - gone.sum()
    if not gone.any() or n < 2:
        return x
    share = gone.mean()
    q = np.linspace(share + 0.001, 0.99, 100)
    line = np.polyfit(norm_ppf(q), np.quantile(x[~gone], (q - share) / (1 - share)), 1)
    sigma, mu = abs(line[0]) * tune_sigma, line[1]
    upper = mu + sigma * float(norm_ppf(np.array([share + 0.001]))[0])
    upper = float(np.nanmax(x)) if np.isnan(upper) else abs(upper)
    x = x.copy()
    x[gone] = truncated_normal(_seeded(seed, key), int(gone.sum()), mu, sigma, 0.0, upper)
    return x


def qrilc(arrays: DataFrame, keep: list[str], tune_sigma: float = 1.0, seed: int = 0) -> DataFrame:
    """Left-censored draws for each sample: a normal fitted to its upper quantiles, cut off at the quantile of its missing share.

    Samples without gaps, without values or with one value are left alone."""
    return _by_row(arrays, lambda key, x: qrilc_row(key, x, tune_sigma, seed), keep)


def minprob_parameters(long: DataFrame, quantile_percent: float = 0.01, observed: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(id, mean) of each sample at a percentile given in percent; one row with sd, the median over well-observed features of their std."""
    at = long.groupBy("id").agg(F.percentile("value", F.lit(quantile_percent / 100)).alias("mean"))
    stds = long.groupBy("fi").agg(F.stddev_pop("value").alias("sd"), (F.count("value") / F.count("*")).alias("share")).filter(F.col("share") > observed)
    return at, stds.agg(F.median("sd").alias("sd"))


def minprob_row(key: object, x: np.ndarray, mean: float, sd: float, lower: float = 0.0, seed: int = 0) -> np.ndarray:
    """A sample with draws around its low quantile ``mean`` in its gaps; one without gaps, without values or of four features at most is left alone."""
    gone = np.isnan(x)
    if gone.any() and not gone.all() and len(x) > 4 and not np.isnan(mean):
        x = x.copy()
        x[gone] = mean + sd * truncated_normal(_seeded(seed, key), int(gone.sum()), 0.0, 1.0, lower, max(lower, mean + sd))
    return x


def minprob(long: DataFrame, arrays: DataFrame, keep: list[str], quantile_percent: float = 0.01, tune_sigma: float = 1.0, observed: float = 0.5, lower: float = 0.0, seed: int = 0, reference: DataFrame | None = None, spread: float | None = None) -> DataFrame:
    """Draws around each sample's low quantile; bounds are in standard units, lower to mean + sd, so draws lie at or above the mean. The
    features' spread is ``spread``, or that of ``reference`` (default: the same rows)."""
    if lower < 0:
        raise ValueError("the lower bound is not negative")
    at = minprob_parameters(long, quantile_percent, observed)[0]
    spread = minprob_parameters(long if reference is None else reference, quantile_percent, observed)[1].first()[0] if spread is None else spread
    sd = (spread or 0.0) * tune_sigma
    means = arrays.join(at, "id", "left").select(*keep, F.array_append("x", F.col("mean")).alias("x"))
    return _by_row(means, lambda key, x: minprob_row(key, x[:-1], x[-1], sd, lower, seed), keep)


def _rounds(x: np.ndarray, own: np.ndarray, fit, most: int, stop_early: bool) -> np.ndarray:
    """Features in ascending order of gaps, each regressed on the others; regressions, means, that order and when to stop are those of the
    rows ``own`` (without gaps in them, all rounds are run), so no other row bears on what a row gets. Features that are missing in all of those become 0."""
    gone = np.isnan(x)
    felt = gone & own[:, None]
    means = np.array([np.nanmean(c) if not np.isnan(c).all() else 0.0 for c in x[own].T])
    now = np.where(gone, means, x)
    order = [j for j in np.argsort(felt.sum(axis=0), kind="stable") if gone[:, j].any() and (~gone[own, j]).any()]
    last, before = np.inf, now
    for _ in range(most):
        new = now.copy()
        for j in order:
            rest = np.delete(new, j, axis=1)
            learn = own & ~gone[:, j]
            new[gone[:, j], j] = fit(rest[learn], x[learn, j], rest[gone[:, j]], j)
        change = ((new - now)[felt] ** 2).sum() / max((new[felt] ** 2).sum(), 1e-300) if felt.any() else last
        if stop_early and felt.any() and change >= last:
            return before
        last, before, now = change, new, new
        if change < 1e-6 or not gone.any():
            break
    return now


def _with_reference(arrays: DataFrame, keep: list[str], reference: DataFrame | None) -> DataFrame:
    """Rows to complete, __own, and those of ``reference``, which are not."""
    own = arrays.select(*keep, "x").withColumn("__own", F.lit(True))
    if reference is not None:
        own = own.unionByName(reference.select("id", "x").withColumn("__own", F.lit(False)), allowMissingColumns=True)
    return own


def _whole(arrays: DataFrame, keep: list[str], fit, most: int, stop_early: bool, most_cells: int, reference: DataFrame | None = None) -> DataFrame:
    """Such matrices are short: the whole of one is completed in one task, after a check of its size. Regressions learn from
    ``reference`` (arrays with an id too; default: the same rows), which is sent along and not given back."""
    own = _with_reference(arrays, keep, reference)
    cells = own.agg(F.sum(F.size("x"))).first()[0] or 0
    if cells > most_cells:
        raise ValueError(f"{cells} cells are more than the {most_cells} that one task may complete; split the rows by a column and impute within")
    kinds = ", ".join(f"`{c}` {t}" for c, t in arrays.select(*keep).dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        x = np.array([[np.nan if v is None else v for v in r] for r in pdf["x"]], float)
        if np.isinf(x).any():
            raise ValueError("infinite values cannot be imputed")
        mine = pdf["__own"].to_numpy(bool)
        pdf["x"] = _rounds(x, mine if mine.all() else ~mine, fit, most, stop_early).tolist()
        return pdf.loc[mine, [*keep, "x"]]

    return own.groupBy(F.lit(0).alias("all")).applyInPandas(run, f"{kinds}, x array<double>")


def _regressor(estimator: str = "linear", ridge: float = 1e-3, trees: int | None = None, seed: int = 0):
    """fit(a, y, b, j): what a regression of y on a says of b, by one of ESTIMATORS."""
    if estimator not in ESTIMATORS:
        raise ValueError(f"estimator: {estimator!r} is none of {', '.join(ESTIMATORS)}")

    def forest(a: np.ndarray, y: np.ndarray, b: np.ndarray, j: int) -> np.ndarray:
        return grow_forest(a, y, trees or 100, 32, seed=seed + j, features="all").predict(b)

    def boosted(a: np.ndarray, y: np.ndarray, b: np.ndarray, j: int) -> np.ndarray:
        return boost(a, y, trees or 500, 0.3, 6, lam=1.0, logistic=False, seed=seed + j).predict(b)

    return {"linear": _linear(ridge), "forest": forest, "boosted": boosted}[estimator]


def _linear(ridge: float):
    def fit(a: np.ndarray, y: np.ndarray, b: np.ndarray, _: int) -> np.ndarray:
        mu, m = a.mean(axis=0), y.mean()
        w = np.linalg.solve((a - mu).T @ (a - mu) + ridge * len(a) * np.eye(a.shape[1]), (a - mu).T @ (y - m))
        return (b - mu) @ w + m

    return fit


#: The regressions that MICE can chain.
ESTIMATORS = ("linear", "forest", "boosted")


def mice(arrays: DataFrame, keep: list[str], rounds: int = 10, estimator: str = "linear", ridge: float = 1e-3, trees: int | None = None, seed: int = 0, most_cells: int = 50_000_000, reference: DataFrame | None = None) -> DataFrame:
    """Chained regressions in rounds: "linear" ones with a small ridge, random "forest"s (100 ``trees``) or "boosted" trees (500)."""
    return _whole(arrays, keep, _regressor(estimator, ridge, trees, seed), rounds, False, most_cells, reference)


def _sampled_forest(trees: int = 20, depth: int = 6, seed: int = 0):
    def fit(a: np.ndarray, y: np.ndarray, b: np.ndarray, j: int) -> np.ndarray:
        forest: Forest = grow_forest(a, y, trees, depth, seed=seed + j, features="sqrt")
        return forest.predict(b)

    return fit


def miss_forest(arrays: DataFrame, keep: list[str], rounds: int = 4, trees: int = 20, depth: int = 6, seed: int = 0, most_cells: int = 1 << 20, reference: DataFrame | None = None) -> DataFrame:
    """Random-forest regressions in rounds until the change grows; the iterate before that is returned (Stekhoven and Buehlmann, 2012).

    One task completes at most ``most_cells``; of larger tables each tree is grown in a task of its own, with draws of its own."""
    own = _with_reference(arrays, keep, reference)
    size = F.coalesce(F.size("x"), F.lit(-1))
    cells, least, most = own.agg(F.sum(size), F.min(size), F.max(size)).first()
    if (cells or 0) <= most_cells or not (folder := folder_of_columns(own.sparkSession)):
        return _whole(arrays, keep, _sampled_forest(trees, depth, seed), rounds, True, max(most_cells, 5_000_000), reference)
    if least != most:
        raise ValueError(f"rows have {least} to {most} values")
    return miss_forest_by_trees(own, keep, most, cells, folder, rounds, trees, depth, seed)


def completed(ids: np.ndarray, x: np.ndarray, own: np.ndarray, method: str | None, rounds: int | None = None, seed: int = 0, **how) -> np.ndarray:
    """A matrix that is in a task already, completed as ``impute`` does with the rows ``own`` as reference, by mean, knn, mice or miss_forest."""
    if method == "mean":
        seen = ~np.isnan(x[own])
        means = np.where(seen.any(axis=0), np.where(seen, x[own], 0).sum(axis=0) / np.maximum(1, seen.sum(axis=0)), np.nan)
        return np.where(np.isnan(x), means, x)
    if method == "knn":
        return filled_by_nearest(ids, x, own, [(how.get("k", 5), how.get("weights", "uniform"))])[0]
    if method == "mice":
        return _rounds(x, own, _regressor(seed=seed, **how), rounds or 10, False)
    if method == "miss_forest":
        return _rounds(x, own, _sampled_forest(seed=seed, **how), rounds or 4, True)
    if method not in (None, "none"):
        raise ValueError(f"{method} completes no matrix in a task")
    return x


#: The parameters that each method of the facade takes.
PARAMETERS = {
    "mean": (), "median": (), "mode": (), "knn": ("k", "weights"), "qrilc": ("tune_sigma", "seed"), "minprob": ("quantile_percent", "tune_sigma", "observed", "lower", "seed"),
    "mice": ("rounds", "estimator", "ridge", "trees", "seed", "most_cells"), "miss_forest": ("rounds", "trees", "depth", "seed", "most_cells"),
}


def impute(long: DataFrame, method: str | None, strategy: str = "mar", keep: tuple[str, ...] = ("id", "target"), reference: DataFrame | None = None, **how) -> DataFrame:
    """Facade: ``mar`` fills all features, ``mnar`` too, ``mixed`` with a censored method only those found missing not at random.

    Statistics, neighbours and regressions are those of ``reference``, so a holdout is completed as its training rows say; by
    default they are those of the rows themselves. A method not known and a parameter that it does not take raise."""
    from assayloom.matrix import array_from_long, long_from_array

    if method in (None, "none"):
        return long
    if method not in PARAMETERS:
        raise ValueError(f"no such method: {method}")
    if odd := sorted(set(how) - set(PARAMETERS[method])):
        raise ValueError(f"{method} takes no {odd[0]}; it takes {', '.join(PARAMETERS[method]) or 'nothing'}")
    simple = {"mean": fill_mean, "median": fill_median, "mode": fill_mode, "knn": fill_knn}
    if method in simple:
        return simple[method](long, reference=reference, **how)
    if method in ("mice", "miss_forest"):
        arrays = array_from_long(long, list(keep))
        others = None if reference is None else array_from_long(reference, ["id"])
        return long_from_array({"mice": mice, "miss_forest": miss_forest}[method](arrays, list(keep), reference=others, **how), "x", list(keep))
    chosen = detect_mnar(long if reference is None else reference).filter("mnar").select("fi") if strategy == "mixed" else None
    return censored(long, method, keep, chosen, None if method == "qrilc" else minprob_parameters(long if reference is None else reference, observed=how.get("observed", 0.5))[1].first()[0], **how)


def censored(long: DataFrame, method: str, keep: tuple[str, ...], chosen: DataFrame | None, spread: float | None = None, **how) -> DataFrame:
    """Left-censored draws by qrilc, or by minprob with the features' ``spread``, in the features of ``chosen`` (default: all)."""
    from assayloom.matrix import array_from_long, long_from_array

    arrays = array_from_long(long, list(keep))
    done = qrilc(arrays, list(keep), **how) if method == "qrilc" else minprob(long, arrays, list(keep), spread=spread or 0.0, **how)
    filled = long_from_array(done, "x", list(keep))
    if chosen is not None:
        filled = filled.join(chosen, "fi", "left_semi").unionByName(long.select(filled.columns).join(chosen, "fi", "left_anti"))
    return filled
