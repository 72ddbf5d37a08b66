"""Scaling and normalising: fitted on one set of rows, applied to any."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayloom.operators.ordered import medians
from assayloom.operators.stats import pair_sums

safe = F.try_divide


def standardise(long: DataFrame, train: DataFrame) -> DataFrame:
    """(x - mean) / population std of ``train`` by feature; a std of 0 scales by 1; missing values stay missing."""
    fit = train.groupBy("fi").agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))
    return long.join(fit, "fi").withColumn("value", (F.col("value") - F.col("mu")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)).drop("mu", "sd")


def min_max_clip(long: DataFrame, train: DataFrame) -> DataFrame:
    """To [0, 1] by the range of ``train``, clipped; a feature without range becomes 0."""
    fit = train.groupBy("fi").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    scaled = F.coalesce(safe(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    return long.join(fit, "fi").withColumn("value", F.when(F.col("value").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)))).drop("lo", "hi")


def centre_on_median(long: DataFrame, train: DataFrame) -> DataFrame:
    """Each value less the median of ``train`` by feature; a feature without values there becomes missing."""
    fit = train.select("fi").distinct().join(medians(train, ("fi",)), "fi", "left")
    return long.join(fit, "fi").withColumn("value", F.col("value") - F.col("median")).drop("median")


def log2(long: DataFrame) -> DataFrame:
    """log2 of positive values; -inf for 0 and missing for negative ones."""
    return long.withColumn("value", F.when(F.col("value") > 0, F.log2("value")).when(F.col("value") == 0, F.lit(float("-inf"))))


def top_l_scales(long: DataFrame, l: int = 10) -> DataFrame:  # noqa: E741
    """(fi, scale): the median of a feature's l largest values over mu0, the sum of those medians over the number of rows."""
    w = Window.partitionBy("fi").orderBy(F.desc_nulls_last("value"), "id")
    tops = long.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= l).groupBy("fi").agg(F.median("value").alias("md"))
    mu0 = tops.agg(F.sum("md").alias("all")).crossJoin(long.agg(F.count_distinct("id").alias("rows"))).select((F.col("all") / F.col("rows")).alias("mu0"))
    return tops.crossJoin(F.broadcast(mu0)).select("fi", safe(F.col("md"), F.col("mu0")).alias("scale"))


def top_l(long: DataFrame, l: int = 10) -> DataFrame:  # noqa: E741
    """Each feature over its scale, as top_l_scales says."""
    return long.join(F.broadcast(top_l_scales(long, l)), "fi").withColumn("value", safe(F.col("value"), F.col("scale"))).drop("scale")  # a row a feature


def ranked(long: DataFrame) -> DataFrame:
    """With k: a value's rank among those of its row, ties by feature; missing ones rank last."""
    return long.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy(F.asc_nulls_last("value"), "fi")))


def quantile_normalise(long: DataFrame) -> DataFrame:
    """Each sample's values replaced by the mean over samples at their rank; missing ones rank last and stay missing."""
    at = ranked(long)
    means = at.groupBy("k").agg(F.avg("value").alias("m"))
    return at.join(means, "k").withColumn("value", F.when(F.col("value").isNotNull(), F.coalesce("m", "value"))).drop("k", "m")


METHODS = {"log2": log2, "top_l": top_l, "quantile": quantile_normalise}
#: Those that learn from training rows.
FITTED = {"standard": standardise, "min_max": min_max_clip, "median": centre_on_median}


def normalise(long: DataFrame, method: str) -> DataFrame:
    """By name; a method not known is top_l, none is the identity."""
    return long if method in ("none", None) else METHODS.get(method, top_l)(long)


class Normaliser:
    """A method by name with its parameters: fitted on some rows, then applied to any. Methods that learn nothing ignore the fit."""

    def __init__(self, method: str = "none", **params):
        self.method, self.params, self.rows = method, params, None
        self.set_params(**params)

    def set_params(self, **params) -> Normaliser:
        method = params.pop("method", self.method)
        if method != "none" and method not in METHODS and method not in FITTED:
            raise ValueError(f"no such scaler: {method}")
        if odd := sorted(set(params) - ({"l"} if method == "top_l" else set())):
            raise ValueError(f"{method} takes no {odd[0]}")
        self.method, self.params = method, params
        return self

    def get_params(self) -> dict:
        return {"method": self.method, **self.params}

    def fit(self, long: DataFrame) -> Normaliser:
        self.rows = long
        return self

    def transform(self, long: DataFrame) -> DataFrame:
        if self.method in FITTED:
            if self.rows is None:
                raise ValueError(f"{self.method} is not fitted")
            return FITTED[self.method](long, self.rows)
        return long if self.method == "none" else METHODS[self.method](long, **self.params)


def pca_scores(arrays: DataFrame, holdout: DataFrame, keep: list[str], k: int) -> tuple[DataFrame, DataFrame]:
    """(``keep``, PCA_0..) of both frames (x array<double>, standardised and complete), components fitted on the first. Signs are free."""
    model = PCA(k=k, inputCol="features", outputCol="scores").fit(arrays.withColumn("features", array_to_vector("x")))
    out = lambda df: model.transform(df.withColumn("features", array_to_vector("x"))).withColumn("s", vector_to_array("scores")).select(*keep, *(F.col("s")[i].alias(f"PCA_{i}") for i in range(k)))
    return out(arrays), out(holdout)


def effective_dimension(long: DataFrame) -> DataFrame:
    """One row: exp of the entropy of the covariance eigenvalues, missing values as 0. The covariance has a row a feature pair."""
    filled = long.select("id", "fi", F.coalesce("value", F.lit(0.0)).alias("value"))
    covariance = safe(F.col("sxy") - safe(F.col("sx") * F.col("sy"), F.col("n")), F.col("n") - 1)
    cov = pair_sums(filled).select(F.col("f_i").alias("i"), F.col("f_j").alias("j"), covariance.alias("c"))

    def run(table: pa.Table) -> pa.Table:
        i, j, c = (table[n].to_numpy() for n in ("i", "j", "c"))
        m = np.zeros((int(i.max()) + 1,) * 2)
        m[i, j] = m[j, i] = c
        w = np.linalg.eigvalsh(m)
        w = w[w > 1e-12 * max(w.max(), 1e-300)]
        p = w / w.sum()
        return pa.table({"effective_dimension": [float(np.exp(-(p * np.log(p)).sum()))]})

    return cov.groupBy(F.lit(0).alias("g")).applyInArrow(run, "effective_dimension double")
