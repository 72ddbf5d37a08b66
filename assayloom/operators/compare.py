"""Comparing models by the features they chose."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_significant(result: DataFrame, p: str | None = None, alpha: float = 0.05, by: str = "model") -> DataFrame:
    """(model, feature, importance) of each model's first row (fewest features) with p below ``alpha``; features_chosen is a map."""
    p = p or next(c for c in result.columns if c.startswith("p_value"))
    first = result.filter(F.col(p) < alpha).groupBy(by).agg(F.min_by("features_chosen", "n_features_to_select").alias("chosen"))
    return first.select(by, F.explode("chosen").alias("feature", "c")).select(by, "feature", F.col("c")["features_importances"].alias("importance"))


def compare_models(importances: DataFrame, top: int | None = None) -> DataFrame:
    """(feature, a column a model, average) over (model, feature, importance), 0 where a model has none, by falling average.

    With ``top``, features come from each model's best ones, values from all."""
    models = sorted(r[0] for r in importances.select("model").distinct().collect())
    if top is not None:
        from pyspark.sql import Window

        w = Window.partitionBy("model").orderBy(F.desc("importance"), "feature")
        best = importances.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= top).select("feature").distinct()
        importances = importances.join(best, "feature", "left_semi")
    wide = importances.groupBy("feature").pivot("model", models).agg(F.first("importance")).na.fill(0.0)
    average = sum((F.col(f"`{m}`") for m in models), F.lit(0.0)) / len(models)
    return wide.withColumn("average", average).orderBy(F.desc("average"), "feature")
