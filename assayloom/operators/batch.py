"""Batch correction: location and scale per batch, shrunk by empirical Bayes (Johnson, Li and Rabinovic, 2007)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

safe = F.try_divide


def location_scale(long: DataFrame, batch: str) -> DataFrame:
    """(batch, fi, n, gamma, delta2): mean and variance of each batch's values, standardised by the grand mean (batches weighted by
    their size) and the pooled within-batch variance of the feature."""
    moments = long.groupBy(batch, "fi").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    grand = moments.groupBy("fi").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"), (F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("pooled"))
    sd = F.sqrt("pooled")
    return moments.join(grand, "fi").select(batch, "fi", "n", "grand", "pooled", F.coalesce(safe(F.col("m") - F.col("grand"), sd), F.lit(0.0)).alias("gamma"), F.coalesce(safe(F.col("v") * safe(F.col("n"), F.col("n") - 1), F.col("pooled")), F.lit(1.0)).alias("delta2"))


def combat(long: DataFrame, batch: str, tolerance: float = 1e-4, most_rounds: int = 200) -> DataFrame:
    """``long`` with values adjusted for ``batch``; no covariates. Missing values stay missing. The shrinkage runs once a batch on a
    row a feature."""
    stats = location_scale(long, batch)

    def shrink(pdf: pd.DataFrame) -> pd.DataFrame:
        g, d, n = pdf["gamma"].to_numpy(), pdf["delta2"].to_numpy(), pdf["n"].to_numpy()
        g_bar, t2 = g.mean(), g.var(ddof=1) if len(g) > 1 else 0.0
        m, s2 = d.mean(), d.var(ddof=1) if len(d) > 1 else 0.0
        if s2 > 0 and t2 > 0:
            a, b = (2 * s2 + m**2) / s2, (m * s2 + m**3) / s2
            g_new, d_new = g.copy(), d.copy()
            for _ in range(most_rounds):
                g_next = (t2 * n * g + d_new * g_bar) / (t2 * n + d_new)
                d_next = (0.5 * ((n - 1) * d + n * (g - g_next) ** 2) + b) / (n / 2 + a - 1)
                change = max(np.max(np.abs(g_next - g_new) / np.maximum(np.abs(g_new), 1e-12)), np.max(np.abs(d_next - d_new) / np.maximum(d_new, 1e-12)))
                g_new, d_new = g_next, d_next
                if change < tolerance:
                    break
        else:
            g_new, d_new = g, d
        return pd.DataFrame({batch: pdf[batch], "fi": pdf["fi"], "grand": pdf["grand"], "pooled": pdf["pooled"], "g": g_new, "d": np.sqrt(np.maximum(d_new, 1e-12))})

    kind = dict(long.dtypes)[batch]
    fitted = stats.groupBy(batch).applyInPandas(shrink, f"{batch} {kind}, fi long, grand double, pooled double, g double, d double")
    sd = F.sqrt("pooled")
    adjusted = F.when(F.col("pooled") > 0, ((F.col("value") - F.col("grand")) / sd - F.col("g")) / F.col("d") * sd + F.col("grand")).otherwise(F.col("value"))
    return long.join(fitted, [batch, "fi"]).withColumn("value", adjusted).drop("grand", "pooled", "g", "d")
