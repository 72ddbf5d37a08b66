"""Per-feature statistics over the long form; every loop over features is one grouping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayloom.functions.dist import p_of_f, p_of_t
from assayloom.operators.ordered import running, with_stretch

safe = F.try_divide


def class_moments(long: DataFrame, by: tuple[str, ...] = ("fi",)) -> DataFrame:
    """n, mean and sample variance of each class (target 1 and 0) by feature; missing values are left out."""
    one, zero = F.when(F.col("target") == 1, F.col("value")), F.when(F.col("target") == 0, F.col("value"))
    return long.groupBy(*by).agg(F.count(one).alias("n1"), F.count(zero).alias("n0"), F.avg(one).alias("m1"), F.avg(zero).alias("m0"), F.var_samp(one).alias("v1"), F.var_samp(zero).alias("v0"))


def t_statistics(long: DataFrame, by: tuple[str, ...] = ("fi",)) -> DataFrame:
    """The pooled two-sample t statistic and its degrees of freedom by feature; null where the pooled variance is 0 or unknown."""
    df = F.col("n1") + F.col("n0") - 2
    pooled = safe((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0"), df)
    t = safe(F.col("m1") - F.col("m0"), F.sqrt(pooled * (safe(F.lit(1.0), F.col("n1")) + safe(F.lit(1.0), F.col("n0")))))
    return class_moments(long, by).select(*by, t.alias("t"), df.cast("double").alias("df"))


def t_test(long: DataFrame, by: tuple[str, ...] = ("fi",)) -> DataFrame:
    """t_statistics with two-sided p-values."""
    return t_statistics(long, by).withColumn("p_value", p_of_t("t", "df"))


def t_from_summary(result: DataFrame, metric: str, n: int) -> DataFrame:
    """Each row's mean and std of ``metric`` against the first row (by ``rank``) with the largest mean, n observations each.

    The std goes in as it is, whatever its divisor. A metric whose pooled variance is 0 has no t."""
    mean, std = f"mean_{metric}", f"std_{metric}"
    best = result.agg(F.max_by(F.struct(F.col(mean).alias("bm"), F.col(std).alias("bs")), F.struct(mean, -F.col("rank"))).alias("b")).select("b.*")
    joined = result.crossJoin(F.broadcast(best))  # one row
    pooled = (F.col("bs") ** 2 + F.col(std) ** 2) / 2
    t = safe(F.col("bm") - F.col(mean), F.sqrt(pooled * (2.0 / n)))
    return joined.withColumn(f"t_statistic_{metric}", t).withColumn("df", F.lit(2.0 * n - 2)).drop("bm", "bs")


def t_from_summary_p(result: DataFrame, metric: str, n: int) -> DataFrame:
    out = t_from_summary(result, metric, n)
    return out.withColumn(f"p_value_{metric}", p_of_t(f"t_statistic_{metric}", "df"))


def anova_f(long: DataFrame) -> DataFrame:
    """One-way F of each feature over the classes: between and within mean squares."""
    groups = long.filter("value is not null").groupBy("fi", "target").agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    total = groups.groupBy("fi").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("q").alias("q"), F.sum("s").alias("s"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"))
    ssb, ssw = F.col("between") - F.col("s") * F.col("s") / F.col("n"), F.col("q") - F.col("between")
    d1, d2 = F.col("k") - 1, F.col("n") - F.col("k")
    return total.select("fi", safe(safe(ssb, d1), safe(ssw, d2)).alias("f"), d1.cast("double").alias("df1"), d2.cast("double").alias("df2"))


def univariate_scores(long: DataFrame) -> DataFrame:
    """-log10 of the ANOVA p-value, rescaled over the features to lie between -1 and 1."""
    p = anova_f(long).withColumn("p", p_of_f("f", "df1", "df2")).withColumn("score", -F.log10(F.greatest("p", F.lit(1e-300))))
    low, high = F.min("score").over(Window.partitionBy(F.lit(0))), F.max("score").over(Window.partitionBy(F.lit(0)))  # a row a feature
    return p.withColumn("score", F.coalesce(safe(2 * (F.col("score") - low), high - low) - 1, F.lit(0.0))).select("fi", "f", "p", "score")


def average_ranks(long: DataFrame, by: tuple[str, ...] = ("fi",)) -> DataFrame:
    """Ranks of values by feature, ties sharing their mean. Distinct values are ranked, whatever rows have them, and meet the rows again."""
    there = long.filter("value is not null")
    at = with_stretch(there.groupBy(*by, "value").agg(F.count("*").alias("c")), "value")
    ranked = running(at, by, F.col("__stretch"), [F.col("value")], {"r": F.col("c")})
    return there.join(ranked.select(*by, "value", (F.col("r") - (F.col("c") - 1) / 2.0).alias("r")), [*by, "value"])


#: Features whose products with others are held at once.
FEATURES = 512


def pair_sums(long: DataFrame, value: str = "value", means: DataFrame | None = None) -> DataFrame:
    """(f_i, f_j, n, sx, sy, sxy, sxx, syy) for f_i <= f_j over the ids that have both; values are taken from their feature's mean
    (``means``: fi, mu, where they are known).

    A partition adds up the products of its ids' rows as matrices, block of features by block, and sends a row a pair; so what is
    shuffled does not grow with the ids beyond the partitions."""
    means = long.groupBy("fi").agg(F.avg(value).alias("mu")) if means is None else means  # a row a feature
    near = long.join(F.broadcast(means), "fi").filter(F.col(value).isNotNull()).select("id", "fi", (F.col(value) - F.col("mu")).alias("v"))
    rows = near.groupBy("id").agg(F.collect_list("fi").alias("f"), F.collect_list("v").alias("v"))
    names = np.array(sorted(r[0] for r in means.select("fi").collect()), np.int64)
    kinds = ("n", "sx", "sy", "sxy", "sxx", "syy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            f, v = batch.column(0), batch.column(1).flatten().to_numpy(zero_copy_only=False)
            x, have = np.zeros((batch.num_rows, len(names))), np.zeros((batch.num_rows, len(names)))
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(f).to_numpy(zero_copy_only=False))
            place = np.searchsorted(names, f.flatten().to_numpy())
            x[row, place], have[row, place] = v, 1
            for a in range(0, len(names), FEATURES):
                for b in range(a, len(names), FEATURES):
                    (xa, ha), (xb, hb) = ((x[:, c : c + FEATURES], have[:, c : c + FEATURES]) for c in (a, b))
                    new = [ha.T @ hb, xa.T @ hb, ha.T @ xb, xa.T @ xb, (xa**2).T @ hb, ha.T @ xb**2]
                    sums[a, b] = [p + q for p, q in zip(sums[a, b], new, strict=True)] if (a, b) in sums else new
        for (a, b), totals in sums.items():
            i, j = np.nonzero((a + np.arange(totals[0].shape[0]))[:, None] <= b + np.arange(totals[0].shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(names[a + i]), pa.array(names[b + j]), *(pa.array(t[i, j]) for t in totals)], ["f_i", "f_j", *kinds])

    parts = rows.select("f", "v").mapInArrow(run, "f_i long, f_j long, " + ", ".join(f"{c} double" for c in kinds))
    return parts.groupBy("f_i", "f_j").agg(*(F.sum(c).alias(c) for c in kinds))


def pair_correlations(long: DataFrame, value: str = "value", means: DataFrame | None = None) -> DataFrame:
    """(f_i, f_j, corr) for i <= j over the ids that have both; null where one does not vary."""
    n, sx, sy, sxy, sxx, syy = (F.col(c) for c in ("n", "sx", "sy", "sxy", "sxx", "syy"))
    corr = safe(n * sxy - sx * sy, F.sqrt(F.greatest(n * sxx - sx * sx, F.lit(0.0)) * F.greatest(n * syy - sy * sy, F.lit(0.0))))
    return pair_sums(long, value, means).select("f_i", "f_j", corr.alias("corr"))


def spearman(long: DataFrame) -> DataFrame:
    """Spearman's correlation of every pair of features without missing values: Pearson's on average ranks."""
    means = long.groupBy("fi").agg(((F.count("value") + 1) / 2).alias("mu"))  # of ranks
    return pair_correlations(average_ranks(long), "r", means)


def benjamini_hochberg(df: DataFrame, p: str, by: tuple[str, ...] = (), out: str = "p_adjusted") -> DataFrame:
    """Step-up adjusted p-values within each family ``by``; null p-values stay null and do not count."""
    keys = [F.col(c) for c in by] or [F.lit(0)]
    asc = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(p))
    m = F.count(p).over(Window.partitionBy(*keys))
    desc = Window.partitionBy(*keys).orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = df.withColumn("__rank", F.row_number().over(asc)).withColumn("__m", m)
    return ranked.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min(F.col(p) * F.col("__m") / F.col("__rank")).over(desc)))).drop("__rank", "__m")


def t_test_posthoc(df: DataFrame, group: str, value: str, pairs: list[tuple[str, str]], alpha: float = 0.05) -> DataFrame:
    """Groups that are in a pair whose t-test is rejected after Benjamini-Hochberg over the pairs: (group, flag 1). Others are absent."""
    spark = df.sparkSession
    table = F.broadcast(spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "fi long, a string, b string"))  # the caller's list
    rows = df.select(F.col(group).cast("string").alias("g"), F.col(value).cast("double").alias("value"))
    sided = rows.join(table, (F.col("g") == F.col("a")) | (F.col("g") == F.col("b"))).withColumn("target", (F.col("g") == F.col("a")).cast("int"))
    tested = benjamini_hochberg(t_test(sided), "p_value").filter(F.col("p_adjusted") <= alpha).join(table, "fi")
    return tested.select(F.explode(F.array("a", "b")).alias(group)).distinct().withColumn("flag", F.lit(1))
