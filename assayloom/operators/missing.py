"""Missingness: fractions, filters, and the test for values missing not at random."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.functions.dist import p_of_chi2
from assayloom.operators.stats import benjamini_hochberg

safe = F.try_divide


def missing_fraction(long: DataFrame) -> DataFrame:
    return long.groupBy("fi").agg((1 - F.count("value") / F.count("*")).alias("missing"))


def observed_features(long: DataFrame, more_than: float = 0.5) -> DataFrame:
    """Features whose observed fraction is above ``more_than``."""
    return long.groupBy("fi").agg((F.count("value") / F.count("*")).alias("observed")).filter(F.col("observed") > more_than)


def missing_by_class(long: DataFrame) -> DataFrame:
    """(fi, target, gone, there): the contingency table of each feature."""
    return long.groupBy("fi", "target").agg(F.count_if(F.col("value").isNull()).alias("gone"), F.count("value").alias("there"))


def mnar_chi2(long: DataFrame) -> DataFrame:
    """(fi, a, b, chi2): Yates-corrected chi-squared of missingness for each pair of classes a < b. Pairs with an expected count of 0 are left out."""
    t = missing_by_class(long)
    a = t.select("fi", F.col("target").alias("a"), F.col("gone").alias("g1"), F.col("there").alias("t1"))
    b = t.select("fi", F.col("target").alias("b"), F.col("gone").alias("g2"), F.col("there").alias("t2"))
    pairs = a.join(b, "fi").filter("a < b and g1 + g2 > 0 and t1 + t2 > 0 and g1 + t1 > 0 and g2 + t2 > 0")
    n = F.col("g1") + F.col("g2") + F.col("t1") + F.col("t2")
    total = F.lit(0.0)
    for cell, row, col in (("g1", "g1+t1", "g1+g2"), ("t1", "g1+t1", "t1+t2"), ("g2", "g2+t2", "g1+g2"), ("t2", "g2+t2", "t1+t2")):
        expected = F.expr(row) * F.expr(col) / n
        off = F.abs(F.col(cell) - expected)
        total += F.pow(off - F.least(F.lit(0.5), off), F.lit(2.0)) / expected
    return pairs.select("fi", "a", "b", total.alias("chi2"))


def detect_mnar(long: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(fi, p_least, mnar boolean): whether any class pair's p-value, adjusted over the feature's pairs, is under ``alpha``."""
    tested = benjamini_hochberg(mnar_chi2(long).withColumn("p", p_of_chi2("chi2", F.lit(1.0))), "p", ("fi",))
    found = tested.groupBy("fi").agg(F.min("p_adjusted").alias("p_least"))
    return long.select("fi").distinct().join(found, "fi", "left").withColumn("mnar", F.coalesce(F.col("p_least") < alpha, F.lit(False)))
