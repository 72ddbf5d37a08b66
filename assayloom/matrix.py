"""The patient matrix: wide for learners, long (id, target, fi, value) for everything that is done feature by feature.

Missing values are NULL from the scan on; NaN never enters an aggregate. ``fi`` is the feature's place in source order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Columns that say who or what a row is; whatever their type, they are no features.
NOT_FEATURES = ("patient_id", "target", "label", "batch", "plate")


def numeric_columns(df: DataFrame, but: tuple[str, ...] = NOT_FEATURES) -> list[str]:
    """Numeric columns in source order, without those named in ``but``."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in but]


def select_in_order(df: DataFrame, keep: set[str] | list[str]) -> DataFrame:
    """The columns in ``keep``, in the frame's own order."""
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c in set(keep)))


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType | T.FloatType)]
    return df.withColumns({c: F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")) for c in floats}) if floats else df


def long_from_array(df: DataFrame, value: str, keep: list[str]) -> DataFrame:
    """One row an element: ``keep``, fi long, value double."""
    return df.select(*keep, F.posexplode(value).alias("fi", "v")).select(*keep, F.col("fi").cast("long").alias("fi"), F.when(~F.isnan(F.col("v").cast("double")), F.col("v").cast("double")).alias("value"))


def long_from_wide(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """One row a cell, NULLs kept: ``keep``, fi long, feature, value double."""
    cells = F.array(*(F.struct(F.lit(i).cast("long").alias("fi"), F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value")) for i, c in enumerate(features)))
    return nan_to_null(df.select(*keep, F.explode(cells).alias("c")).select(*keep, "c.fi", "c.feature", "c.value"))


def wide_from_long(long: DataFrame, keep: list[str], features: list[int]) -> DataFrame:
    """Back to one row an id, features as f<fi>."""
    return long.groupBy(*keep).pivot("fi", features).agg(F.first("value")).toDF(*keep, *(f"f{i:02d}" for i in features))


def array_from_long(long: DataFrame, keep: list[str]) -> DataFrame:
    """One row an id with its values in feature order; missing ones are null."""
    return long.groupBy(*keep).agg(F.transform(F.array_sort(F.collect_list(F.struct("fi", "value"))), lambda s: s["value"]).alias("x"))
