"""Cohorts and labels: enrichment, sub-cohorts, repair of rare labels, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def columns_containing(cohort: DataFrame, part: str) -> list[str]:
    """Text columns in which some value contains ``part`` (a pattern, any case)."""
    texts = [f.name for f in cohort.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return []
    found = cohort.agg(*(F.max(F.coalesce(F.col(f"`{c}`").rlike(f"(?i){part}"), F.lit(False))).alias(f"c{i}") for i, c in enumerate(texts))).first()
    return [c for i, c in enumerate(texts) if found[i]]


def enrich_labels(df: DataFrame, cohort: DataFrame, part: str, key: str = "patient_id") -> DataFrame:
    """``label @ value`` for each cohort column that contains ``part``, "None" for a missing value; unmatched rows stay."""
    extra = [c for c in columns_containing(cohort, part) if c != key]
    joined = df.join(cohort.select(key, *(F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(extra))), key, "left")
    for i in range(len(extra)):
        joined = joined.withColumn("label", F.concat("label", F.lit(" @ "), F.coalesce(f"__{i}", F.lit("None"))))
    return joined.select(*df.columns)


def sub_cohort(df: DataFrame, pattern: str) -> DataFrame:
    """Rows whose label matches the pattern, any case."""
    return df.filter(F.col("label").rlike(f"(?i){pattern}"))


#: Edits within which nearest labels are sought by their parts, one after the other; only labels without one are compared with all.
EDITS = (1, 3)


def near_labels(old: DataFrame, new: DataFrame, edits: int) -> DataFrame:
    """(old, new) of all pairs of different labels of ``old`` (old) and ``new`` (new) that are at most so many edits apart, and of some others.

    Each of ``new`` is cut into one part more than there may be edits, so one of them stands unchanged in any label that near, at most so
    many places off; labels meet at such parts. As many rows as labels, a fixed number each; labels shorter than the parts' number all meet."""
    parts, length = edits + 1, "(((i + 1) * n) div {p} - (i * n) div {p})".format(p=edits + 1)
    start = f"((i * n) div {parts})"
    index = new.select("new", F.char_length("new").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(edits))).alias("i")).select("new", "n", "i", F.expr(f"substring(new, {start} + 1, {length})").alias("part"))
    sizes = F.explode(F.sequence(F.greatest(F.lit(0), F.char_length("old") - edits), F.char_length("old") + edits)).alias("n")
    asked = old.select("old", sizes).select("old", "n", F.explode(F.sequence(F.lit(0), F.lit(edits))).alias("i")).select("old", "n", "i", F.explode(F.sequence(F.lit(-edits), F.lit(edits))).alias("off"))
    asked = asked.filter(f"{start} + off >= 0 and {start} + off + {length} <= char_length(old)").select("old", "n", "i", F.expr(f"substring(old, {start} + off + 1, {length})").alias("part")).distinct()
    return asked.join(index, ["n", "i", "part"]).filter("old <> new").select("old", "new").distinct()


def repair_labels(df: DataFrame, threshold: int = 1, metric: str = "levenshtein") -> DataFrame:
    """Labels of ``threshold`` rows or fewer become the nearest label with more than one row: by edits, then by rows, then by name.

    Without such a label nothing changes, and null labels stay. Near labels are found by common parts (near_labels), within growing
    numbers of edits; only a rare label that has none within the last is compared with all others."""
    if metric != "levenshtein":
        raise ValueError(f"no such metric: {metric}")
    counts = df.filter("label is not null").groupBy("label").agg(F.count("*").alias("n"))
    left = counts.filter(F.col("n") <= threshold).select(F.col("label").alias("old"))
    common = counts.filter("n > 1").select(F.col("label").alias("new"), F.col("n").alias("rows"))
    best = None
    for edits in (*EDITS, None):
        pairs = left.join(common.select("new"), F.col("old") != F.col("new")) if edits is None else near_labels(left, common.select("new"), edits)
        apart = pairs.withColumn("d", F.levenshtein("old", "new"))
        apart = (apart if edits is None else apart.filter(F.col("d") <= edits)).join(common, "new")
        found = apart.groupBy("old").agg(F.min(F.struct("d", -F.col("rows"), F.col("new"))).alias("b")).select(F.col("old").alias("label"), F.col("b")["new"].alias("__new"))
        best = found if best is None else best.unionByName(found)
        left = left.join(found.select(F.col("label").alias("old")), "old", "left_anti")
    return df.join(best, "label", "left").withColumn("label", F.coalesce("__new", "label")).select(*df.columns)


def most_correlated_label(long: DataFrame, rare: list[str]) -> DataFrame:
    """(id, label): for each row of a rare label, the label whose mean profile correlates best with the row (ties by name)."""
    centres = long.filter(~F.col("label").isin(rare)).groupBy(F.col("label").alias("near"), "fi").agg(F.avg("value").alias("c"))
    scored = long.filter(F.col("label").isin(rare)).join(centres, "fi").groupBy("id", "near").agg(F.corr("value", "c").alias("r"))
    w = Window.partitionBy("id").orderBy(F.desc_nulls_last("r"), "near")
    return scored.withColumn("k", F.row_number().over(w)).filter("k = 1").select("id", F.col("near").alias("label"))


def integrity(train: DataFrame, holdout: DataFrame, cohort: DataFrame, key: str = "patient_id") -> DataFrame:
    """One row (check, ok) a rule: both sets have missing values or neither; the key is in all; every id is in the cohort."""
    spark = train.sparkSession
    keyed = all(key in df.columns for df in (train, holdout, cohort))

    def gaps(df: DataFrame) -> DataFrame:
        numbers = [F.col(f"`{f.name}`").isNull() | F.isnan(F.col(f"`{f.name}`").cast("double")) for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
        return df.agg(F.coalesce(F.max(F.greatest(*numbers, F.lit(False), F.lit(False))), F.lit(False)).alias("g"))

    same = gaps(train).crossJoin(gaps(holdout).withColumnRenamed("g", "h")).select(F.lit("missing_in_both_or_neither").alias("check"), (F.col("g") == F.col("h")).alias("ok"))  # a row each
    has_key = spark.range(1).select(F.lit("key_present").alias("check"), F.lit(keyed).alias("ok"))
    if not keyed:
        return same.unionByName(has_key)
    lost = train.select(key).unionByName(holdout.select(key)).join(cohort.select(key), key, "left_anti").agg((F.count("*") == 0).alias("ok"))
    return same.unionByName(has_key).unionByName(lost.select(F.lit("ids_in_cohort").alias("check"), "ok"))


def check(train: DataFrame, holdout: DataFrame, cohort: DataFrame, key: str = "patient_id") -> None:
    """Raise where integrity fails."""
    bad = [r[0] for r in integrity(train, holdout, cohort, key).filter("not ok").collect()]
    if bad:
        raise ValueError("data checks failed: " + ", ".join(bad))
