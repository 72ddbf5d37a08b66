"""Metrics of (group, id, y, score): a fold, a bootstrap, a panel or a threshold is a group, so any number of them is one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.operators.ordered import quantiles, running, with_stretch
from assayloom.runtime import kept

#: Where the 101-point grid of false positive rates has specificity 99, 95, 90, 85 and 80 percent.
SPECIFICITY_STEPS = {99: 1, 95: 5, 90: 10, 85: 15, 80: 20}


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def counted(scored: DataFrame, by: tuple[str, ...] = ("group",)) -> DataFrame:
    """(by, y, score, weight): rows of one group, class and score as one, computed once and kept. Points, thresholds and labels each read the
    scores more than once, and would fit or draw anew each time."""
    w = F.col("weight") if "weight" in scored.columns else F.lit(1)
    return kept(scored.groupBy(*by, "y", "score").agg(F.sum(w).alias("weight")))


def roc_points(scored: DataFrame, by: tuple[str, ...] = ("group",)) -> DataFrame:
    """(by, score, tp, fp, p, n, dp, dn, k, last, above): counts at or above each distinct score, and each class's size; the score's own
    rows, its number from the highest on, whether it is the lowest, and the next higher score.

    A group of any size is shared by many tasks (``ordered.running``)."""
    w = F.coalesce(F.col("weight"), F.lit(1)) if "weight" in scored.columns else F.lit(1)
    at = scored.groupBy(*by, "score").agg(F.sum(F.when(F.col("y") == 1, w).otherwise(0)).alias("dp"), F.sum(F.when(F.col("y") == 0, w).otherwise(0)).alias("dn"))
    cut = with_stretch(at, "score")
    sums = {"tp": F.col("dp"), "fp": F.col("dn"), "k": F.lit(1).cast("long")}
    run = running(cut, by, -F.col("__stretch"), [F.desc("score")], sums, {"above": F.col("score")}, -F.col("score"))
    return run.select(*by, "score", "tp", "fp", F.col("all_tp").alias("p"), F.col("all_fp").alias("n"), "dp", "dn", "k", (F.col("k") == F.col("all_k")).alias("last"), "above")


def roc_curve(points: DataFrame, by: tuple[str, ...] = ("group",)) -> DataFrame:
    """(by, k, fpr, tpr, threshold) from the origin on; the origin's threshold is the largest score, so no infinity arises."""
    curve = points.filter("p > 0 and n > 0").select(*by, (F.col("k") + 1).alias("k"), (F.col("fp") / F.col("n")).alias("fpr"), (F.col("tp") / F.col("p")).alias("tpr"), F.col("score").alias("threshold"))
    origin = curve.filter("k = 2").select(*by, F.lit(1).cast("long").alias("k"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), "threshold")
    return origin.unionByName(curve)


def roc_grid(points: DataFrame, by: tuple[str, ...] = ("group",), steps: int = 101) -> DataFrame:
    """(by, step, tpr, threshold) on an even grid of false positive rates, linear between points and the last (highest) of equal ones.

    Every point has the line that leads to it from the one before (the origin has the largest score), the lowest also what is left of the grid."""
    seen = points.filter("p > 0 and n > 0")
    x, y, t = F.col("fp") / F.col("n"), F.col("tp") / F.col("p"), F.col("score")
    x0, y0, t0 = (F.col("fp") - F.col("dn")) / F.col("n"), (F.col("tp") - F.col("dp")) / F.col("p"), F.coalesce("above", "score")
    none = F.lit(None).cast("double")
    line = lambda *v: F.struct(*(c.alias(name) for c, name in zip(v, ("fpr", "tpr", "threshold", "fpr2", "tpr2", "threshold2"), strict=True)))
    here, rest = line(x0, y0, t0, x, y, t), line(x, y, t, none, none, none)
    seg = seen.select(*by, F.explode(F.when(F.col("last"), F.array(here, rest)).otherwise(F.array(here))).alias("s")).select(*by, "s.*")
    first, last = F.ceil(F.col("fpr") * (steps - 1) - 1e-9), F.when(F.col("fpr2").isNull(), steps - 1).otherwise(F.ceil(F.col("fpr2") * (steps - 1) - 1e-9) - 1)
    placed = seg.withColumns({"a": first.cast("long"), "b": last.cast("long")}).filter("a <= b").withColumn("step", F.explode(F.sequence("a", "b")))
    u = F.coalesce(F.try_divide(F.col("step") / float(steps - 1) - F.col("fpr"), F.col("fpr2") - F.col("fpr")), F.lit(0.0))
    between = lambda x, y: F.col(x) + u * (F.coalesce(F.col(y), F.col(x)) - F.col(x))
    return placed.select(*by, F.col("step").cast("long").alias("step"), between("tpr", "tpr2").alias("tpr"), between("threshold", "threshold2").alias("threshold"))


def grid_summary(grid: DataFrame, by: tuple[str, ...] = ("group",), steps: int = 101) -> DataFrame:
    """(by, auc, sens_at_99..80): the trapezoid area under the grid, and sensitivities at fixed specificities."""
    inner = F.when((F.col("step") == 0) | (F.col("step") == steps - 1), 0.5).otherwise(1.0)
    return grid.groupBy(*by).agg((F.sum(F.col("tpr") * inner) / (steps - 1)).alias("auc"), *(F.max(F.when(F.col("step") == i, F.col("tpr"))).alias(f"sens_at_{s}") for s, i in SPECIFICITY_STEPS.items()))


def auc_exact(points: DataFrame, by: tuple[str, ...] = ("group",)) -> DataFrame:
    """(by, roc_auc): the chance that a positive scores above a negative, ties half; null where a class is empty."""
    area = F.col("dn") * (2 * F.col("tp") - F.col("dp")) / 2.0
    return points.withColumn("area", area).groupBy(*by).agg(F.try_divide(F.sum("area"), F.max(F.col("p") * F.col("n"))).alias("roc_auc"))


def pr_scores(points: DataFrame, by: tuple[str, ...] = ("group",)) -> DataFrame:
    """(by, average_precision_scores): the step-wise area under precision over recall of the scores."""
    part = F.col("dp") * ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    return points.withColumn("part", part).groupBy(*by).agg(ratio(F.sum("part"), F.max("p")).alias("average_precision_scores"))


def youden(points: DataFrame, by: tuple[str, ...] = ("group",)) -> DataFrame:
    """(by, threshold, j): the highest score at which sensitivity + specificity - 1 is largest; where none is above 0, the highest plus one."""
    j = F.round(F.col("tp") / F.col("p") - F.col("fp") / F.col("n"), 12)
    best = points.filter("p > 0 and n > 0").groupBy(*by).agg(F.max_by("score", F.struct(j, F.col("score"))).alias("t"), F.max(j).alias("j"), F.max("score").alias("top"))
    return best.select(*by, F.when(F.col("j") > 0, F.col("t")).otherwise(F.col("top") + 1).alias("threshold"), F.greatest("j", F.lit(0.0)).alias("j"))


def thresholds(points: DataFrame, by: tuple[str, ...] = ("group",)) -> DataFrame:
    """(by, place, name, threshold): Youden's, one half, and those of specificity 99, 95, 90, 85 and 80 percent, in this order."""
    fixed = points.select(*by).distinct().withColumn("threshold", F.lit(0.5))
    rows = [youden(points, by).select(*by, F.lit(0).alias("place"), F.lit("youdens_j").alias("name"), "threshold"), fixed.select(*by, F.lit(1).alias("place"), F.lit("default").alias("name"), "threshold")]
    grid = roc_grid(points, by)
    names = F.coalesce(*(F.when(F.col("step") == i, F.struct(F.lit(2 + k).alias("place"), F.lit(f"sens_at_{s}").alias("name"))) for k, (s, i) in enumerate(SPECIFICITY_STEPS.items())))
    rows.append(grid.withColumn("s", names).filter("s is not null").select(*by, "s.place", "s.name", "threshold"))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def confusion(labelled: DataFrame, by: tuple[str, ...] = ("group",)) -> DataFrame:
    """(by, tn, fp, fn, tp) of (y, predicted), by weight where there is one."""
    w = F.col("weight") if "weight" in labelled.columns else F.lit(1)
    cell = lambda y, p: F.sum(F.when((F.col("y") == y) & (F.col("predicted") == p), w).otherwise(0)).cast("long")
    return labelled.groupBy(*by).agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))


def label_metrics(c: DataFrame, by: tuple[str, ...] = ("group",)) -> DataFrame:
    """Metrics of hard labels from a confusion matrix; 0 / 0 is 0. Average precision and PR area are those of the labels as scores."""
    tn, fp, fn, tp = (F.col(x).cast("double") for x in ("tn", "fp", "fn", "tp"))
    sens, spec, ppv, npv = ratio(tp, tp + fn), ratio(tn, tn + fp), ratio(tp, tp + fp), ratio(tn, tn + fn)
    base = ratio(tp + fn, tn + fp + fn + tp)
    mcc = ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    return c.select(
        *by, ((sens + spec) / 2).alias("balanced_accuracy"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), sens.alias("sensitivity"), spec.alias("specificity"), ppv.alias("ppv"), npv.alias("npv"),
        (sens * ppv + (1 - sens) * base).alias("average_precision"), F.when(tp + fp > 0, (sens * (1 + ppv) / 2) + (1 - sens) * (ppv + base) / 2).otherwise(base).alias("pr_auc"), mcc.alias("mcc"), "tn", "fp", "fn", "tp",
    )


def predict_labels(scored: DataFrame, threshold: DataFrame | float, by: tuple[str, ...] = ("group",)) -> DataFrame:
    """``scored`` with predicted: whether the score reaches the threshold (one for all, or a row a group)."""
    if isinstance(threshold, DataFrame):
        return scored.join(threshold.select(*by, "threshold"), list(by)).withColumn("predicted", (F.col("score") >= F.col("threshold")).cast("int"))
    return scored.withColumn("threshold", F.lit(threshold)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def metrics_at(scored: DataFrame, at: DataFrame, by: tuple[str, ...] = ("group",)) -> DataFrame:
    """Label metrics of every group at every named threshold of ``at`` (by, name, threshold), with exact AUC of the scores."""
    labelled = scored.join(at, list(by)).withColumn("predicted", (F.col("score") >= F.col("threshold")).cast("int"))
    keys = (*by, "name")
    points = roc_points(scored, by)
    return label_metrics(confusion(labelled, keys), keys).join(auc_exact(points, by), list(by), "left").join(pr_scores(points, by), list(by), "left")


def misclassified(labelled: DataFrame) -> DataFrame:
    """Rows whose predicted class is not theirs, by label and id."""
    return labelled.filter("predicted <> y").orderBy("label", "id")


def percentile_interval(values: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """(metric, mean, low, high): mean and the 2.5 and 97.5 percentiles, linear between values, rounded to five places."""
    means = values.groupBy(metric).agg(F.avg(value).alias("m"))
    return means.join(quantiles(values, (metric,), [0.025, 0.975], value), metric, "left").select(metric, F.round("m", 5).alias("mean"), F.round(F.col("q")[0], 5).alias("low"), F.round(F.col("q")[1], 5).alias("high"))


def fold_report(scored: DataFrame, by: tuple[str, ...] = ("group",)) -> DataFrame:
    """(metric, mean, low, high) over groups of auc, mcc, sensitivity, ppv and npv at each group's Youden threshold."""
    scored = counted(scored, by)
    points = roc_points(scored, by)
    hard = label_metrics(confusion(predict_labels(scored, youden(points, by), by), by), by)
    both = hard.join(grid_summary(roc_grid(points, by), by), list(by))
    long = both.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("auc", "mcc", "sensitivity", "ppv", "npv")))).alias("s")).select("s.*")
    return percentile_interval(long)


def pareto_front(trials: DataFrame, scores: list[str]) -> DataFrame:
    """Trials that no other is at least as good as in all ``scores`` and better in one. As many rows as a search has trials."""
    other = trials.select(*(F.col(s).alias(f"o_{s}") for s in scores))
    better = [F.col(f"o_{s}") >= F.col(s) for s in scores]
    some = [F.col(f"o_{s}") > F.col(s) for s in scores]
    al, an = better[0], some[0]
    for b, s in zip(better[1:], some[1:], strict=True):
        al, an = al & b, an | s
    return trials.join(other, al & an, "left_anti")
