"""Queries over the fixture tables, each with its DuckDB counterpart where SQL can say it.

The patient matrix is ``embeddings``: vec_id is the patient, the 64 components are the features, class 1 is label < 5. Rows with
vec_id divisible by 5 are the holdout, vec_id mod 4 is the plate, and a value is missing where (31 id + 17 feature) mod 10 is 0.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayloom.matrix import array_from_long, long_from_array
from assayloom.operators import batch, compare, folds, impute, information, labels, metrics, missing, neighbours, normalize, preprocess, resample, selection, stats
from assayloom.registry import query
from assayloom.runtime import shared_folder
from assayloom.sources.files import read_model

LONG_SQL = """
m AS (SELECT vec_id AS id, CASE WHEN label < 5 THEN 1 ELSE 0 END AS target, vec_id % 4 AS plate, vec_id % 5 = 0 AS holdout, embedding FROM embeddings),
cells AS (SELECT *, unnest(range(1, 65)) AS i FROM m),
long AS (SELECT id, target, plate, holdout, i - 1 AS fi, CAST(embedding[i] AS DOUBLE) AS value FROM cells),
gaps AS (SELECT id, target, plate, holdout, fi, CASE WHEN (id * 31 + fi * 17) % 10 = 0 THEN NULL ELSE value END AS value FROM long)
"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def patients(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").cast("long").alias("id"), (F.col("label") < 5).cast("int").alias("target"), (F.col("vec_id") % 4).alias("plate"), (F.col("vec_id") % 5 == 0).alias("holdout"), F.concat(F.lit("class_"), F.col("label").cast("string")).alias("label"), F.col("embedding").cast("array<double>").alias("x"))


def long(spark: SparkSession, sf: str, masked: bool = False) -> DataFrame:
    out = long_from_array(patients(spark, sf), "x", ["id", "target", "plate", "holdout", "label"])
    return out.withColumn("value", F.when((F.col("id") * 31 + F.col("fi") * 17) % 10 != 0, F.col("value"))) if masked else out


def r6(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles rounded to six places, minus zero as zero."""
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in columns})


def values(df: DataFrame) -> DataFrame:
    return r6(df.select("id", "fi", "value"), "value")


MOMENTS = "count(*) FILTER (target = 1 AND value IS NOT NULL) AS n1, count(*) FILTER (target = 0 AND value IS NOT NULL) AS n0, avg(value) FILTER (target = 1) AS m1, avg(value) FILTER (target = 0) AS m0, var_samp(value) FILTER (target = 1) AS v1, var_samp(value) FILTER (target = 0) AS v0"
T_SQL = f"""t AS (SELECT fi, (m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1.0 / n1 + 1.0 / n0)) AS t, CAST(n1 + n0 - 2 AS DOUBLE) AS df FROM (SELECT fi, {MOMENTS} FROM long GROUP BY fi))"""


@query(f"WITH {LONG_SQL}, {T_SQL} SELECT fi, round(t, 6) + 0.0 AS t, df FROM t ORDER BY abs(t) DESC, fi LIMIT 10")
def ttest_topk(spark: SparkSession, sf: str) -> DataFrame:
    t = stats.t_statistics(long(spark, sf)).orderBy(F.desc(F.abs("t")), "fi").limit(10)
    return r6(t, "t")


@query(f"WITH {LONG_SQL}, {T_SQL} SELECT fi, round(t, 6) + 0.0 AS t, df FROM t")
def ttest_all(spark: SparkSession, sf: str) -> DataFrame:
    return r6(stats.t_statistics(long(spark, sf)), "t")


@query(f"""WITH {LONG_SQL}, g AS (SELECT fi, target, count(*) AS n, sum(value) AS s, sum(value * value) AS q FROM long GROUP BY ALL),
a AS (SELECT fi, sum(n) AS n, count(*) AS k, sum(q) AS q, sum(s) AS s, sum(s * s / n) AS b FROM g GROUP BY fi)
SELECT fi, round(((b - s * s / n) / (k - 1)) / ((q - b) / (n - k)), 5) AS f, CAST(k - 1 AS DOUBLE) AS df1, CAST(n - k AS DOUBLE) AS df2 FROM a""")
def anova_f(spark: SparkSession, sf: str) -> DataFrame:
    return stats.anova_f(long(spark, sf)).withColumn("f", F.round("f", 5))


@query(f"""WITH {LONG_SQL}, f AS (SELECT fi, avg(value) AS mu, stddev_pop(value) AS sd FROM gaps WHERE NOT holdout GROUP BY fi)
SELECT id, fi, round((value - mu) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 6) + 0.0 AS value FROM gaps JOIN f USING (fi)""")
def zscore_train_holdout(spark: SparkSession, sf: str) -> DataFrame:
    g = long(spark, sf, True)
    return values(normalize.standardise(g, g.filter("not holdout")))


@query(f"""WITH {LONG_SQL}, f AS (SELECT fi, min(value) AS lo, max(value) AS hi FROM gaps WHERE NOT holdout GROUP BY fi)
SELECT id, fi, round(CASE WHEN value IS NULL THEN NULL WHEN hi = lo THEN 0 ELSE greatest(0, least(1, (value - lo) / (hi - lo))) END, 6) + 0.0 AS value FROM gaps JOIN f USING (fi)""")
def minmax_clip(spark: SparkSession, sf: str) -> DataFrame:
    g = long(spark, sf, True)
    return values(normalize.min_max_clip(g, g.filter("not holdout")))


@query(f"""WITH {LONG_SQL}, f AS (SELECT fi, median(value) AS md FROM gaps WHERE NOT holdout GROUP BY fi)
SELECT id, fi, round(value - md, 6) + 0.0 AS value FROM gaps JOIN f USING (fi)""")
def median_center(spark: SparkSession, sf: str) -> DataFrame:
    g = long(spark, sf, True)
    return values(normalize.centre_on_median(g, g.filter("not holdout")))


@query(f"WITH {LONG_SQL} SELECT id, fi, round(CASE WHEN value > 0 THEN log2(value) WHEN value = 0 THEN '-inf'::DOUBLE END, 6) AS value FROM gaps")
def log2_guarded(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.log2(long(spark, sf, True)).select("id", "fi", F.round("value", 6).alias("value"))


@query(f"""WITH {LONG_SQL}, r AS (SELECT fi, value, row_number() OVER (PARTITION BY fi ORDER BY value DESC NULLS LAST, id) AS k FROM gaps),
md AS (SELECT fi, median(value) AS md FROM r WHERE k <= 10 GROUP BY fi), mu AS (SELECT sum(md) / (SELECT count(DISTINCT id) FROM gaps) AS mu0 FROM md)
SELECT id, fi, round(value / (md / mu0), 6) + 0.0 AS value FROM gaps JOIN md USING (fi) CROSS JOIN mu""")
def top_l_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return values(normalize.top_l(long(spark, sf, True)))


@query(f"""WITH {LONG_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY value ASC NULLS LAST, fi) AS k FROM gaps), a AS (SELECT k, avg(value) AS m FROM r GROUP BY k)
SELECT id, fi, round(CASE WHEN value IS NULL THEN NULL ELSE coalesce(m, value) END, 6) + 0.0 AS value FROM r JOIN a USING (k)""")
def quantile_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return values(normalize.quantile_normalise(long(spark, sf, True)))


@query(f"WITH {LONG_SQL} SELECT id, fi, round(coalesce(value, avg(value) OVER (PARTITION BY fi)), 6) + 0.0 AS value FROM gaps")
def impute_mean(spark: SparkSession, sf: str) -> DataFrame:
    return values(impute.fill_mean(long(spark, sf, True)))


@query(f"WITH {LONG_SQL}, d AS (SELECT fi, median(value) AS md FROM gaps GROUP BY fi) SELECT id, fi, round(coalesce(value, md), 6) + 0.0 AS value FROM gaps JOIN d USING (fi)")
def impute_median(spark: SparkSession, sf: str) -> DataFrame:
    return values(impute.fill_median(long(spark, sf, True)))


@query(f"""WITH {LONG_SQL}, b AS (SELECT id, fi, round(value, 1) + 0.0 AS value FROM gaps), c AS (SELECT fi, value, count(*) AS n FROM b WHERE value IS NOT NULL GROUP BY ALL),
d AS (SELECT fi, value AS mode FROM (SELECT *, row_number() OVER (PARTITION BY fi ORDER BY n DESC, value) AS k FROM c) WHERE k = 1)
SELECT id, fi, coalesce(value, mode) AS value FROM b JOIN d USING (fi)""")
def impute_mode(spark: SparkSession, sf: str) -> DataFrame:
    return impute.fill_mode(long(spark, sf, True).withColumn("value", F.round("value", 1) + F.lit(0.0))).select("id", "fi", "value")


KNN_SQL = """d AS (SELECT a.id, b.id AS nid, round(sqrt(sum((a.value - b.value) * (a.value - b.value)) * 64.0 / count(*)), 12) AS d FROM {t} a JOIN {t} b ON a.fi = b.fi AND a.id <> b.id WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY ALL)"""


@query(f"""WITH {LONG_SQL}, {KNN_SQL.format(t="gaps")}, h AS (SELECT g.id, g.fi, n.value, row_number() OVER (PARTITION BY g.id, g.fi ORDER BY d.d, d.nid) AS k FROM gaps g JOIN d ON d.id = g.id JOIN gaps n ON n.id = d.nid AND n.fi = g.fi AND n.value IS NOT NULL WHERE g.value IS NULL),
f AS (SELECT id, fi, avg(value) AS v FROM h WHERE k <= 5 GROUP BY ALL) SELECT id, fi, round(coalesce(g.value, f.v), 5) + 0.0 AS value FROM gaps g LEFT JOIN f USING (id, fi)""")
def impute_knn(spark: SparkSession, sf: str) -> DataFrame:
    return impute.fill_knn(long(spark, sf, True)).select("id", "fi", (F.round("value", 5) + F.lit(0.0)).alias("value"))


@query(f"WITH {LONG_SQL} SELECT fi, round(1 - count(value) / count(*), 6) AS missing FROM gaps GROUP BY fi")
def missing_fraction(spark: SparkSession, sf: str) -> DataFrame:
    return r6(missing.missing_fraction(long(spark, sf, True)), "missing")


@query(f"WITH {LONG_SQL} SELECT fi, round(count(value) / count(*), 6) AS observed FROM gaps GROUP BY fi HAVING count(value) / count(*) > 0.5")
def observed_filter(spark: SparkSession, sf: str) -> DataFrame:
    return r6(missing.observed_features(long(spark, sf, True), 0.5), "observed")


@query(f"WITH {LONG_SQL} SELECT fi, CAST(target AS INT) AS target, count(*) FILTER (value IS NULL) AS gone, count(value) AS there FROM gaps GROUP BY ALL")
def missing_by_class(spark: SparkSession, sf: str) -> DataFrame:
    return missing.missing_by_class(long(spark, sf, True))


@query(f"""WITH {LONG_SQL}, c AS (SELECT fi, count(*) FILTER (value IS NULL AND target = 0)::DOUBLE AS g1, count(value) FILTER (target = 0)::DOUBLE AS t1, count(*) FILTER (value IS NULL AND target = 1)::DOUBLE AS g2, count(value) FILTER (target = 1)::DOUBLE AS t2 FROM gaps GROUP BY fi),
e AS (SELECT *, g1 + t1 + g2 + t2 AS n FROM c WHERE g1 + g2 > 0 AND t1 + t2 > 0 AND g1 + t1 > 0 AND g2 + t2 > 0), d AS (SELECT *, abs(g1 - (g1 + t1) * (g1 + g2) / n) AS o FROM e)
SELECT fi, 0 AS a, 1 AS b, round((o - least(0.5, o)) * (o - least(0.5, o)) * (n / ((g1 + t1) * (g1 + g2)) + n / ((g1 + t1) * (t1 + t2)) + n / ((g2 + t2) * (g1 + g2)) + n / ((g2 + t2) * (t1 + t2))), 6) AS chi2 FROM d""")
def mnar_chi2(spark: SparkSession, sf: str) -> DataFrame:
    return r6(missing.mnar_chi2(long(spark, sf, True)), "chi2")


@query()
def mnar_detected(spark: SparkSession, sf: str) -> DataFrame:
    return missing.detect_mnar(long(spark, sf, True))


RANK_SQL = "r AS (SELECT id, fi, rank() OVER (PARTITION BY fi ORDER BY value) + (count(*) OVER (PARTITION BY fi, value) - 1) / 2.0 AS r FROM long)"


@query(f"WITH {LONG_SQL}, {RANK_SQL} SELECT a.fi AS f_i, b.fi AS f_j, round(corr(a.r, b.r), 6) + 0.0 AS corr FROM r a JOIN r b ON a.id = b.id AND a.fi <= b.fi GROUP BY ALL")
def spearman_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return r6(stats.spearman(long(spark, sf)), "corr")


@query(f"""WITH {LONG_SQL}, w AS (SELECT fi, target, least(7, floor((value - min(value) OVER (PARTITION BY fi)) / (max(value) OVER (PARTITION BY fi) - min(value) OVER (PARTITION BY fi)) * 8)) AS b FROM long),
c AS (SELECT fi, b, target, count(*)::DOUBLE AS n FROM w GROUP BY ALL), d AS (SELECT *, sum(n) OVER (PARTITION BY fi, b) AS nb, sum(n) OVER (PARTITION BY fi, target) AS nt, sum(n) OVER (PARTITION BY fi) AS a FROM c)
SELECT fi, round(sum(n / a * ln(n * a / (nb * nt))), 6) + 0.0 AS mi FROM d GROUP BY fi""")
def mi_binned(spark: SparkSession, sf: str) -> DataFrame:
    return r6(information.binned_information(long(spark, sf)), "mi")


@query("SELECT CAST(CASE WHEN label < 5 THEN 1 ELSE 0 END AS INT) AS target, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM embeddings GROUP BY 1")
def effective_class_counts(spark: SparkSession, sf: str) -> DataFrame:
    n = resample.class_counts(patients(spark, sf))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6))


@query("SELECT 'class_' || label AS label, count(*) AS n FROM embeddings GROUP BY 1")
def label_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return patients(spark, sf).groupBy("label").agg(F.count("*").alias("n"))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """(group, id, y, score, label): four groups by plate, the score two decimals of the first feature, so that there are ties."""
    return patients(spark, sf).select(F.col("plate").alias("group"), "id", F.col("target").alias("y"), (F.round(F.col("x")[0], 2) + F.lit(0.0)).alias("score"), "label")


SCORES_SQL = "s AS (SELECT vec_id % 4 AS \"group\", vec_id AS id, CASE WHEN label < 5 THEN 1 ELSE 0 END AS y, round(CAST(embedding[1] AS DOUBLE), 2) + 0.0 AS score, 'class_' || label AS label FROM embeddings)"
POINTS_SQL = f"""{SCORES_SQL}, d AS (SELECT "group" AS g, score, sum(y) AS dp, sum(1 - y) AS dn FROM s GROUP BY ALL),
pts AS (SELECT g, score, sum(dp) OVER w AS tp, sum(dn) OVER w AS fp, sum(dp) OVER (PARTITION BY g) AS p, sum(dn) OVER (PARTITION BY g) AS n FROM d WINDOW w AS (PARTITION BY g ORDER BY score DESC))"""
GRID_SQL = """cur AS (SELECT g, score, fp / n AS fpr, tp / p AS tpr, 1 AS o FROM pts UNION ALL SELECT g, max(score), 0.0, 0.0, 0 FROM pts GROUP BY g),
seg AS (SELECT *, lead(fpr) OVER w AS fpr2, lead(tpr) OVER w AS tpr2, lead(score) OVER w AS score2 FROM cur WINDOW w AS (PARTITION BY g ORDER BY o, score DESC)),
grid AS (SELECT g, k AS step, tpr + CASE WHEN fpr2 > fpr THEN (k / 100.0 - fpr) / (fpr2 - fpr) ELSE 0 END * (coalesce(tpr2, tpr) - tpr) AS tpr, score + CASE WHEN fpr2 > fpr THEN (k / 100.0 - fpr) / (fpr2 - fpr) ELSE 0 END * (coalesce(score2, score) - score) AS threshold
FROM seg, range(0, 101) AS r(k) WHERE k >= ceil(fpr * 100 - 1e-9) AND (fpr2 IS NULL OR k < ceil(fpr2 * 100 - 1e-9)))"""
CURVE_SQL = f"{POINTS_SQL}, {GRID_SQL}"


@query(f"""WITH {POINTS_SQL} SELECT g AS "group", score, tp::BIGINT AS tp, fp::BIGINT AS fp, p::BIGINT AS p, n::BIGINT AS n FROM pts""")
def roc_points(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.roc_points(scores(spark, sf)).select("group", "score", "tp", "fp", "p", "n")


@query("""WITH s AS (SELECT l_discount AS score, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS y FROM lineitem), d AS (SELECT score, sum(y) AS dp, sum(1 - y) AS dn FROM s GROUP BY score)
SELECT CAST(0 AS BIGINT) AS "group", round(score, 6) AS score, sum(dp) OVER w ::BIGINT AS tp, sum(dn) OVER w ::BIGINT AS fp, sum(dp) OVER () ::BIGINT AS p, sum(dn) OVER () ::BIGINT AS n FROM d WINDOW w AS (ORDER BY score DESC)""")
def roc_points_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.lit(0).cast("long").alias("group"), F.col("l_discount").alias("score"), (F.col("l_linestatus") == "F").cast("int").alias("y"))
    return r6(metrics.roc_points(rows).select("group", "score", "tp", "fp", "p", "n"), "score")


@query(f"""WITH {CURVE_SQL} SELECT g AS "group", step, round(tpr, 6) + 0.0 AS tpr, round(threshold, 6) + 0.0 AS threshold FROM grid""")
def roc_grid_101(spark: SparkSession, sf: str) -> DataFrame:
    return r6(metrics.roc_grid(metrics.roc_points(scores(spark, sf))), "tpr", "threshold")


@query(f"""WITH {CURVE_SQL} SELECT g AS "group", round(sum(tpr * CASE WHEN step IN (0, 100) THEN 0.5 ELSE 1 END) / 100, 6) AS auc, {", ".join(f"round(max(tpr) FILTER (step = {i}), 6) + 0.0 AS sens_at_{s}" for s, i in metrics.SPECIFICITY_STEPS.items())} FROM grid GROUP BY g""")
def sens_at_spec(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.grid_summary(metrics.roc_grid(metrics.roc_points(scores(spark, sf))))
    return r6(out, *(c for c in out.columns if c != "group"))


@query(f"""WITH {SCORES_SQL}, r AS (SELECT "group", y, rank() OVER (PARTITION BY "group" ORDER BY score) + (count(*) OVER (PARTITION BY "group", score) - 1) / 2.0 AS r FROM s)
SELECT "group", round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) AS roc_auc FROM r GROUP BY 1""")
def auc_exact(spark: SparkSession, sf: str) -> DataFrame:
    return r6(metrics.auc_exact(metrics.roc_points(scores(spark, sf))), "roc_auc")


YOUDEN_SQL = f"""{POINTS_SQL}, yj AS (SELECT g, score, round(tp / p - fp / n, 12) AS j FROM pts), yb AS (SELECT g, CASE WHEN j > 0 THEN score ELSE top + 1 END AS threshold, greatest(j, 0) AS j FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY j DESC, score DESC) AS k, max(score) OVER (PARTITION BY g) AS top FROM yj) WHERE k = 1)"""


@query(f"""WITH {YOUDEN_SQL} SELECT g AS "group", round(threshold, 6) + 0.0 AS threshold, round(j, 6) AS j FROM yb""")
def youden_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return r6(metrics.youden(metrics.roc_points(scores(spark, sf))), "threshold", "j")


LABELLED_SQL = f"""{YOUDEN_SQL}, lab AS (SELECT s.*, CASE WHEN score >= threshold THEN 1 ELSE 0 END AS predicted FROM s JOIN yb ON s."group" = yb.g),
cm AS (SELECT "group", count(*) FILTER (y = 0 AND predicted = 0) AS tn, count(*) FILTER (y = 0 AND predicted = 1) AS fp, count(*) FILTER (y = 1 AND predicted = 0) AS fn, count(*) FILTER (y = 1 AND predicted = 1) AS tp FROM lab GROUP BY 1)"""


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    s = scores(spark, sf)
    return metrics.predict_labels(s, metrics.youden(metrics.roc_points(s)))


@query(f"WITH {LABELLED_SQL} SELECT * FROM cm")
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion(labelled(spark, sf))


@query(f"""WITH {LABELLED_SQL}, q AS (SELECT *, coalesce(tp / nullif(tp + fn, 0), 0) AS se, coalesce(tn / nullif(tn + fp, 0), 0) AS sp, coalesce(tp / nullif(tp + fp, 0), 0) AS pv, coalesce(tn / nullif(tn + fn, 0), 0) AS nv, (tp + fn) / (tn + fp + fn + tp) AS ba FROM cm)
SELECT "group", round((se + sp) / 2, 6) AS balanced_accuracy, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(se, 6) AS sensitivity, round(sp, 6) AS specificity, round(pv, 6) AS ppv, round(nv, 6) AS npv, round(se * pv + (1 - se) * ba, 6) AS average_precision,
round(CASE WHEN tp + fp > 0 THEN se * (1 + pv) / 2 + (1 - se) * (pv + ba) / 2 ELSE ba END, 6) AS pr_auc, round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) + 0.0 AS mcc, tn, fp, fn, tp FROM q""")
def threshold_metrics(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.label_metrics(metrics.confusion(labelled(spark, sf)))
    return r6(out, *(c for c, t in out.dtypes if t == "double"))


@query(f"""WITH {LABELLED_SQL} SELECT "group", id, CAST(y AS INT) AS y, score, label, CAST(predicted AS INT) AS predicted FROM lab WHERE predicted <> y""")
def misclassified_report(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.misclassified(labelled(spark, sf)).select("group", "id", "y", "score", "label", "predicted")


@query(f"""WITH {YOUDEN_SQL}, {GRID_SQL}, th AS (SELECT g, 'youdens_j' AS name, threshold FROM yb UNION ALL SELECT DISTINCT g, 'default', 0.5 FROM pts UNION ALL SELECT g, CASE step WHEN 1 THEN 'sens_at_99' WHEN 5 THEN 'sens_at_95' WHEN 10 THEN 'sens_at_90' WHEN 15 THEN 'sens_at_85' ELSE 'sens_at_80' END, threshold FROM grid WHERE step IN (1, 5, 10, 15, 20))
SELECT g AS "group", name, round(threshold, 6) + 0.0 AS threshold FROM th""")
def threshold_family(spark: SparkSession, sf: str) -> DataFrame:
    return r6(metrics.thresholds(metrics.roc_points(scores(spark, sf))).select("group", "name", "threshold"), "threshold")


@query(f"""WITH {LONG_SQL} SELECT 'f' || fi AS metric, round(avg(value), 5) + 0.0 AS mean, round(quantile_cont(value, 0.025), 5) + 0.0 AS low, round(quantile_cont(value, 0.975), 5) + 0.0 AS high FROM long GROUP BY fi""")
def percentile_ci(spark: SparkSession, sf: str) -> DataFrame:
    rows = long(spark, sf).select(F.concat(F.lit("f"), F.col("fi").cast("string")).alias("metric"), "value")
    return metrics.percentile_interval(rows).withColumns({c: F.col(c) + F.lit(0.0) for c in ("mean", "low", "high")})


FOLD_SQL = "md5(concat_ws('-', '0', rep, vec_id))"


@query(f"""WITH r AS (SELECT *, unnest(range(0, 3)) AS rep FROM embeddings) SELECT rep AS repeat, vec_id AS id, (row_number() OVER (PARTITION BY rep, label < 5 ORDER BY {FOLD_SQL}, vec_id) - 1) % 5 AS fold FROM r""")
def kfold_assign(spark: SparkSession, sf: str) -> DataFrame:
    return folds.repeated_stratified_folds(patients(spark, sf).select("id", "target"), 5, 3).select("repeat", "id", "fold")


@query(f"""WITH r AS (SELECT *, unnest(range(0, 3)) AS rep FROM embeddings) SELECT rep AS repeat, vec_id AS id, row_number() OVER (PARTITION BY rep ORDER BY {FOLD_SQL}, vec_id) <= ceil(0.3 * count(*) OVER (PARTITION BY rep)) AS test FROM r""")
def shuffle_split(spark: SparkSession, sf: str) -> DataFrame:
    return folds.shuffle_splits(patients(spark, sf).select("id"), 3).select("repeat", "id", "test")


@query("SELECT vec_id AS id, row_number() OVER (PARTITION BY label < 5 ORDER BY md5(concat_ws('-', '0', vec_id)), vec_id) <= floor(0.1 * count(*) OVER (PARTITION BY label < 5) + 0.5) AS test FROM embeddings")
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return folds.stratified_split(patients(spark, sf).select("id", "target"), 0.1).select("id", "test")


@query("""WITH r AS (SELECT vec_id AS id, CAST(label < 5 AS INT) AS target, row_number() OVER (PARTITION BY label < 5 ORDER BY md5(concat_ws('-', '0', vec_id)), vec_id) AS k FROM embeddings), n AS (SELECT min(c) AS n FROM (SELECT count(*) AS c FROM r GROUP BY target)) SELECT id, target FROM r, n WHERE k <= n""")
def undersample_balanced(spark: SparkSession, sf: str) -> DataFrame:
    rows = patients(spark, sf).select("id", "target")
    least = min(resample.counts_of(rows))
    return resample.down_sample(rows, {0: least, 1: least})


NEAR_SQL = f"""WITH {LONG_SQL}, {KNN_SQL.format(t="long")}, nn AS (SELECT id, nid, d, row_number() OVER (PARTITION BY id ORDER BY d, nid) AS k FROM d)"""


@query(f"{NEAR_SQL} SELECT id, nid, CAST(k AS INT) AS rank, round(d, 6) AS distance FROM nn WHERE k <= 5")
def nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return r6(neighbours.nearest(patients(spark, sf).select("id", "x"), 5), "distance")


@query(f"""WITH {LONG_SQL}, pairs AS (SELECT a.id, b.id AS nid, sum(coalesce(abs(a.value - b.value) / nullif(abs(a.value) + abs(b.value), 0), 0)) AS canberra, sum(abs(a.value - b.value)) / sum(abs(a.value + b.value)) AS braycurtis,
sum(abs(a.value - b.value) ** 3) ** (1.0 / 3) AS minkowski, avg(CASE WHEN a.value <> b.value THEN 1.0 ELSE 0.0 END) AS hamming FROM long a JOIN long b ON a.fi = b.fi AND a.id <> b.id GROUP BY ALL),
named AS (UNPIVOT pairs ON canberra, braycurtis, minkowski, hamming INTO NAME metric VALUE d)
SELECT metric, id, nid, CAST(k AS INT) AS rank, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY metric, id ORDER BY round(d, 12), nid) AS k FROM named) WHERE k <= 3""")
def nearest_by_metric(spark: SparkSession, sf: str) -> DataFrame:
    """The three nearest patients of each by four distances."""
    rows, out = patients(spark, sf).select("id", "x"), None
    for metric in ("canberra", "braycurtis", "minkowski", "hamming"):
        found = neighbours.nearest(rows, 3, metric=metric).select(F.lit(metric).alias("metric"), "id", "nid", "rank", "distance")
        out = found if out is None else out.unionByName(found)
    return r6(out, "distance")


@query(f"""WITH {LONG_SQL}, c AS (SELECT CASE WHEN sum(target) <= count(*) - sum(target) THEN 1 ELSE 0 END AS small FROM m), own AS (SELECT long.* FROM long, c WHERE target = small), {KNN_SQL.format(t="own")}
SELECT id, nid, CAST(k AS INT) AS rank FROM (SELECT id, nid, row_number() OVER (PARTITION BY id ORDER BY d, nid) AS k FROM d) WHERE k <= 5""")
def smote_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    return resample.smote_neighbours(patients(spark, sf)).select("id", "nid", "rank")


@query(f"{NEAR_SQL}, o AS (SELECT id, nid FROM nn WHERE k = 1) SELECT a.id AS a, a.nid AS b FROM o a JOIN o b ON a.nid = b.id AND b.nid = a.id JOIN m x ON x.id = a.id JOIN m y ON y.id = a.nid WHERE a.id < a.nid AND x.target <> y.target")
def tomek_links(spark: SparkSession, sf: str) -> DataFrame:
    return resample.tomek_links(patients(spark, sf))


@query(f"{NEAR_SQL} SELECT id FROM m WHERE id NOT IN (SELECT nn.id FROM nn JOIN m x ON x.id = nn.id JOIN m y ON y.id = nn.nid WHERE k <= 3 AND x.target <> y.target)")
def enn_filter(spark: SparkSession, sf: str) -> DataFrame:
    return resample.edited(patients(spark, sf)).select("id")


@query("""WITH c AS (SELECT count(*) FILTER (label < 5) AS n1, count(*) FILTER (label >= 5) AS n0 FROM embeddings), w AS (SELECT *, CAST(round_even(1000 / 1.5, 0) AS BIGINT) AS h FROM c) SELECT CAST(0 AS BIGINT) AS target, h - n0 AS delta FROM w UNION ALL SELECT 1, 1000 - h - n1 FROM w""")
def augment_counts(spark: SparkSession, sf: str) -> DataFrame:
    return resample.delta_table(patients(spark, sf), 0.5, 1000)


T_ALL = f"WITH {LONG_SQL}, {T_SQL}, i AS (SELECT fi, round(abs(t), 6) AS importance FROM t), k AS (SELECT *, row_number() OVER (ORDER BY importance DESC, fi) AS step FROM i)"


def t_importance(spark: SparkSession, sf: str) -> DataFrame:
    return stats.t_statistics(long(spark, sf)).select("fi", F.round(F.abs("t"), 6).alias("importance"))


@query(f"{T_ALL} SELECT a.step, b.fi FROM k a JOIN k b ON b.importance >= a.importance")
def rfa_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    return selection.prefix_features(t_importance(spark, sf))


@query(f"{T_ALL}, r AS (SELECT step AS rank, fi, round(sin(step), 6) AS mean_mcc FROM k) SELECT * FROM r WHERE rank <= (SELECT min(rank) FROM r WHERE mean_mcc = (SELECT max(mean_mcc) FROM r))")
def rfa_prefix_best(spark: SparkSession, sf: str) -> DataFrame:
    from assayloom.operators.ranking import ranks

    r = ranks(t_importance(spark, sf)).select("rank", "fi", F.round(F.sin(F.col("rank").cast("double")), 6).alias("mean_mcc"))
    return selection.best_prefix(r, "mean_mcc")


SUMMARY_SQL = f"WITH {LONG_SQL}, r AS (SELECT fi + 1 AS rank, avg(value) AS mean_mcc, stddev_pop(value) AS std_mcc FROM long GROUP BY fi)"


def summaries(spark: SparkSession, sf: str) -> DataFrame:
    return long(spark, sf).groupBy("fi").agg(F.avg("value").alias("mean_mcc"), F.stddev_pop("value").alias("std_mcc")).select((F.col("fi") + 1).alias("rank"), "mean_mcc", "std_mcc")


@query(f"{SUMMARY_SQL}, b AS (SELECT mean_mcc AS bm, std_mcc AS bs FROM r ORDER BY mean_mcc DESC, rank LIMIT 1) SELECT rank, round((bm - mean_mcc) / sqrt((bs * bs + std_mcc * std_mcc) / 2 * (2.0 / 50)), 6) + 0.0 AS t_statistic_mcc, CAST(98 AS DOUBLE) AS df FROM r, b")
def summary_t_vs_best(spark: SparkSession, sf: str) -> DataFrame:
    return r6(stats.t_from_summary(summaries(spark, sf), "mcc", 50).select("rank", "t_statistic_mcc", "df"), "t_statistic_mcc")


@query(f"{SUMMARY_SQL} SELECT round(mean_mcc / std_mcc, 6) + 0.0 AS stability, rank FROM r")
def stability(spark: SparkSession, sf: str) -> DataFrame:
    return r6(summaries(spark, sf).select(F.try_divide("mean_mcc", "std_mcc").alias("stability"), "rank"), "stability")


P_SQL = f"WITH {LONG_SQL}, {T_SQL}, p AS (SELECT fi, fi % 4 AS family, round(1 / (1 + t * t), 6) AS p FROM t)"


@query(f"""{P_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p) AS r, count(*) OVER (PARTITION BY family) AS m FROM p)
SELECT fi, round(least(1, min(p * m / r) OVER (PARTITION BY family ORDER BY r DESC ROWS UNBOUNDED PRECEDING)), 6) AS p_adjusted FROM k""")
def bh_adjust(spark: SparkSession, sf: str) -> DataFrame:
    p = stats.t_statistics(long(spark, sf)).select("fi", (F.col("fi") % 4).alias("family"), F.round(1 / (1 + F.col("t") * F.col("t")), 6).alias("p"))
    return r6(stats.benjamini_hochberg(p, "p", ("family",)).select("fi", "p_adjusted"), "p_adjusted")


@query(f"{P_SQL.replace('AS p FROM t', 'AS p_value_mcc, fi + 1 AS rank FROM t')} SELECT rank, p_value_mcc FROM p WHERE p_value_mcc <= 0.2 AND rank <= (SELECT min(rank) FROM p WHERE p_value_mcc = (SELECT max(p_value_mcc) FROM p))")
def panel_below_best(spark: SparkSession, sf: str) -> DataFrame:
    p = stats.t_statistics(long(spark, sf)).select((F.col("fi") + 1).alias("rank"), F.round(1 / (1 + F.col("t") * F.col("t")), 6).alias("p_value_mcc"))
    return selection.panel_below_best(p, "mcc", 0.2)


@query("""WITH b AS (SELECT p_partkey, CASE WHEN p_partkey % 97 = 0 THEN p_type || ' ' || p_partkey ELSE p_type END AS label FROM part), c AS (SELECT label, count(*) AS n FROM b GROUP BY 1),
q AS (SELECT o.label AS old, k.label AS new, row_number() OVER (PARTITION BY o.label ORDER BY levenshtein(o.label, k.label), k.n DESC, k.label) AS r FROM c o, c k WHERE o.n <= 1 AND k.n > 1 AND o.label <> k.label)
SELECT p_partkey, coalesce(q.new, label) AS label FROM b LEFT JOIN q ON q.old = label AND r = 1""")
def rare_label_levenshtein(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    odd = F.when(F.col("p_partkey") % 97 == 0, F.concat("p_type", F.lit(" "), F.col("p_partkey").cast("string"))).otherwise(F.col("p_type"))
    return labels.repair_labels(p.select("p_partkey", odd.alias("label")))


@query("SELECT c_custkey, c_mktsegment || ' @ ' || coalesce(CASE WHEN n_nationkey % 7 <> 0 THEN n_name END, 'None') AS label FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def cohort_label_enrich(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("patient_id"), F.when(F.col("n_nationkey") % 7 != 0, F.col("n_name")).alias("site"))
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("patient_id"), "c_custkey", F.col("c_mktsegment").alias("label"))
    return labels.enrich_labels(c, n, "a").select("c_custkey", "label")


@query("SELECT p_partkey, p_type AS label FROM part WHERE regexp_matches(p_type, '(?i)(promo|small)')")
def subcohort_regex(spark: SparkSession, sf: str) -> DataFrame:
    return labels.sub_cohort(table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("label")), "(promo|small)")


@query("SELECT 'missing_in_both_or_neither' AS \"check\", true AS ok UNION ALL SELECT 'key_present', true UNION ALL SELECT 'ids_in_cohort', NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))")
def integrity_check(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("patient_id"), "o_orderkey", "o_totalprice")
    return labels.integrity(o.filter("o_orderkey % 5 <> 0"), o.filter("o_orderkey % 5 = 0"), table(spark, sf, "customer").withColumnRenamed("c_custkey", "patient_id"))


@query(f"""WITH {LONG_SQL}, i AS (SELECT plate, fi, round(abs(avg(value)), 6) AS importance FROM long WHERE plate < 3 AND NOT (plate = 1 AND fi % 5 = 0) GROUP BY ALL)
SELECT 'f' || fi AS feature, coalesce(max(importance) FILTER (plate = 0), 0) AS m0, coalesce(max(importance) FILTER (plate = 1), 0) AS m1, coalesce(max(importance) FILTER (plate = 2), 0) AS m2, round((coalesce(max(importance) FILTER (plate = 0), 0) + coalesce(max(importance) FILTER (plate = 1), 0) + coalesce(max(importance) FILTER (plate = 2), 0)) / 3, 5) AS average FROM i GROUP BY fi""")
def compare_models_pivot(spark: SparkSession, sf: str) -> DataFrame:
    i = long(spark, sf).filter("plate < 3 and not (plate = 1 and fi % 5 = 0)").groupBy("plate", "fi").agg(F.round(F.abs(F.avg("value")), 6).alias("importance"))
    named = i.select(F.concat(F.lit("m"), F.col("plate").cast("string")).alias("model"), F.concat(F.lit("f"), F.col("fi").cast("string")).alias("feature"), "importance")
    return compare.compare_models(named).withColumn("average", F.round("average", 5))


@query(f"WITH {LONG_SQL}, i AS (SELECT plate, fi, round(avg(value), 6) AS importance FROM long GROUP BY ALL) SELECT fi, count(*) FILTER (importance > 0) AS count, round(avg(importance), 6) + 0.0 AS mean FROM i GROUP BY fi HAVING count(*) FILTER (importance > 0) >= 2")
def importance_count_filter(spark: SparkSession, sf: str) -> DataFrame:
    i = long(spark, sf).groupBy("plate", "fi").agg(F.round(F.avg("value"), 6).alias("importance"))
    return r6(selection.importance_counts(i).filter("count >= 2"), "mean")


@query("""WITH t AS (SELECT n_nationkey AS trial, round(avg(c_acctbal), 2) AS a, round(-stddev_pop(c_acctbal), 2) AS b FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT CAST(trial AS INT) AS trial, a, b FROM t WHERE NOT EXISTS (SELECT 1 FROM t u WHERE u.a >= t.a AND u.b >= t.b AND (u.a > t.a OR u.b > t.b))""")
def pareto_front(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_nationkey").alias("trial")).agg(F.round(F.avg("c_acctbal"), 2).alias("a"), F.round(-F.stddev_pop("c_acctbal"), 2).alias("b"))
    return metrics.pareto_front(t, ["a", "b"])


@query(f"""WITH {LONG_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY fi ORDER BY id) AS k FROM long), b AS (SELECT fi, value, row_number() OVER (PARTITION BY fi ORDER BY md5(concat_ws('-', '0', fi, id)), id) AS k FROM long), q AS (SELECT a.fi, a.target, b.value FROM a JOIN b USING (fi, k)),
w AS (SELECT fi, target, least(7, floor((value - min(value) OVER (PARTITION BY fi)) / (max(value) OVER (PARTITION BY fi) - min(value) OVER (PARTITION BY fi)) * 8)) AS b FROM q), c AS (SELECT fi, b, target, count(*)::DOUBLE AS n FROM w GROUP BY ALL), d AS (SELECT *, sum(n) OVER (PARTITION BY fi, b) AS nb, sum(n) OVER (PARTITION BY fi, target) AS nt, sum(n) OVER (PARTITION BY fi) AS a FROM c), mi AS (SELECT fi, sum(n / a * ln(n * a / (nb * nt))) AS mi FROM d GROUP BY fi)
SELECT round(quantile_cont(mi, 0.9), 6) AS threshold FROM mi""")
def permuted_null_quantile(spark: SparkSession, sf: str) -> DataFrame:
    return r6(information.noise_threshold(information.binned_information(information.permuted(long(spark, sf))), 0.9), "threshold")


@query(f"""WITH {LONG_SQL}, b AS (SELECT plate, fi, count(value)::DOUBLE AS n, avg(value) AS m, var_pop(value) AS v FROM gaps GROUP BY ALL), g AS (SELECT fi, sum(n * m) / sum(n) AS grand, sum(n * v) / sum(n) AS pooled FROM b GROUP BY fi)
SELECT plate, fi, n::BIGINT AS n, round(grand, 6) + 0.0 AS grand, round(pooled, 6) AS pooled, round((m - grand) / sqrt(pooled), 6) + 0.0 AS gamma, round(v * n / (n - 1) / pooled, 6) AS delta2 FROM b JOIN g USING (fi)""")
def combat_location_scale(spark: SparkSession, sf: str) -> DataFrame:
    return r6(batch.location_scale(long(spark, sf, True), "plate"), "grand", "pooled", "gamma", "delta2")


@query(f"""WITH {LONG_SQL}, q AS (SELECT id, quantile_cont(value, 0.0001) AS mean FROM gaps GROUP BY id), s AS (SELECT fi, stddev_pop(value) AS sd FROM gaps GROUP BY fi HAVING count(value) / count(*) > 0.5) SELECT id, round(mean, 6) + 0.0 AS mean, round((SELECT median(sd) FROM s), 6) AS sd FROM q""")
def minprob_parameters(spark: SparkSession, sf: str) -> DataFrame:
    at, sd = impute.minprob_parameters(long(spark, sf, True))
    return r6(at.crossJoin(F.broadcast(sd)), "mean", "sd")


@query(f"""WITH {LONG_SQL}, {T_SQL}, a AS (SELECT fi FROM t WHERE abs(t) > 1), b AS (SELECT fi FROM long GROUP BY fi HAVING avg(value) > 0)
SELECT fi, fi IN (SELECT fi FROM a) AS in_a, fi IN (SELECT fi FROM b) AS in_b FROM (SELECT fi FROM a UNION SELECT fi FROM b)""")
def feature_union(spark: SparkSession, sf: str) -> DataFrame:
    rows = long(spark, sf)
    a = stats.t_statistics(rows).filter(F.abs("t") > 1).select("fi", F.lit(True).alias("in_a"))
    b = rows.groupBy("fi").agg(F.avg("value").alias("v")).filter("v > 0").select("fi", F.lit(True).alias("in_b"))
    return a.join(b, "fi", "full").select("fi", F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b"))


@query(f"WITH {LONG_SQL}, {T_SQL}, k AS (SELECT fi FROM t WHERE abs(t) > 1) SELECT fi, count(*) AS n FROM long WHERE fi IN (SELECT fi FROM k) GROUP BY fi")
def feature_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    rows = long(spark, sf)
    return rows.join(stats.t_statistics(rows).filter(F.abs("t") > 1).select("fi"), "fi", "left_semi").groupBy("fi").agg(F.count("*").alias("n"))


@query(f"WITH {LONG_SQL} SELECT id, plate, round(avg(value), 6) + 0.0 AS mean, max(holdout) AS holdout FROM gaps GROUP BY ALL")
def train_holdout_union(spark: SparkSession, sf: str) -> DataFrame:
    rows = long(spark, sf, True)
    both = rows.filter("not holdout").unionByName(rows.filter("holdout"))
    return r6(both.groupBy("id", "plate").agg(F.avg("value").alias("mean"), F.max("holdout").alias("holdout")), "mean")


@query(f"WITH {LONG_SQL} SELECT id, fi, round(value, 6) + 0.0 AS value, CAST(k AS INT) AS k FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(value) DESC, fi) AS k FROM long) WHERE k <= 3")
def top_by_absolute(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("id").orderBy(F.desc(F.abs("value")), "fi")
    return r6(long(spark, sf).withColumn("k", F.row_number().over(w)).filter("k <= 3").select("id", "fi", "value", "k"), "value")


@query("SELECT * FROM (SELECT n_name AS pipeline, round(avg(c_acctbal), 2) AS sen_95, round(max(c_acctbal), 2) AS roc_auc, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) ORDER BY sen_95 DESC, roc_auc DESC, pipeline LIMIT 5")
def best_pipelines(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    scores = rows.groupBy(F.col("n_name").alias("pipeline")).agg(F.round(F.avg("c_acctbal"), 2).alias("sen_95"), F.round(F.max("c_acctbal"), 2).alias("roc_auc"), F.count("*").alias("n"))
    return preprocess.best_of(scores, ("sen_95", "roc_auc"))


SCALED_SQL = f"""{LONG_SQL}, tr AS (SELECT * FROM gaps WHERE NOT holdout), fit AS (SELECT fi, min(value) AS lo, max(value) AS hi, median(value) AS md FROM tr GROUP BY fi),
rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY value NULLS LAST, fi) AS k FROM gaps), rm AS (SELECT k, avg(value) AS m FROM rk WHERE NOT holdout GROUP BY k),
sc AS (SELECT 'none' AS scaler, id, holdout, fi, value FROM gaps
UNION ALL SELECT 'min_max', id, holdout, fi, CASE WHEN value IS NULL THEN NULL WHEN hi = lo THEN 0 ELSE greatest(0, least(1, (value - lo) / (hi - lo))) END FROM gaps JOIN fit USING (fi)
UNION ALL SELECT 'median', id, holdout, fi, value - md FROM gaps JOIN fit USING (fi)
UNION ALL SELECT 'log2', id, holdout, fi, CASE WHEN value > 0 THEN log2(value) END FROM gaps
UNION ALL SELECT 'quantile', id, holdout, fi, CASE WHEN value IS NOT NULL THEN coalesce(m, value) END FROM rk LEFT JOIN rm USING (k)),
mu AS (SELECT scaler, fi, avg(value) AS mu FROM sc WHERE NOT holdout GROUP BY ALL)"""


@query(f"WITH {SCALED_SQL} SELECT scaler || '_none_' || last AS pipeline, id, CAST(fi AS INT) AS place, round(CASE WHEN last = 'mean' THEN coalesce(value, mu) ELSE value END, 6) + 0.0 AS value FROM sc JOIN mu USING (scaler, fi), (VALUES ('mean'), ('none')) AS x(last)")
def pipelines_completed(spark: SparkSession, sf: str) -> DataFrame:
    """Every scaler with and without means in the gaps, fitted on the training rows: ten pipelines in one job."""
    tried = [{"scaler": s, "mnar": None, "mar": m} for s in ("none", "min_max", "median", "log2", "quantile") for m in ({"method": "mean"}, None)]
    split = long(spark, sf, True).select("id", "target", F.col("holdout").alias("test"), "fi", "value")
    return r6(preprocess.completed_cells(split, tried), "value")


@query(f"WITH {SCALED_SQL}, fl AS (SELECT scaler, fi, median(value) AS fill FROM sc WHERE NOT holdout GROUP BY ALL) SELECT scaler, id, fi, round(coalesce(value, fill), 6) + 0.0 AS value FROM sc JOIN fl USING (scaler, fi) WHERE holdout AND scaler IN ('min_max', 'quantile')")
def stored_preprocessing(spark: SparkSession, sf: str) -> DataFrame:
    """Two pipelines fitted on the training rows, stored, loaded again and applied to the holdout."""
    rows, out = long(spark, sf, True).select("id", "target", "holdout", "fi", "value"), None
    for name in ("min_max", "quantile"):
        fitted = preprocess.pipeline({"scaler": name, "mnar": None, "mar": {"method": "median"}}).fit(rows.filter("not holdout"))
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        fitted.write().save(path)
        done = read_model(path).transform(rows.filter("holdout")).select(F.lit(name).alias("scaler"), "id", "fi", "value")
        out = done if out is None else out.unionByName(done)
    return r6(out, "value")


@query(f"""WITH {LONG_SQL}, c AS (SELECT fi, label, avg(value) AS c FROM (SELECT long.*, 'class_' || e.label AS label FROM long JOIN embeddings e ON e.vec_id = long.id) WHERE label <> 'class_9' GROUP BY ALL), s AS (SELECT long.id, c.label, corr(value, c) AS r FROM long JOIN embeddings e ON e.vec_id = long.id AND e.label = 9 JOIN c USING (fi) GROUP BY ALL)
SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY r DESC, label) AS k FROM s) WHERE k = 1""")
def rare_label_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return labels.most_correlated_label(long(spark, sf), ["class_9"])


def arrays(spark: SparkSession, sf: str) -> DataFrame:
    return patients(spark, sf).select("id", "target", "x")


def masked_arrays(spark: SparkSession, sf: str) -> DataFrame:
    return array_from_long(long(spark, sf, True), ["id", "target"])
