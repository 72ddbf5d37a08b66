"""Reading the three related tables, and whatever else a run stores, by Spark's readers only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.config import Options, Settings
from assayloom.matrix import long_from_wide, nan_to_null, numeric_columns
from assayloom.operators.forest import NODES, Forest, from_nodes
from assayloom.operators.labels import check, sub_cohort
from assayloom.operators.normalize import pca_scores, standardise

#: Names that a cohort file may have, in the order they are tried, and columns that a written index left behind.
COHORT_FILES = ("labelled_cohort.csv", "patient_metadata.csv", "cohort.csv", "metadata.csv")
INDEX_COLUMNS = ("Unnamed: 0", "_c0")


@dataclass(frozen=True)
class Extracted:
    train: DataFrame
    holdout: DataFrame
    cohort: DataFrame


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def drop_index(df: DataFrame) -> DataFrame:
    return df.drop(*INDEX_COLUMNS)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """By what the name contains: .txt is tab-separated, .csv comma-separated, all else Parquet; index columns are dropped."""
    if ".txt" in path or ".csv" in path:
        return nan_to_null(drop_index(spark.read.option("header", True).option("inferSchema", True).option("sep", "\t" if ".txt" in path else ",").csv(path)))
    return nan_to_null(drop_index(spark.read.parquet(path)))


def read_model(path: str) -> PipelineModel:
    """A stored pipeline; Python pickles are not read."""
    return PipelineModel.load(path)


def read_forest(spark: SparkSession, path: str) -> Forest:
    """A run's model from the table of its nodes."""
    return from_nodes(read_table(spark, path).select(*(c.split()[0] for c in NODES.split(", "))).collect())  # as many rows as one model has nodes


def read_or_fallback(spark: SparkSession, path: str, model: str) -> DataFrame | None:
    """The table, or that of the same name after ``<model>_``, or None."""
    folder, _, name = path.rpartition("/")
    for p in (path, f"{folder}/{model}_{name}" if folder else f"{model}_{name}"):
        if exists(spark, p):
            return read_table(spark, p)
    return None


def list_files(spark: SparkSession, pattern: str, containing: tuple[str, ...] = (), recursive: bool = False) -> list[str]:
    """Files that a glob matches, or that lie anywhere under what it matches if ``recursive``, and whose names contain all of
    ``containing``; none is an error."""
    fs, p = _fs(spark, pattern)
    paths = [s.getPath() for s in fs.globStatus(p) or ()]
    if recursive:
        inside = []
        for top in paths:
            files = fs.listFiles(top, True)
            while files.hasNext():
                inside.append(files.next().getPath())
        paths = inside
    found = sorted(str(q) for q in paths if all(c in q.getName() for c in containing))
    if not found:
        raise FileNotFoundError(pattern)
    return found


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """A table of runs, a row a run, with all columns as text; for spreadsheets save them as CSV."""
    if ".txt" in path or ".csv" in path:
        return drop_index(spark.read.option("header", True).option("sep", "\t" if ".txt" in path else ",").csv(path))
    return read_table(spark, path)


def _kind(path: str) -> str:
    return "txt" if ".txt" in path else "csv" if ".csv" in path else "parquet"


#: The path a row is from as list_files gives it: decoded, and for a table in parts the folder of these.
SOURCE = "regexp_replace(regexp_replace(url_decode(replace(_metadata.file_path, '+', '%2B')), '^file:/+', 'file:/'), '/part-[^/]*$', '')"


def read_many(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Tables of any number of files in one frame, with the path each row is from as source; columns may differ, index columns are dropped.

    Texts are read in one scan for each header there is, Parquet in one for all, with the schemas merged. Headers are read once, a row a file."""
    scans = []
    for kind in ("txt", "csv", "parquet"):
        own = [p for p in paths if _kind(p) == kind]
        if kind == "parquet":
            scans += [spark.read.option("mergeSchema", True).parquet(*own)] if own else []
            continue
        sep = "\t" if kind == "txt" else ","
        heads = spark.read.text(own).select(F.expr(SOURCE).alias("path"), F.monotonically_increasing_id().alias("k"), "value").groupBy("path").agg(F.min_by("value", "k").alias("head")) if own else None
        by_head: dict[str, list[str]] = {}
        for r in heads.collect() if own else []:  # a row a file
            by_head.setdefault(r.head, []).append(r.path)
        scans += [spark.read.option("header", True).option("inferSchema", True).option("sep", sep).csv(sorted(group)) for _, group in sorted(by_head.items())]
    out = None
    for scan in scans:
        one = nan_to_null(drop_index(scan.select("*", F.expr(SOURCE).alias("source"))))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def read_folder(spark: SparkSession, pattern: str, containing: tuple[str, ...] = (), recursive: bool = False) -> DataFrame:
    """All matching files in one frame with the file each row is from as source; columns may differ."""
    return read_many(spark, list_files(spark, pattern, containing, recursive))


def model_name(path: str) -> str:
    """What follows the last ``rfe_important_features_`` in a result's file name, without its ending."""
    return path.rpartition("/")[2].rpartition("rfe_important_features_")[2].rpartition(".")[0]


def read_results(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Result tables with their model's name, as model_name says."""
    name = F.regexp_extract("source", r"^(?:.*/)?(?:[^/]*rfe_important_features_)?([^/]*)\.[^./]*$", 1)
    return read_many(spark, paths).withColumn("model", name).drop("source")


def extract(spark: SparkSession, folder: str, cohort: str | None = None) -> Extracted:
    """train.csv, holdout.csv and the first cohort file there is (or ``cohort``); a missing one is an error."""
    folder = folder.rstrip("/")
    if not exists(spark, folder):
        raise FileNotFoundError(folder)
    paths = [f"{folder}/train.csv", f"{folder}/holdout.csv"]
    third = cohort or next((p for c in COHORT_FILES if exists(spark, p := f"{folder}/{c}")), None)
    if third is None:
        raise FileNotFoundError(f"{folder}: none of {', '.join(COHORT_FILES)}")
    for p in (*paths, third):
        if not exists(spark, p):
            raise FileNotFoundError(p)
    return Extracted(*(read_table(spark, p) for p in (*paths, third)))


def _scaled(train: DataFrame, df: DataFrame, key: str) -> DataFrame:
    features = numeric_columns(train)
    rest = [c for c in df.columns if c not in features]
    long_of = lambda d: long_from_wide(d, features, [key])
    cells = standardise(long_of(df), long_of(train)).groupBy(key).pivot("feature", features).agg(F.first("value"))
    return df.select(*rest).join(cells, key).select(*df.columns)


def load(spark: SparkSession, options: Options, settings: Settings) -> Extracted:
    """The tables of a run: read, checked, cut to the sub-cohort, scaled by the training rows, and turned into components if asked for."""
    cohort = f"s3a://{options.s3_bucket}/{options.s3_labelled_cohort_key}" if options.s3_labelled_cohort_key else None
    data = extract(spark, options.source, cohort)
    check(data.train, data.holdout, data.cohort)
    train, holdout = data.train, data.holdout
    if settings.sub_cohort != "all":
        train, holdout = sub_cohort(train, settings.sub_cohort), sub_cohort(holdout, settings.sub_cohort)
    if settings.scale_transform or settings.pca:
        train, holdout = _scaled(train, train, "patient_id"), _scaled(train, holdout, "patient_id")
    if settings.pca:
        features, n = numeric_columns(train), train.count()
        keep = [c for c in train.columns if c not in features]
        as_arrays = lambda df: df.select(*keep, F.array(*(F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in features)).alias("x"))
        train, holdout = pca_scores(as_arrays(train), as_arrays(holdout), keep, min(n, len(features)))
    if options.use_full_data:
        train = train.unionByName(holdout)
    return Extracted(train, holdout, data.cohort)
