"""Writing what a run delivers."""

from __future__ import annotations

import getpass
import json
import logging
import subprocess
import time

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.config import Options, Settings, as_dict


def parameter_table(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """(stage, param, value) of every stage of a pipeline."""
    rows = [(s.uid, p.name, str(v)) for s in model.stages for p, v in s.extractParamMap().items()]
    return spark.createDataFrame(rows, "stage string, param string, value string")


def metadata(spark: SparkSession, options: Options, settings: Settings, model_id: str, files: list[str]) -> DataFrame:
    """One row: who ran what, when, from which commit, and the files made."""
    commit = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, check=False).stdout.strip() or "unknown"
    row = (model_id, getpass.getuser(), commit, time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), options.target, files, json.dumps(as_dict(settings)), json.dumps(as_dict(options)))
    return spark.createDataFrame([row], "model_id string, user string, commit string, written string, path string, files array<string>, settings string, options string")


class Lines(logging.Handler):
    """Keeps what is logged, for a run's log."""

    def __init__(self):
        super().__init__()
        self.lines: list[str] = []
        self.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))

    def emit(self, record: logging.LogRecord) -> None:
        self.lines.append(self.format(record))


def save_log(spark: SparkSession, options: Options, model_id: str, lines: list[str]) -> str | None:
    """A run's log as text under <target>/<model_id>_log.txt, wherever Spark can write; a dry run writes nothing."""
    if options.dry_run:
        return None
    path = f"{options.target.rstrip('/')}/{model_id}_log.txt"
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON, for text formats."""
    return df.select(*(F.to_json(f"`{f.name}`").alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f"`{f.name}`") for f in df.schema.fields))


def save(spark: SparkSession, options: Options, settings: Settings, model_id: str, tables: dict[str, DataFrame], models: dict[str, PipelineModel] | None = None, fmt: str = "csv", with_metadata: bool = True) -> list[str]:
    """Each table under <target>/<model_id>_<name>.<fmt>, each model under .model; a dry run writes nothing. The paths written."""
    if options.dry_run:
        return []
    base, paths = options.target.rstrip("/"), []
    for name, df in tables.items():
        paths.append(f"{base}/{model_id}_{name}.{fmt}")
        out = (flat(df) if fmt == "csv" else df).write.mode("overwrite")
        out.option("header", True).csv(paths[-1]) if fmt == "csv" else out.format(fmt).save(paths[-1])
    for name, model in (models or {}).items():
        paths.append(f"{base}/{model_id}_{name}.model")
        model.write().overwrite().save(paths[-1])
    if with_metadata:
        paths.append(f"{base}/{model_id}_metadata.json")
        metadata(spark, options, settings, model_id, paths[:-1]).write.mode("overwrite").json(paths[-1])
    for path in paths:
        logging.getLogger(__name__).info("written: %s", path)
    return paths
