"""Sends the package to the Python workers of a session."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Add the package to the workers' path, once a Spark application; the zip is served by the driver like any py-file."""
    sc = spark.sparkContext
    if not getattr(sc, "_assayloom_sent", False):
        home = Path(__file__).parent
        folder = tempfile.mkdtemp(prefix="assayloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        target = Path(folder) / "assayloom.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(home.rglob("*.py")):
                z.write(p, p.relative_to(home.parent))
        sc.addPyFile(str(target))
        if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":  # its default; long texts make large batches
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
        sc._assayloom_sent = True
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and written tables, which spark.checkpoint.dir names. Only a local master without one takes a folder of
    its own; the executors of a cluster would each write to a disk that the others do not see."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="assayloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
