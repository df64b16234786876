"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where the setting and the context have none (a local session in tests), a temporary
    folder is set; on a cluster without one this raises instead of using a local disk.
    """
    at = spark.sparkContext._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tracelode-")
    spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once into the shared folder; what follows doesn't depend on an executor's disk."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def clean(spark: SparkSession) -> None:
    """Remove what this session has cut and written into its shared folder (checkpoints, packages, streams); frames that still need it can't be read any more."""
    at = spark.sparkContext._jsc.sc().getCheckpointDir()
    if at.isDefined():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at.get())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def python_path(spark: SparkSession) -> None:
    """Tell Python workers where this package is, where their path lacks it."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
