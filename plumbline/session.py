"""Session helpers: the shared scratch folder and lineage cuts."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class InputError(ValueError):
    """The caller asked for something the data cannot answer."""


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: `spark.checkpoint.dir`.

    Only a local master may run without it; there a fresh temporary folder is
    taken once per application and remembered in the session settings.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise InputError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = spark.conf.get("plumbline.scratch.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="plumbline-", dir="/tmp")
        spark.conf.set("plumbline.scratch.dir", folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/plumbline/{label}-{uuid.uuid4().hex}"


def _written(df: DataFrame, path: str) -> None:
    """Write `df`; the shuffle files made for it go as soon as it is complete."""
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLES_GO, None)
    conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(SHUFFLES_GO) if before is None else conf.set(SHUFFLES_GO, before)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the scratch folder and carry on from the written table.

    Unlike a cached frame the result survives the loss of executors, has one
    fixed content (partition numbers included) and a known size.
    """
    path = scratch_path(df.sparkSession, label)
    _written(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rewritten:
    """A table that is written anew every round of an iteration.

    Only the newest version is kept in the scratch folder: it is complete
    before the one it was made from is deleted.
    """

    def __init__(self, df: DataFrame, label: str):
        self.label, self.path, self.df = label, None, df
        self.write(df)

    def write(self, df: DataFrame) -> DataFrame:
        spark, old = df.sparkSession, self.path
        self.path = scratch_path(spark, self.label)
        _written(df, self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)
        if old is not None:
            folder = spark._jvm.org.apache.hadoop.fs.Path(old)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        return self.df


def ship(module: str) -> None:
    """Send a module's Python functions to the executors by value, so that
    nothing has to be installed there."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)
