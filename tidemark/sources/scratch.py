"""Shared working storage: tables that cut lineage and survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DIR_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where that setting is missing (local tests) a temporary folder takes its place; on a cluster a
    machine-local folder would not be visible to the executors.
    """
    found = spark.conf.get(DIR_KEY, None) or spark.sparkContext.getConf().get(DIR_KEY)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{DIR_KEY} must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set(DIR_KEY, found)
    return found.rstrip("/")


_working: dict[str, str] = {}


def _file_system(spark: SparkSession, path: str):
    """The Hadoop file system of ``path``, and the path as it takes it."""
    jvm, context = spark._jvm, spark.sparkContext
    held = jvm.org.apache.hadoop.fs.Path(path)
    return held.getFileSystem(context._jsc.hadoopConfiguration()), held


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path nobody else uses, in this application's working folder below the shared one. The working folder goes
    when the application ends."""
    app = spark.sparkContext.applicationId
    if app not in _working:
        _working[app] = f"{shared_dir(spark)}/work-{app}-{uuid.uuid4().hex}"
        fs, path = _file_system(spark, _working[app])
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return f"{_working[app]}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete what lies at ``path``, a path of ``fresh_path`` that no DataFrame reads any more."""
    fs, held = _file_system(spark, path)
    fs.delete(held, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage like ``checkpoint()``, in a compressed columnar form that later steps can prune. The
    schema is handed to the reader, so no file is opened to infer it.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
