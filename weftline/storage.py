"""The folder that all executors share, and cutting lineage with it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from weftline.session import ensure_workers


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only a local master gets a temporary one where it is unset."""
    ensure_workers(spark)
    at, sc = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if at is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        made = tempfile.mkdtemp(prefix="weftline-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        at = "file://" + made
        spark.conf.set("spark.checkpoint.dir", at)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder, with its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/weft-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again: columnar, so later reads prune."""
    at = new_folder(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder that :func:`new_folder` named and that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
