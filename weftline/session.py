"""Session defaults and the few settings the rest of the library relies on."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def get_session(app: str = "weftline", **conf: str) -> SparkSession:
    """A session with AQE, UTC and Arrow on; ``conf`` overrides."""
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    return SparkSession.builder.appName(app).config(map=base | conf).getOrCreate()


def ensure_workers(spark: SparkSession) -> None:
    """Let Python workers import this package where it was not installed on them.

    On a cluster the package is shipped with ``--py-files``; this covers a
    driver that merely has the checkout on its own ``sys.path``.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
