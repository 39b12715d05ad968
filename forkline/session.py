"""Session defaults; every setting given by the caller or the cluster wins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName("forkline")
    if master:
        builder = builder.master(master)
    for k, v in (DEFAULTS | settings).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the session's executors share; a local one only where none is set."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        top = at.get() if at.isDefined() else "file://" + tempfile.mkdtemp(prefix="forkline-")
    return f"{top.rstrip('/')}/forkline/{name}-{uuid.uuid4().hex}"
