"""A session with the settings that the operators expect."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def session(master: str | None = None, **more: str) -> SparkSession:
    """UTC, adaptive plans with skew handling; a cluster's own settings are kept where ``more`` has none."""
    conf = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    builder = SparkSession.builder.config(map=conf | {f"spark.{k.replace('__', '.')}": v for k, v in more.items()})
    return (builder.master(master) if master else builder).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a local one on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints/terracurve"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in this application's folder of the shared one."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def sweep(spark: SparkSession) -> None:
    """Deletes this application's folder; frames that read from it can't be used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
