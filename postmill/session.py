"""Session defaults and the shared scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

#: Settings every job relies on. Cluster sizes (executors, shuffle partitions)
#: stay with the submitter; AQE coalesces and splits what it is given.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # Call-site capture costs several gateway calls per Column operation.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(
    app: str = "postmill", cpus: int | str = 8, partitions: int = 8, **settings: str,
) -> SparkSession:
    """A local session for tests and the bench; ``settings`` use ``_`` for the dots."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("POSTMILL_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    extra = {f"spark.{key.replace('_', '.')}": value for key, value in settings.items()}
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's ``spark.checkpoint.dir``.

    The setting is taken at its word, a ``file:`` path as a mount that all machines share.
    Only a local session without the setting falls back to a temporary folder; on a cluster a
    machine-local folder would be invisible to other executors, so there it must be set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return f"{(base or _local_scratch()).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@lru_cache(maxsize=1)
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives executor loss."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_dir(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def remove(spark: SparkSession, scratch: DataFrame) -> None:
    """Delete the folders that a frame made by ``cut`` reads; nothing may read it afterwards."""
    for folder in {file.rsplit("/", 1)[0] for file in scratch.inputFiles()}:
        remove_dir(spark, folder)
