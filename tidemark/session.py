"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # tasks by measured size: many partitions are planned and joined up to the advised size,
    # so that a task's memory does not grow with the tables; events unfold to many rows in a task
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "512",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    # split a hot join partition even where that costs one more shuffle after it
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # a grouping by (aggregate, field) must not settle for partitioning by aggregate
    "spark.sql.requireAllClusterKeysForDistribution": "true",
    # keyed state of the streaming operators, an entry per row
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings that the operators' results depend on."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def stateful(stream: DataFrame) -> DataFrame:
    """``stream``, if its session keeps state in a way that the streaming operators can use."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if stream.sparkSession.conf.get(name, "") != SETTINGS[name]:
        raise ValueError(f"set {name} to {SETTINGS[name]}, as session.configure does")
    return stream


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    A machine-local folder is made only for local masters, where driver and
    executors are one process; elsewhere a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    return tempfile.mkdtemp(prefix="tidemark-")


def run_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh sub-folder of the shared folder for one run."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"
