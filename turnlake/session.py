"""Session settings for local runs; on a cluster the submitter's own settings hold."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine with as many shuffle partitions as fit its cores."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("turnlake").config("spark.driver.memory", memory)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.config("spark.sql.shuffle.partitions", str(partitions)).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Folders for sessions that name none.
_LOCAL: dict[str, str] = {}


def checkpointed(rows: DataFrame) -> DataFrame:
    """rows written as Parquet to the shared folder of spark.checkpoint.dir and read back: cuts lineage and outlives executors.

    A written table also has a known size, where a plan that grows round by round would have ever larger estimates. A
    session on this machine that names no folder, as in tests, gets a temporary one; a cluster must name one.
    """
    spark = rows.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = _LOCAL.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="turnlake-checkpoint-"))
    path = f"{folder.rstrip('/')}/rows-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
