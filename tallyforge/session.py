"""Session factory and the one place where checkpoint folders and scratch tables are decided."""

from __future__ import annotations

import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Defaults for a local run; a cluster's own settings win as they are set before the session starts.
LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "8g",
}


def get_session(app: str = "tallyforge", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session in UTC; an active session is returned as it is."""
    builder = SparkSession.builder.appName(app).master(f"local[{cores}]")
    for key, value in LOCAL_CONF.items():
        builder = builder.config(key, value)
    return builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset a folder of our own, on a local master only."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = os.path.join(tempfile.gettempdir(), "tallyforge-checkpoints")
    spark.sparkContext.setCheckpointDir(own)
    return own


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as a parquet table under the checkpoint folder and read again.

    It cuts the lineage as checkpoint() does, and takes less room: columns are encoded and compressed (by zstd: such tables
    lie beside the shuffles that make and read them), and later reads are pruned. ``discard`` drops a table after its last reader; one that a returned result still reads lives as long as the
    folder, whose owner clears it.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    release(spark)
    return out


def discard(*tables: DataFrame) -> None:
    """Drops tables that ``materialize`` wrote; nothing may read them afterwards."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle files and broadcasts of finished steps.

    The cleaner acts when the driver's collector has found their owners unused, which on a large heap can take longer than
    the whole job; the disk they hold would then be the sum over all steps and not the most of one. One collection finds
    the owners of the step before; those of the step that has just ended are found by a second one shortly after it.
    """
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.5)
    spark.sparkContext._jvm.System.gc()
