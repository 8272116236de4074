"""Session helpers shared by tests, bench and operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, memory: str = "8g", shuffle: int | None = None) -> SparkSession:
    """A local session with the settings the tests and the bench rely on."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lumenspark")
        .config("spark.sql.shuffle.partitions", str(shuffle or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared checkpoint folder; only where none is set (tests) make one."""
    sc = spark.sparkContext
    jsc = sc._jsc.sc()
    current = jsc.getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = os.path.join(tempfile.gettempdir(), "lumenspark-checkpoints")
    sc.setCheckpointDir(made)
    return made


_WRITTEN: list[tuple[SparkSession, str]] = []


def remove_written() -> None:
    """Delete the tables that cut_lineage has written; results that read them can't be computed again. Called when the process ends."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001 - the session may have ended; the folder is the cluster's to clean then
            return


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a table into the shared checkpoint folder and read it back.

    Unlike checkpoint() this computes the rows once; the files survive lost executors.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(remove_written)
    _WRITTEN.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
